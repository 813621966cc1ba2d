"""Mixing sources to target weights by weighted fair queueing (JVM side only).

Every document of a source is queued once or twice (two rounds, since a target
is at most twice its source).  Within a source the order is a fixed shuffle, the
md5 of the id; a queued document's virtual finish time is the source's
cumulative size up to and with it, divided by the source's target weight.  All
queued documents are then ordered by finish time over all sources and cut at the
total budget, the sum of the targets; the document on the cut is taken in part.

Cumulative sums never put one source, or all rows, in one task: rows are dealt
to buckets (ranges of the shuffled order, then ranges of finish time), bucket
totals are summed over a small table, and only sums within a bucket need a
window.  The number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist, text_of, unused, words_of

#: Weights of the sources by rank of their name, repeating (fixed by the contract of this query).
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, weight, source_size, target) for a table (source, source_size).

    Targets share ``share`` times all sizes by weight; none is above ``most``
    times its source's size, and what is cut off is shared anew by weight.  The
    level is found in closed form: sources fill up in the order of size over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    rows = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.get(w, F.col("place") % len(weights)))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    rows = rows.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(rest))
    rows = rows.withColumn("rate", (F.col("budget") - F.col("used")) / F.col("left"))
    # The first source, in this order, that does not fill up sets the rate for all that follow.
    open_rate = F.first(F.when(F.col("rate") < F.col("level"), F.col("rate")), ignorenulls=True).over(whole_by(by_level))
    rows = rows.withColumn("open_rate", open_rate)
    target = F.coalesce(F.least("cap", F.col("open_rate") * F.col("weight")), F.col("cap"))
    return rows.select("source", "place", "weight", "source_size", target.alias("target"))


def whole_by(order):
    return order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    Size: runs of non-blank characters (null text: 0).  A null source is a source
    of its own, last by name.  Documents of size 0 take 0.  A source whose
    documents are all empty has target 0.  Repeated rows queue separately; their
    place among equals is not told apart, as their sizes are equal by then.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words_of(text_of(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
    )
    sized = persist(spark, sized, "mix-sizes")
    buckets = max(1, -(-sized.count() // rows_per_bucket))
    # Range of the shuffled order: the first 32 bits of the md5, scaled.
    head = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.floor(head * buckets / F.lit(2.0**32)).cast("int"))

    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    targets = persist(spark, targets, "mix-targets")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    starts = starts.drop("bucket_size").withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("within", F.sum("size").over(inside))
    queue = queue.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    named = targets.withColumnRenamed("source", "s")
    queue = queue.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    end = (F.col("start") + F.col("within")).cast("long").alias("end")
    queue = queue.select("doc_id", "source", "size", "source_size", "target", "place", "shuffle", end)
    queue = persist(spark, queue, "mix-queue")

    turns = [_turn(k) for k in (0, 1)]
    budget = int(targets.agg(F.floor(F.sum("target")).cast("long")).first()[0] or 0)
    key = _cut(queue, turns, budget, 4 * buckets)
    taken = F.lit(0).cast("long")
    for turn in turns:
        if key is None:  # the queue holds no more than the budget
            got = F.col("size")
        else:
            at = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(ORDER, key["at"], ORDER_TYPES)])
            got = F.when(turn < at, F.col("size")).when(turn == at, F.lit(key["part"])).otherwise(F.lit(0))
        taken = taken + F.when(turn["finish"].isNotNull(), got).otherwise(F.lit(0)).cast("long")
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


#: Total order of the queued documents: finish time, source, round, shuffled order.
ORDER = ("finish", "place", "round", "shuffle", "id")
ORDER_TYPES = ("double", "int", "int", "string", "long")


def _turn(k: int):
    finish = (F.col("end") + k * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
    return F.struct(
        finish.alias("finish"), F.col("place").cast("int").alias("place"), F.lit(k).alias("round"),
        F.col("shuffle").alias("shuffle"), F.coalesce("doc_id", F.lit(-1)).alias("id"),
    )


def _cut(queue: DataFrame, turns: list, budget: int, slots: int) -> dict | None:
    """The queued document on which the budget ends, as its place in the total order, and the part it gives.

    Finish times fall into slots; totals of slots find the slot of the cut, and
    only that slot's documents are sorted.  What comes to the driver is one row.
    """
    due = queue.select("size", F.explode(F.array(*turns)).alias("turn")).where("turn.finish IS NOT NULL AND size > 0")
    due = due.withColumn("slot", F.floor(F.col("turn.finish") * slots).cast("long"))
    totals = due.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    up_to = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("up_to", F.sum("slot_size").over(up_to))
    found = totals.where(F.col("up_to") > budget).orderBy("slot").first()
    if found is None:
        return None
    before = found["up_to"] - found["slot_size"]
    inside = due.where(F.col("slot") == found["slot"])
    up_to = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("up_to", F.lit(before) + F.sum("size").over(up_to))
    row = inside.where(F.col("up_to") > budget).orderBy("up_to").first()
    return {"at": list(row["turn"]), "part": int(budget - (row["up_to"] - row["size"]))}


def mix_documents(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` as the mix takes them: rows that are not taken go, rows taken twice are repeated; columns unchanged.

    The document on the cut, which the mix takes in part, stays whole.  Rows that
    share id, source and size share their turns: all get the same number, and of
    what is left over one each goes to the first by text.
    """
    mixed = mix_sources(spark, docs, id_col, text_col, source_col)
    own, source, n, turns, extra, size, place, turn = unused(
        docs.columns, "__id", "__source", "__n", "__turns", "__extra", "__size", "__place", "__turn")
    each = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    sums = mixed.groupBy("doc_id", "source", "size").agg(F.sum(each).alias("t"), F.count(F.lit(1)).alias("c")).where("t > 0")
    sums = sums.select(
        F.col("doc_id").alias(own), F.col("source").alias(source), F.col("size").alias(n),
        F.floor(F.col("t") / F.col("c")).cast("int").alias(turns), (F.col("t") % F.col("c")).alias(extra))
    match = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & F.col(source_col).cast("string").eqNullSafe(F.col(source))
    rows = docs.withColumn(size, words_of(text_of(text_col))).join(sums, match & (F.col(size) == F.col(n)))
    first = F.row_number().over(Window.partitionBy(own, source, n).orderBy(text_col))
    uneven = rows.where(F.col(extra) > 0).withColumn(place, first)
    uneven = uneven.withColumn(turns, F.col(turns) + (F.col(place) <= F.col(extra)).cast("int")).drop(place)
    rows = rows.where(F.col(extra) == 0).unionByName(uneven).where(F.col(turns) > 0)
    return rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turns)))).select(docs.columns)
