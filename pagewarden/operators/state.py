"""State changes as pure functions: (state, delta) -> state.

Parquet has no MERGE; each function returns the whole new table as a plan of
anti-joins, unions and grouped aggregates.  :func:`publish` writes it as a new
version, so readers keep the old one until the new one is complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.domains import normalize_domain, valid_ip
from .settle import settle


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; rows with a null key go."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    body = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.min_by(body, F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key (a combined aggregate, not a window: hot keys cost one row per task)."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.max_by(body, F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def insert_ignore(state: DataFrame, delta: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``state`` with the rows of ``delta`` whose key is new; of equal new keys the first by ``order``."""
    fresh = first_wins(delta, keys, order).join(state.select(*keys).distinct(), keys, "left_anti")
    return state.unionByName(fresh.select(state.columns), allowMissingColumns=True)


def insert_counts(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """One row: found (distinct keys in ``delta``), inserted, dups."""
    found = delta.select(*keys).dropna().distinct()
    new = found.join(state.select(*keys).distinct().withColumn("__old", F.lit(1)), keys, "left")
    counts = new.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("__old").isNull()).alias("inserted"))
    return counts.withColumn("dups", F.col("found") - F.col("inserted"))


def accumulate(state: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], latest: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Upsert that adds ``sums`` and, for ``latest`` columns, keeps the value of the delta with the greatest ``order``."""
    latest = latest or []
    rows = state.select(*keys, *sums, *latest, F.lit(0).alias("__new"), *([F.col(order).alias("__o")] if order else [F.lit(0).alias("__o")]))
    more = delta.select(*keys, *sums, *latest, F.lit(1).alias("__new"), *([F.col(order).alias("__o")] if order else [F.lit(0).alias("__o")]))
    aggs = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums] + [F.max_by(c, F.struct("__new", "__o")).alias(c) for c in latest]
    return rows.unionByName(more).groupBy(*keys).agg(*aggs)


def replace_rows(state: DataFrame, delta: DataFrame, keys: list[str], order: list, only=None) -> DataFrame:
    """Rows of ``state`` with a key in ``delta`` give way to the last row of that key in ``delta``.

    ``only``: a condition; state rows that do not meet it stay in any case.
    """
    fresh = last_wins(delta, keys, order)
    gone = state if only is None else state.where(only)
    stay = gone.join(fresh.select(*keys), keys, "left_anti")
    if only is not None:
        stay = stay.unionByName(state.where(~F.coalesce(only, F.lit(False))))
    return stay.unionByName(fresh, allowMissingColumns=True)


def append_findings(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Plain append: a second scan doubles a domain."""
    return state.unionByName(delta, allowMissingColumns=True)


def replace_findings(state: DataFrame, delta: DataFrame) -> DataFrame:
    """A domain's findings, manual ones too, give way to its newest finding."""
    return replace_rows(state, delta, ["domain"], ["ts"])


def replace_manual(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Only manual findings of the domain give way."""
    return replace_rows(state, delta, ["domain"], ["ts"], F.col("is_manual") == 1)


def backfill_contacts(findings: DataFrame, contacts: DataFrame) -> DataFrame:
    """Address and district of confirmed findings from ``contacts`` (``-`` where nothing was found); phone only if missing."""
    c = contacts.select("domain", *[F.col(x).alias(f"__{x}") for x in ("address", "district", "phone")], F.lit(True).alias("__hit"))
    rows = findings.join(c, "domain", "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("confirmed") == 1)
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return rows.withColumns({
        "address": F.when(hit, dash("__address")).otherwise(F.col("address")),
        "district": F.when(hit, dash("__district")).otherwise(F.col("district")),
        "phone": F.when(hit & (F.coalesce("phone", F.lit("")) == ""), F.col("__phone")).otherwise(F.col("phone")),
    }).select(findings.columns)


def store_addresses(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """findings.ip from (ord, domain, ip) pairs: valid addresses only, the last pair of a domain holds."""
    good = pairs.select("ord", normalize_domain(F.col("domain")).alias("domain"), F.substring(F.trim("ip"), 1, 45).alias("__ip"))
    good = last_wins(good.where(F.col("domain").isNotNull() & valid_ip(F.col("__ip"))), ["domain"], ["ord"]).drop("ord")
    return findings.join(good, "domain", "left").withColumn("ip", F.coalesce("__ip", "ip")).select(findings.columns)


def set_status(findings: DataFrame, finding_id: int, status: str) -> DataFrame:
    """Toggle one finding between lead and rejected (any other word means rejected)."""
    value = "lead" if status == "lead" else "rejected"
    return findings.withColumn("status", F.when(F.col("id") == finding_id, value).otherwise(F.col("status")))


def update_by_id(rows: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Join-update: columns from ``delta`` where it has the key."""
    d = delta.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = rows.join(d, key, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(rows.columns)


def trim_log(log: DataFrame, keep: int = 2000) -> DataFrame:
    """Rows with an id of at least the greatest id less ``keep`` (so up to ``keep + 1`` rows)."""
    least = log.agg((F.coalesce(F.max("id"), F.lit(0)) - keep).alias("__least"))
    return log.join(F.broadcast(least), F.col("id") >= F.col("__least")).drop("__least")  # one row


def recount(counters: DataFrame, metric: str, rows: DataFrame) -> DataFrame:
    """The counter ``metric`` set to the number of ``rows``."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    out = counters.join(F.broadcast(n), F.lit(True))  # one row
    return out.withColumn("value", F.when(F.col("metric") == metric, F.col("__n")).otherwise(F.col("value"))).drop("__n")


def add_to_counter(counters: DataFrame, metric: str, amount: int) -> DataFrame:
    """``amount`` more for ``metric``; a metric that was never seeded stays absent."""
    return counters.withColumn("value", F.when(F.col("metric") == metric, F.col("value") + amount).otherwise(F.col("value")))


def ingest_rollup(findings: DataFrame, categories, scanned: int = 0, errors: int = 0) -> DataFrame:
    """One row of counts for a batch of findings: flagged, confirmed, and confirmed by category."""
    conf = F.col("confirmed") == 1
    by = [F.count_if(conf & (F.lower("category") == c)).alias(c) for c in categories]
    return findings.agg(
        F.lit(scanned).cast("long").alias("scanned"), F.count(F.lit(1)).alias("flagged"), F.count_if(conf).alias("confirmed"),
        F.lit(errors).cast("long").alias("errors"), *by)


def merge_results(parts: list[DataFrame]) -> DataFrame:
    """Results of shards, put together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered(rows: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """A dense row number from 1 in ``order`` without gathering the rows in one task.

    Rows are range-partitioned by ``order``; only the partition sizes, one row per
    partition, are summed over.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    # The partition of a row must not change between the two uses, nor when an executor is lost.
    dealt = settle(dealt)
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn("__i", inside).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__i")).drop("__p", "__i", "__start")


def publish(spark: SparkSession, df: DataFrame, folder: str, version: int) -> str:
    """Write a new version of a table; the version folder appears whole when Spark's commit ends."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
