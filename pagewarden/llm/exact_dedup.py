"""Exact deduplication as a stateful stream over digests (JVM side only).

A narrow table (digest, id, length, locator) is streamed through a keyed
aggregation whose state sits in RocksDB on the executors' disks, is checkpointed
to the shared folder and never expires.  Per digest the state retains the row
that stays: its stable identifier and its locator (partition and row in the
narrow table).  After the stream the state is read back with Spark's state
reader.  Hits get a check of the full bytes: in a digest's group the least and
the greatest normalised text must be the same string.  Groups that fail (a
collision) are formed anew by their text.

Skew: the stream and the byte check both combine on the map side, so a group
with a third of all rows is one row per task after the first step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, persist, scratch_path, settings, text_of, unused

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: All state stores of an executor share this much memory for blocks and write buffers; the rest is on its disk.
STATE_MEMORY = {
    "spark__sql__streaming__stateStore__providerClass": ROCKS,
    "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
    "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "128",
    "spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB": "4",
    # Without preallocated files a state of many small partitions takes the disk it needs.
    "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
    # Stores of a query that has ended are unloaded at the next round of maintenance.
    "spark__sql__streaming__stateStore__maintenanceInterval": "10s",
}


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("locator"),
    )


def _first() -> Column:
    """The row that stays sorts first: most code points, then smallest id (null last), then locator."""
    return F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "locator")


def stream_state(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """Run the keyed stream over the narrow table at ``path``; return (digest, keep, group_size)."""
    checkpoint = scratch_path(spark, "dedup-state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    keyed = state_of(stream)
    with settings(spark, **STATE_MEMORY):
        query = (
            keyed.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        query.awaitTermination()
        if query.lastProgress is None:  # an empty table ran no batch: there is no state
            return state_of(spark.read.schema(schema).parquet(path))
        state = spark.read.format("statestore").load(checkpoint)
        names = {f.dataType.typeName(): f.name for f in state.schema["value"].dataType.fields}
        state = state.select(
            F.col("key.digest").alias("digest"),
            F.col(f"value.`{names['struct']}`").alias("keep"),
            F.col(f"value.`{names['long']}`").alias("group_size"),
        )
        return persist(spark, state, "dedup-keys")


def _collisions(spark: SparkSession, docs: DataFrame, text_col: str) -> DataFrame:
    """Digests whose rows do not all have the same normalised bytes: at most two texts of a digest leave a task."""
    text = normalised(text_of(text_col))
    rows = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("t"))
    both = rows.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return persist(spark, both.where(F.col("a") != F.col("b")).select("digest"), "dedup-collisions")


def exact_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator, keep_locator.

    Texts are equal when identical without the six blanks of ``BLANKS``; null is
    empty.  Of equal texts the one with the most code points, then the smallest
    id, stays; a null id comes after all others; of rows repeated with the same
    id one stays (the first in the narrow table).  Empty texts form one group.
    Other columns are not read, whatever their names.
    """
    narrow = persist(spark, fingerprints(docs, id_col, text_col), "dedup-narrow")
    path = narrow.inputFiles()
    if not path:
        return _result(narrow, state_of(narrow))
    state = stream_state(spark, path[0].rsplit("/", 1)[0], narrow.schema, files_per_batch)
    wrong = _collisions(spark, docs, text_col)
    if wrong.isEmpty():
        return _result(narrow, state)
    # Colliding digests: key their rows by the text itself.
    text = normalised(text_of(text_col))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.length(text_of(text_col)).cast("long").alias("n"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("locator"),
    ).join(wrong, "digest", "left_semi")
    keyed = persist(spark, keyed, "dedup-rekeyed")
    fresh = keyed.groupBy("digest", "t").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = keyed.join(fresh, ["digest", "t"]).select("doc_id", "digest", "n", "locator", "keep", "group_size")
    rest = narrow.join(wrong, "digest", "left_anti")
    return _result(rest, state).unionByName(_shape(again))


def state_of(narrow: DataFrame) -> DataFrame:
    """(digest, keep, group_size) of a narrow table, batch or stream."""
    return narrow.groupBy("digest").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def _result(narrow: DataFrame, state: DataFrame) -> DataFrame:
    return _shape(narrow.join(state, "digest"))


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "locator",
        F.col("keep.locator").alias("keep_locator"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns unchanged.

    Rows are matched by id.  Where an id is repeated or missing, rows are matched
    by id and digest; of those the longest text stays, then the least by hash, and
    rows with the same id and text are reduced to one.
    """
    rows = exact_dedup(spark, docs, id_col, text_col)
    rows = persist(spark, rows.select("doc_id", "kept", "text_sha256"), "dedup-kept")
    stay = rows.where("kept")
    own, digest, best, kept, key = unused(docs.columns, "__id", "__digest", "__best", "__kept", "__key")
    repeated = not rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    if not repeated:
        return docs.join(stay.select(F.col("doc_id").alias(own)), F.col(id_col) == F.col(own), "left_semi").select(docs.columns)
    text = text_of(text_col)
    marked = docs.withColumn(digest, F.sha2(normalised(text).cast("binary"), 256)).withColumn(best, F.struct(-F.length(text), F.xxhash64(text)))
    stay = stay.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(kept))
    match = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(digest) == F.col(kept))
    marked = marked.join(stay, match, "left_semi")
    first = marked.groupBy(F.col(id_col).cast("long").alias(own), F.col(digest).alias(kept)).agg(F.min(best).alias(key))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(digest) == F.col(kept)) & (F.col(best) == F.col(key))
    return marked.join(first, same, "left_semi").dropDuplicates([id_col, digest]).select(docs.columns)
