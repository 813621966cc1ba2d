"""The scan queue: batches of pending domains, shards, rotating slices, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import numbered

BATCH = 1000


def assign_batches(domains: DataFrame, now: int, next_id: int = 1, size: int = BATCH, most: int = 80, settle: int = 600) -> DataFrame:
    """Pending domains (batch_id null) with new batch ids, in order of row_id.

    Full batches only, at most ``most``; a remainder becomes a batch once its
    oldest pending domain is more than ``settle`` seconds old.
    """
    pending = domains.where("batch_id IS NULL")
    totals = pending.agg(F.count(F.lit(1)).alias("c"), F.min("added_ts").alias("m")).first()  # one row
    full = min(totals["c"] // size, most)
    flush = totals["c"] > full * size and full < most and totals["m"] and now - totals["m"] > settle
    rank = numbered(pending, ["row_id"], "rn")
    number = F.floor((F.col("rn") - 1) / size)
    kept = (number < full) | F.lit(bool(flush))
    last = F.least(number, F.lit(full))
    return rank.withColumn("batch_id", F.when(kept, last + next_id).cast("long")).where("batch_id IS NOT NULL").drop("rn")


def batch_table(assigned: DataFrame, now: int) -> DataFrame:
    return assigned.groupBy("batch_id").agg(F.count(F.lit(1)).alias("domain_count")).select(
        "batch_id", F.lit(1).alias("pass_no"), "domain_count", F.lit("ready").alias("status"), F.lit(now).alias("created_ts"))


def shard(rows: DataFrame, shards: int, k: int, row_id: str = "row_id") -> DataFrame:
    return rows.where(F.pmod(F.col(row_id), F.lit(shards)) == k)


def scan_slice(domains: DataFrame, shards: int, k: int, n: int) -> DataFrame:
    """Unscanned domains of a shard, best score first, then row_id."""
    return shard(domains.where("pass_no = 0"), shards, k).orderBy(F.desc("bd_score"), "row_id").limit(n)


def rotating_slice(rows: DataFrame, index: str, total: int, start: int, take: int) -> DataFrame:
    """``take`` rows from ``start``, wrapping round; ``index`` runs from 0 to ``total - 1``."""
    if total <= 0 or take <= 0:
        return rows.limit(0)
    if take >= total:
        return rows
    return rows.where(F.pmod(F.col(index) - start, F.lit(total)) < take)


def next_offset(start: int, take: int, total: int) -> int:
    return 0 if total <= 0 or take >= total else (start + take) % total


def claimable(batches: DataFrame, now: int, stale: int = 1800) -> DataFrame:
    """The batch to hand out: the oldest ready one, else the one claimed longest ago and stale."""
    ready = batches.where("status = 'ready'").select("batch_id", F.lit(0).alias("kind"), F.col("batch_id").cast("long").alias("by"))
    old = batches.where((F.col("status") == "claimed") & (F.col("claimed_ts") < now - stale))
    old = old.select("batch_id", F.lit(1).alias("kind"), F.col("claimed_ts").cast("long").alias("by"))
    return ready.unionByName(old).orderBy("kind", "by").limit(1).select("batch_id")


def claim(batches: DataFrame, batch_id: int, worker: str, now: int) -> DataFrame:
    hit = F.col("batch_id") == batch_id
    return batches.withColumns({
        "status": F.when(hit, "claimed").otherwise(F.col("status")), "claimed_by": F.when(hit, worker).otherwise(F.col("claimed_by")),
        "claimed_ts": F.when(hit, now).otherwise(F.col("claimed_ts"))})


def requeue_stale(batches: DataFrame, now: int, stale: int = 1800) -> DataFrame:
    hit = (F.col("status") == "claimed") & (F.col("claimed_ts") < now - stale)
    return batches.withColumns({
        "status": F.when(hit, "ready").otherwise(F.col("status")), "claimed_by": F.when(~F.coalesce(hit, F.lit(False)), F.col("claimed_by"))})


def batch_domains(domains: DataFrame, batches: DataFrame) -> DataFrame:
    return domains.join(batches.select("batch_id"), "batch_id").select("batch_id", "domain", "business", "phone")


def finish(batches: DataFrame, done: DataFrame) -> DataFrame:
    """``done``: batch_id, done_ts, scanned, flagged, confirmed, errors."""
    names = ["done_ts", "scanned", "flagged", "confirmed", "errors"]
    d = done.select("batch_id", *[F.col(c).alias(f"__{c}") for c in names])
    rows = batches.join(d, "batch_id", "left")
    hit = F.col("__done_ts").isNotNull()
    new = {c: F.coalesce(f"__{c}", c) for c in names} | {"status": F.when(hit, "done").otherwise(F.col("status"))}
    return rows.withColumns(new).select(batches.columns)
