"""The read side: one function per view, each a DataFrame.  ``now`` is a parameter, in epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_day, local_hour

LEAD_COLUMNS = [
    "id", "domain", "business", "phone", "category", "layers", "proof_snippet", "proof_url", "http_status", "stage2_verdict",
    "stage2_reason", "confirmed", "ts", "evidence", "is_bd", "biz_type", "status", "ip", "is_manual", "mbatch", "address", "district",
]


def queue_status(batches: DataFrame) -> DataFrame:
    return batches.groupBy("status").agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("domain_count"), F.lit(0)).alias("domains"))


def category_counts(findings: DataFrame) -> DataFrame:
    """Confirmed findings by category, rejected ones included."""
    return findings.where("confirmed = 1").groupBy("category").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "category")


def lead_regions(findings: DataFrame) -> DataFrame:
    """Confirmed, not rejected findings by region; a null status is left out, as in SQL."""
    rows = findings.where("confirmed = 1 AND status != 'rejected'")
    return rows.groupBy(F.when(F.coalesce("is_bd", F.lit(0)) != 0, "bd").otherwise("intl").alias("region")).agg(F.count(F.lit(1)).alias("c"))


def registry_counts(domains: DataFrame) -> DataFrame:
    return domains.agg(F.count_if(F.col("domain").ilike("%.bd")).alias("bd_domains"), F.count_if(F.col("pass_no") == 0).alias("unscanned"))


def rate_this_hour(hourly: DataFrame, now: int) -> DataFrame:
    hour = local_hour(F.timestamp_seconds(F.lit(now)))
    return hourly.where(F.col("hour") == hour).agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"))


def latest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The last ``n`` by ``column``, in rising order (21 days, 48 hours)."""
    return rows.orderBy(F.desc(column)).limit(n).orderBy(column)


def top_sources(sources: DataFrame, n: int = 60) -> DataFrame:
    return sources.select("source", "total_harvested", "last_run").orderBy(F.desc("total_harvested"), "source").limit(n)


def live_workers(heartbeats: DataFrame, now: int, window: int = 900) -> DataFrame:
    return heartbeats.where(F.col("last_seen") > now - window).orderBy(F.desc("last_seen"), "worker_id")


def key_usage_today(usage: DataFrame, now: int) -> DataFrame:
    return usage.where(F.col("day") == local_day(F.timestamp_seconds(F.lit(now)))).orderBy(F.desc("requests"), "key_id")


def leads(findings: DataFrame, category: str | None = None, region: str | None = None, biz: str | None = None, confirmed: bool = True,
          manual: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of leads, newest first (ties by id, newest first); at most 5000 rows, rejected and null status left out."""
    rows = findings.where("status != 'rejected'")
    if manual:
        rows = rows.where("is_manual = 1")
    else:
        rows = rows.where("coalesce(is_manual, 0) = 0")
        rows = rows.where("confirmed = 1") if confirmed else rows
        rows = rows.where(F.col("is_bd") == (1 if region == "bd" else 0)) if region in ("bd", "intl") else rows
    rows = rows.where(F.col("category") == category) if category else rows
    rows = rows.where(F.col("biz_type") == biz) if biz else rows
    page = rows.orderBy(F.desc("ts"), F.desc("id")).offset(max(offset, 0)).limit(min(limit or 200, 5000))
    return page.select([c for c in LEAD_COLUMNS if c in findings.columns])


def feed(log: DataFrame, limit: int = 60) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(min(limit or 60, 200)).select("kind", "domain", "detail", "ts")


def seeds(domains: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of known ``.bd`` domains by row_id, with the total beside each."""
    rows = domains.where(F.col("domain").ilike("%.bd"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy("row_id").offset(max(offset, 0)).limit(min(limit or 200, 500)).select("row_id", "domain")
    return page.join(F.broadcast(total), F.lit(True))  # one row


def contact_candidates(findings: DataFrame, n: int = 8) -> DataFrame:
    """Confirmed leads still without address and district, oldest first."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return findings.where("confirmed = 1 AND status != 'rejected'").where(empty("address") & empty("district")).orderBy("id").limit(n).select("domain")


def address_candidates(findings: DataFrame, n: int = 12) -> DataFrame:
    """Confirmed leads still without a hosting address, oldest first."""
    return findings.where("confirmed = 1 AND status != 'rejected'").where("coalesce(ip, '') = ''").orderBy("id").limit(n).select("domain")


def as_json(rows: DataFrame, name: str = "body") -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias(name))
