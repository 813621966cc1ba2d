"""Shared hosting: from known domains over their addresses to their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import bd_score, cdn_address, provider, registrable


def resolve(domains: DataFrame, dns: DataFrame, keep_cdn: bool = False) -> DataFrame:
    """(domain, ip) without addresses of content networks; ``keep_cdn`` marks those and misses as ``cdn`` instead."""
    rows = domains.select("domain").distinct().join(dns.select("domain", "ip"), "domain", "left")
    hidden = F.col("ip").isNull() | cdn_address(F.col("ip"))
    if keep_cdn:
        return rows.withColumn("ip", F.when(hidden, "cdn").otherwise(F.col("ip")))
    return rows.where(~hidden)


def hotspots(lead_ips: DataFrame, done: DataFrame | None = None, n: int = 60) -> DataFrame:
    """Addresses by number of leads, densest first; addresses in ``done`` are skipped unless all are done."""
    ranked = lead_ips.groupBy("ip").agg(F.countDistinct("domain").alias("leads"))
    if done is not None:
        seen = done.select("ip").distinct().withColumn("__seen", F.lit(1))
        rows = ranked.join(seen, "ip", "left")
        every = rows.agg(F.min(F.col("__seen").isNotNull()).alias("__all"))
        rows = rows.join(F.broadcast(every), F.lit(True))  # one row
        ranked = rows.where(F.col("__seen").isNull() | F.col("__all")).select("ip", "leads")
    return ranked.orderBy(F.desc("leads"), "ip").limit(n)


def neighbours(ips: DataFrame, rdns: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(domain, ips, bd_score) of co-hosted registrable domains: no providers, none of ``exclude``."""
    rows = ips.select("ip").distinct().join(rdns, "ip").select("ip", registrable(F.col("host")).alias("domain"))
    rows = rows.where(F.col("domain").isNotNull() & ~provider(F.col("domain")))
    if exclude is not None:
        rows = rows.join(exclude.select("domain").distinct(), "domain", "left_anti")
    found = rows.groupBy("domain").agg(F.countDistinct("ip").alias("ips"))
    return found.withColumn("bd_score", bd_score(F.col("domain"), ip_bd=True))


def seed_domains(domains: DataFrame, least: int = 25, limit: int = 25, offset: int = 0) -> DataFrame:
    """Seeds of a neighbour search: domains (row_id, domain, bd_score) of enough score by row_id; past the end, from the start."""
    rows = domains.where(F.col("bd_score") >= least).select("row_id", "domain")
    page = rows.orderBy("row_id").offset(max(offset, 0)).limit(limit)
    return page if offset <= 0 or not page.isEmpty() else rows.orderBy("row_id").limit(limit)


def edge_score(domain) -> Column:
    """The plain score of neighbours found at the edge: 50 for ``.bd``, 30 for others."""
    return F.when(domain.endswith(".bd"), 50).otherwise(30)


def hotspot_summary(lead_ips: DataFrame, rdns: DataFrame) -> DataFrame:
    """Per address: known leads, hosts on it, and hosts that are new neighbours."""
    known = lead_ips.select("domain").distinct().withColumn("__lead", F.lit(1))
    hosts = lead_ips.select("ip").distinct().join(rdns, "ip").select("ip", registrable(F.col("host")).alias("domain"))
    hosts = hosts.join(known, "domain", "left")
    per = hosts.groupBy("ip").agg(
        F.count(F.lit(1)).alias("cohosted"),
        F.countDistinct(F.when(F.col("__lead").isNull() & ~provider(F.col("domain")), F.col("domain"))).alias("new"))
    leads = lead_ips.groupBy("ip").agg(F.countDistinct("domain").alias("leads"))
    return leads.join(per, "ip", "left").na.fill(0, ["cohosted", "new"])


def sweep_addresses(cidrs: DataFrame, index: str, total: int, cursor: int, take: int) -> DataFrame:
    """One sample address per block for ``take`` blocks from ``cursor``, wrapping round; the last octet turns with the position."""
    parts = F.split(F.substring_index("cidr", "/", 1), r"\.")
    place = F.pmod(F.col(index) - cursor, F.lit(total))
    last = 1 + F.pmod(F.lit(cursor) + place, F.lit(3)) * 5
    rows = cidrs.where(F.col("cidr").rlike(r"^\d+\.\d+\.\d+\.\d+/\d+$")).where(place < take)
    return rows.select("cidr", F.concat_ws(".", F.slice(parts, 1, 3), last.cast("string")).alias("ip"))
