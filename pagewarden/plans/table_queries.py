"""Queries over the relational tables: state, queue, dashboard, roll-ups and fusion.

The business tables stand in for the audit's own (orders for batches and
findings, customers for domains, line items for hosting), to show the shape of
each operator on rows with known answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cohost, dashboard, fusion, state, workqueue
from ..streaming import rollups
from .page_queries import table
from .registry import query

SIGNALS = [
    ("d1", 0, "homepage-content", "L1KW_WEAK", "poker", "https://d1/"),
    ("d2", 0, "homepage-content", "L1KW_STRONG", "judi online", "https://d2/"),
    ("d3", 0, "cloak-diff", "L2UACLOAK", "viagra", "https://d3/"),
    ("d4", 0, "content-enum", "L11REST", "slug=x::y", "https://d4/x"),
    ("d5", 0, "deface", "L10DEFACE", "hacked by", "https://d5/"),
    ("d6", 0, "homepage-content", "L1KW_WEAK", "casino", "https://d6/"), ("d6", 1, "sitemap-doorway", "L11SITEMAP", "u", "https://d6/u"),
    ("d7", 0, "homepage-content", "L1KW_WEAK", "casino", "https://d7/"), ("d7", 1, "cloak-diff", "L2UACLOAK", "x", "https://d7/"),
    ("d8", 0, "homepage-content", "L1KW_STRONG", "maxwin", "https://d8/"), ("d8", 1, "redirect", "L20RELAY", "h", "https://d8/"),
    ("d9", 0, "content-enum", "L11REST", "a", "https://d9/a"), ("d9", 1, "content-enum", "L20MASS_CAND", "b", "https://d9/b"),
    ("d9", 2, "sitemap-doorway", "L11SITEMAP", "c", "https://d9/c"),
]
SIGNAL_VALUES = ", ".join(f"('{d}', {o}, '{b}', '{la}')" for d, o, b, la, _, _ in SIGNALS)
USED = ("L1KW_WEAK", "L1KW_STRONG", "L2UACLOAK", "L11REST", "L10DEFACE", "L11SITEMAP", "L20RELAY", "L20MASS_CAND")


def _weight_case() -> str:
    w = fusion.P.WEIGHTS
    pairs = {x: w["L20MASS" if x == "L20MASS_CAND" else x] for x in USED}
    return "CASE layer " + " ".join(f"WHEN '{x}' THEN {d}::DOUBLE / {f}" for x, (d, f) in pairs.items()) + " END"


@query("signal_fusion", f"""
    WITH s(domain, ord, bucket, layer) AS (VALUES {SIGNAL_VALUES}),
         b AS (SELECT domain, bucket, max({_weight_case()}) AS ratio FROM s GROUP BY ALL),
         p AS (SELECT domain, count(*) AS nbuckets, 1 / (1 + exp(-(ln(0.12 / 0.88) + sum(ln(ratio))))) AS posterior FROM b GROUP BY 1)
    SELECT domain, nbuckets::INT AS nbuckets, round(posterior, 4) AS posterior,
           CASE WHEN domain IN (SELECT domain FROM s WHERE layer = 'L10DEFACE') OR (posterior >= 0.97 AND nbuckets >= 2)
                THEN 'CONFIRM_CANDIDATE' ELSE 'SUSPECT' END AS verdict FROM p""")
def signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SIGNALS, "domain string, ord int, bucket string, layer string, match string, url string")
    return fusion.score(rows).select("domain", "nbuckets", "posterior", "verdict")


@query("hourly_rollup", """
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.hourly(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("daily_rollup_local", """
    SELECT strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_rollup_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.local_daily(table(spark, sf_dir, "events"))
    return rows.select(X.local_day(F.col("start")).alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("local_hours", "SELECT strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d-%H') AS hour, count(*) AS n FROM events GROUP BY 1")
def local_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(X.local_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


KINDS = ("signup", "error", "click", "view", "purchase")


@query("category_pivot", "SELECT count(*) AS flagged, count_if(value >= 50) AS confirmed, " + ", ".join(
    f"count_if(value >= 50 AND event_type = '{k}') AS {k}" for k in KINDS) + " FROM events")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("value") >= 50).cast("int").alias("confirmed"), F.col("event_type").alias("category"))
    return state.ingest_rollup(rows, KINDS).drop("scanned", "errors")


@query("latest_per_user", """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("first_wins_dedup", """
    SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY 2""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return state.first_wins(rows, ["text_md5"], ["doc_id"])


@query("new_vs_existing", """
    WITH old AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), pay AS (SELECT DISTINCT o_custkey AS k FROM orders)
    SELECT count(*) AS found, count_if(old.k IS NULL) AS inserted, count_if(old.k IS NOT NULL) AS dups FROM pay LEFT JOIN old USING (k)""")
def new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("domain"))
    return state.insert_counts(orders.where("o_orderkey % 3 = 0"), orders, ["domain"])


@query("insert_or_ignore", """
    WITH old AS (SELECT o_custkey AS k, min(o_orderkey) AS ord FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
         new AS (SELECT o_custkey AS k, min(o_orderkey) AS ord FROM orders GROUP BY 1)
    SELECT k, ord FROM old UNION ALL SELECT k, ord FROM new WHERE k NOT IN (SELECT k FROM old)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"))
    old = state.first_wins(orders.where("ord % 3 = 0"), ["k"], ["ord"])
    return state.insert_ignore(old, orders, ["k"], ["ord"])


@query("upsert_accumulate", """
    SELECT o_orderstatus AS source, sum(o_totalprice::DECIMAL(18,2)) AS total, arg_max(o_orderkey, (o_orderkey % 2, o_orderkey)) AS last_key
    FROM orders GROUP BY 1""")
def upsert_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("source"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderkey").alias("last_key"))
    total = lambda r: r.groupBy("source").agg(F.sum("total").alias("total"), F.max("last_key").alias("last_key"))
    return state.accumulate(total(rows.where("last_key % 2 = 0")), total(rows.where("last_key % 2 = 1")), ["source"], ["total"], ["last_key"], "last_key")


@query("batch_assignment", """
    WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS c FROM customer)
    SELECT c_custkey AS row_id, ((rn - 1) // 100 + 7)::BIGINT AS batch_id FROM n WHERE rn <= (c // 100) * 100""")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.lit(None).cast("long").alias("batch_id"), F.lit(1000).cast("long").alias("added_ts"))
    return workqueue.assign_batches(rows, now=1100, next_id=7, size=100, most=1_000_000).select("row_id", "batch_id")


@query("shard_slice", """
    SELECT c_custkey AS row_id FROM customer WHERE c_custkey % 8 = 3 ORDER BY c_nationkey DESC, c_custkey LIMIT 40""")
def shard_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("bd_score"), F.lit(0).alias("pass_no"))
    return workqueue.scan_slice(rows, 8, 3, 40).select("row_id")


@query("rotating_slice", "SELECT n_nationkey FROM nation WHERE (n_nationkey - 20 + 25) % 25 < 10")
def rotating_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.rotating_slice(table(spark, sf_dir, "nation"), "n_nationkey", 25, 20, 10).select("n_nationkey")


@query("claim_next", "SELECT min(o_orderkey) AS batch_id FROM orders WHERE o_orderstatus = 'P'")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "ready").otherwise("done")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), status.alias("status"), F.lit(0).alias("claimed_ts"))
    return workqueue.claimable(rows, now=5000)


@query("queue_status", "SELECT o_orderstatus AS status, count(*) AS batches, coalesce(sum(o_custkey), 0)::BIGINT AS domains FROM orders GROUP BY 1")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("domain_count"))
    return dashboard.queue_status(rows)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("domain"), F.col("o_orderpriority").alias("category"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), (F.col("o_orderkey") % 2).cast("int").alias("is_bd"),
        F.when(F.col("o_orderkey") % 7 == 0, "rejected").when(F.col("o_orderkey") % 5 == 0, None).otherwise("lead").alias("status"),
        (F.col("o_totalprice") > 100000).cast("int").alias("confirmed"), F.when(F.col("o_orderkey") % 11 == 0, 1).alias("is_manual"),
        F.col("o_orderstatus").alias("biz_type"))


FINDINGS_SQL = """
    SELECT o_orderkey AS id, o_custkey::VARCHAR AS domain, o_orderpriority AS category, epoch(o_orderdate)::BIGINT AS ts, (o_orderkey % 2)::INT AS is_bd,
           CASE WHEN o_orderkey % 7 = 0 THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'lead' END AS status,
           (o_totalprice > 100000)::INT AS confirmed, CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS is_manual, o_orderstatus AS biz_type FROM orders"""


@query("leads_page", f"""
    SELECT id, domain, category, confirmed, ts, is_bd, biz_type, status, is_manual FROM ({FINDINGS_SQL})
    WHERE status != 'rejected' AND coalesce(is_manual, 0) = 0 AND confirmed = 1 AND is_bd = 1 ORDER BY ts DESC, id DESC LIMIT 150 OFFSET 50""")
def leads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.leads(_findings(spark, sf_dir), region="bd", limit=150, offset=50)


@query("category_counts", f"SELECT category, count(*) AS c FROM ({FINDINGS_SQL}) WHERE confirmed = 1 GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.category_counts(_findings(spark, sf_dir))


@query("lead_regions", f"""
    SELECT CASE WHEN is_bd = 1 THEN 'bd' ELSE 'intl' END AS region, count(*) AS c FROM ({FINDINGS_SQL})
    WHERE confirmed = 1 AND status != 'rejected' GROUP BY 1""")
def lead_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.lead_regions(_findings(spark, sf_dir))


@query("replace_findings", f"""
    WITH f AS ({FINDINGS_SQL}), d AS (SELECT * FROM f WHERE id % 4 = 0),
         l AS (SELECT domain, arg_max(id, (ts, id)) AS id FROM d GROUP BY 1)
    SELECT domain, id FROM f WHERE id % 4 <> 0 AND domain NOT IN (SELECT domain FROM d) UNION ALL SELECT domain, id FROM l""")
def replace_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).select("domain", "id", "ts")
    return state.replace_rows(rows.where("id % 4 != 0"), rows.where("id % 4 = 0"), ["domain"], ["ts", "id"]).select("domain", "id")


LEADS = "l_partkey % 10 = 0"


@query("cohost_neighbours", f"""
    WITH lead AS (SELECT DISTINCT l_partkey FROM lineitem WHERE {LEADS}),
         hot AS (SELECT l_suppkey AS ip, count(DISTINCT l_partkey) AS leads FROM lineitem WHERE {LEADS} GROUP BY 1 ORDER BY leads DESC, ip LIMIT 20)
    SELECT l_partkey AS domain, count(DISTINCT l_suppkey) AS ips FROM lineitem JOIN hot ON l_suppkey = ip
    WHERE l_partkey NOT IN (SELECT l_partkey FROM lead) GROUP BY 1""")
def cohost_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as servers, parts as sites: neighbours of the densest servers."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ip"), F.col("l_partkey").alias("domain"))
    leads = items.where("domain % 10 = 0")
    hot = cohost.hotspots(leads, n=20)
    near = items.join(hot.select("ip"), "ip").join(leads.select("domain").distinct(), "domain", "left_anti")
    return near.groupBy("domain").agg(F.countDistinct("ip").alias("ips"))


@query("hotspot_ranking", """
    SELECT l_suppkey AS ip, count(DISTINCT l_partkey) AS leads FROM lineitem GROUP BY 1 ORDER BY leads DESC, ip LIMIT 20""")
def hotspot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return cohost.hotspots(items.select(F.col("l_suppkey").alias("ip"), F.col("l_partkey").alias("domain")), n=20)


@query("verdict_join", """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'heuristic' WHEN l.toxic = 1 THEN 'reject' ELSE 'keep' END AS decision
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels) l USING (doc_id)""")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    said = F.when(F.col("toxic").isNull(), "heuristic").when(F.col("toxic") == 1, "reject").otherwise("keep")
    return rows.select("doc_id", said.alias("decision"))


@query("event_log_tail", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id >= (SELECT coalesce(max(event_id), 0) - 2000 FROM events)")
def event_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.trim_log(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))


@query("event_feed", "SELECT event_type AS kind, user_id AS domain, value AS detail, ts FROM events ORDER BY event_id DESC LIMIT 60")
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("domain"), F.col("value").alias("detail"), "ts")
    return dashboard.feed(rows)


@query("latest_days", """
    WITH d AS (SELECT strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT * FROM d ORDER BY day DESC LIMIT 21""")
def latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(X.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.latest(days, "day", 21)


@query("sweep_addresses", """
    SELECT (10 + n_nationkey) || '.1.2.0/24' AS cidr, (10 + n_nationkey) || '.1.2.' || (1 + ((4 + (n_nationkey - 4 + 25) % 25) % 3) * 5) AS ip
    FROM nation WHERE (n_nationkey - 4 + 25) % 25 < 6""")
def sweep_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cidrs = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat((F.lit(10) + F.col("n_nationkey")).cast("string"), F.lit(".1.2.0/24")).alias("cidr"))
    return cohost.sweep_addresses(cidrs, "n_nationkey", 25, 4, 6)


@query("stream_hourly", """
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly roll-up as a stream that processes what is there, read back from its sink.

    Files of a table come in any order of time, so there is no watermark: it
    would drop rows from the third batch on.
    """
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    folder = f"{shared.rstrip('/')}/stream-hourly-{spark.range(1).select(F.uuid()).first()[0]}"
    path = f"{sf_dir}/events.parquet"
    events = rollups.open_stream(spark, path, spark.read.parquet(path).schema)
    rollups.run_rollup(rollups.hourly(events, delay=None, value=None), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = rollups.read_rollup(spark, f"{folder}/out", ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
