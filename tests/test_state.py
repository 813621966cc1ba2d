import pytest
from pyspark.sql import functions as F

from pagewarden.operators import cohost, dashboard, state, verdicts, workqueue
from pagewarden.sources import parsers


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_insert_ignore_and_counts(spark):
    old = rows(spark, [("a", 1)], "k string, v int")
    new = rows(spark, [("a", 2), ("b", 3), ("b", 4), (None, 5)], "k string, v int")
    once = state.insert_ignore(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, state.insert_ignore(once, new, ["k"], ["v"]).collect())) == [("a", 1), ("b", 3)]
    assert tuple(state.insert_counts(old, new, ["k"]).first()) == (2, 1, 1)


def test_upserts(spark):
    a = rows(spark, [("x", 1, 5)], "k string, n int, t int")
    b = rows(spark, [("x", 2, 7), ("y", 1, 1)], "k string, n int, t int")
    got = {r["k"]: (r["n"], r["t"]) for r in state.accumulate(a, b, ["k"], ["n"], ["t"], "t").collect()}
    assert got == {"x": (3, 7), "y": (1, 1)}
    f = rows(spark, [("d", 1, 1, None), ("d", 2, 2, 1), ("e", 3, 3, None)], "domain string, id int, ts int, is_manual int")
    n = rows(spark, [("d", 9, 9, 1), ("d", 8, 8, 1)], "domain string, id int, ts int, is_manual int")
    assert sorted(r["id"] for r in state.replace_findings(f, n).collect()) == [3, 9]
    assert sorted(r["id"] for r in state.replace_manual(f, n).collect()) == [1, 3, 9]
    assert state.append_findings(f, n).count() == 5


def test_updates(spark):
    f = rows(spark, [(1, "a.com", None, None, "", 1, None), (2, "b.com", None, None, "1", 0, None)],
             "id int, domain string, address string, district string, phone string, confirmed int, ip string")
    c = rows(spark, [("a.com", "", "Dhaka", "017"), ("b.com", "x", "y", "z")], "domain string, address string, district string, phone string")
    got = {r["id"]: r for r in state.backfill_contacts(f, c).collect()}
    assert (got[1]["address"], got[1]["district"], got[1]["phone"]) == ("-", "Dhaka", "017") and got[2]["address"] is None and got[2]["phone"] == "1"
    pairs = rows(spark, [(1, "https://A.com/", "192.0.2.1"), (2, "a.com", "192.0.2.2"), (3, "b.com", "no ip")], "ord int, domain string, ip string")
    assert {r["id"]: r["ip"] for r in state.store_addresses(f, pairs).collect()} == {1: "192.0.2.2", 2: None}
    log = spark.range(2500).withColumnRenamed("id", "id")
    assert state.trim_log(log).count() == 2001
    assert state.trim_log(spark.range(0)).count() == 0


@pytest.mark.parametrize("pending, age, want", [(0, 0, {}), (999, 100, {}), (999, 601, {5: 999}), (1000, 0, {5: 1000}), (1001, 600, {5: 1000}), (2500, 601, {5: 1000, 6: 1000, 7: 500})])
def test_batches(spark, pending, age, want):
    domains = spark.range(pending).select((F.col("id") * 3).alias("row_id"), F.lit(None).cast("long").alias("batch_id"), F.lit(10_000 - age).alias("added_ts"))
    got = workqueue.assign_batches(domains, 10_000, 5)
    assert {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()} == want
    if want:
        spans = got.groupBy("batch_id").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).orderBy("batch_id").collect()
        assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_queue(spark):
    b = rows(spark, [(3, "done", 0), (5, "claimed", 8199), (4, "claimed", 8200), (6, "claimed", 8201)], "batch_id int, status string, claimed_ts int")
    assert workqueue.claimable(b, 10_000).first()[0] == 5
    more = b.unionByName(rows(spark, [(9, "ready", 0)], "batch_id int, status string, claimed_ts int"))
    assert workqueue.claimable(more, 10_000).first()[0] == 9
    again = workqueue.requeue_stale(b.withColumn("claimed_by", F.lit("w")), 10_000)
    assert {r["batch_id"] for r in again.where("status = 'ready'").collect()} == {5}
    ids = spark.range(100).withColumnRenamed("id", "row_id")
    parts = [workqueue.shard(ids, 7, k) for k in range(7)]
    assert sum(p.count() for p in parts) == 100 and state.merge_results(parts).distinct().count() == 100
    index = spark.range(10).withColumnRenamed("id", "i")
    assert sorted(r["i"] for r in workqueue.rotating_slice(index, "i", 10, 8, 4).collect()) == [0, 1, 8, 9]
    assert workqueue.next_offset(8, 4, 10) == 2


def test_views(spark):
    f = rows(spark, [(1, 5, "lead", 1, 1, None), (2, 5, "lead", 1, 0, 0), (3, 9, None, 1, 1, None), (4, 9, "rejected", 1, 1, None), (5, 7, "lead", 0, 1, None), (6, 1, "lead", 1, 1, 1)],
             "id int, ts int, status string, confirmed int, is_bd int, is_manual int")
    f = f.withColumns({"category": F.lit("x"), "biz_type": F.lit("it"), "domain": F.lit("d")})
    ids = lambda **k: [r["id"] for r in dashboard.leads(f, **k).collect()]
    assert ids() == [2, 1] and ids(region="bd") == [1] and ids(confirmed=False) == [5, 2, 1] and ids(manual=True) == [6] and ids(limit=1, offset=1) == [1]
    assert {r["region"]: r["c"] for r in dashboard.lead_regions(f).collect()} == {"bd": 2, "intl": 1}
    w = rows(spark, [("a", 9_101), ("b", 9_100), ("c", 9_099)], "worker_id string, last_seen int")
    assert [r["worker_id"] for r in dashboard.live_workers(w, 10_000).collect()] == ["a"]


def test_cohost(spark):
    lead = rows(spark, [("a.com",), ("b.com",), ("c.com",)], "domain string")
    dns = rows(spark, [("a.com", "192.0.2.1"), ("b.com", "192.0.2.1"), ("c.com", "104.21.0.1")], "domain string, ip string")
    ips = cohost.resolve(lead, dns)
    assert ips.count() == 2 and {r["ip"] for r in cohost.resolve(lead, dns, keep_cdn=True).collect()} == {"192.0.2.1", "cdn"}
    rdns = rows(spark, [("192.0.2.1", h) for h in ("a.com", "www.n.com.bd", "x.n.com.bd", "godaddy.com", "mm.net")], "ip string, host string")
    assert {(r["domain"], r["bd_score"]) for r in cohost.neighbours(ips, rdns, lead).collect()} == {("n.com.bd", 65), ("mm.net", 25)}
    assert tuple(cohost.hotspots(ips).first()) == ("192.0.2.1", 2)
    assert cohost.hotspots(ips, rows(spark, [("192.0.2.1",)], "ip string")).count() == 1  # all done: start over
    assert tuple(cohost.hotspot_summary(ips, rdns).first()) == ("192.0.2.1", 2, 5, 2)


def test_recheck(spark):
    f = rows(spark, [(1, "x-casino.com", "L1KW_WEAK"), (2, "a.com", "L1KW_WEAK"), (3, "b.com", "L2UACLOAK"), (4, "c.com", ""), (5, "d.com", "")], "id int, domain string, layers string")
    f = f.withColumn("confirmed", F.lit(1))
    cap = rows(spark, [(d, "<title>t</title>body") for d in ("x-casino.com", "a.com", "b.com", "d.com")], "domain string, text string")
    v = rows(spark, [("a.com", "false_positive", "general", 0.5, "r"), ("b.com", "false_positive", "it", 0.5, "r"), ("d.com", "genuine_spam", "", 1.0, "r")],
             "domain string, classification string, business_type string, confidence double, reason string")
    got = {r["id"]: r["decision"] for r in verdicts.recheck(f, cap, v).collect()}
    assert got == {1: "reject", 2: "reject", 3: "keep", 4: "keep", 5: "reject"}


def test_sources(spark):
    ct = rows(spark, [("*.a.com.bd\nbb.com", "www.a.com.bd"), (None, None)], "name_value string, common_name string")
    assert {r["domain"] for r in parsers.certificate_names(ct).collect()} == {"a.com.bd", "bb.com"}
    lines = rows(spark, [('{"url":"https://x.a.bd/1"}',), ("bad",), ('{"url":"https://bb.org/"}',)], "value string")
    assert [r["domain"] for r in parsers.crawl_index_lines(lines).collect()] == ["a.bd", "bb.org"]
    index = rows(spark, [("i", "<loc>https://s/at_dir-1.xml</loc><loc> https://s/o.xml </loc>"), ("j", "<loc>https://s/flat</loc>")], "url string, text string")
    maps = rows(spark, [("https://s/at_dir-1.xml", "<loc>https://s/p?a=1&amp;b=2</loc>")], "url string, text string")
    assert {tuple(r) for r in parsers.expand_index(index, maps, "at_dir").collect()} == {("i", "https://s/p?a=1&b=2"), ("j", "https://s/flat")}
    pages = rows(spark, [("u1", '<title>Shop | Dir</title><a href="https://dir.com/x">d</a> Website: www.shop.com.bd <a href="https://facebook.com/s">f</a>'), ("u2", "x")], "url string, text string")
    assert [tuple(r) for r in parsers.listing_rows(pages, "dir.com").select("domain", "business").collect()] == [("shop.com.bd", "Shop")]
    el = spark.createDataFrame([(1, {"contact:website": "http://mm.org", "name": "M"}), (2, {"website": "mm.org", "name": "N"}), (3, {"name": "x"})], "ord int, tags map<string,string>")
    assert [tuple(r) for r in parsers.map_elements(el).collect()] == [("mm.org", "M")]
    text = rows(spark, [("API count exceeded",), ("a.com\n b c\nb.org",), ("<td>Q.example.net</td>",)], "t string")
    got = [r[0] for r in text.select(parsers.hosts_in_lines(F.col("t"))).collect()]
    assert got[0] is None and got[1] == ["a.com", "b.org"]
    assert text.select(parsers.hosts_in_html(F.col("t"))).collect()[2][0] == ["q.example.net"]
    part, nxt = parsers.ranked_list(rows(spark, [(i, f"d{i}.com") for i in range(5)], "idx int, domain string"), 3, 4)
    assert part.count() == 2 and nxt.first()[0] == 0
    pay = rows(spark, [(1, None, "www.P.com", None, "b", None, "7"), (2, "p.com", None, None, "c", None, None), (3, "bad", None, None, None, None, None)],
               "ord int, domain string, host string, url string, business string, phone string, bd_score string")
    assert [(r["domain"], r["business"], r["bd_score"]) for r in parsers.harvest_rows(pay, "s", 1).collect()] == [("p.com", "b", 7)]
    caps = rows(spark, [("d", "browser", "http", 200), ("d", "browser", "https", 0)], "domain string, variant string, scheme string, status int")
    assert parsers.either_scheme(caps).first()["scheme"] == "http"
