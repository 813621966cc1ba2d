import pytest

from pagewarden.operators import signals
from pagewarden.plans.audit import audit

SCHEMA = "domain string, variant string, seq int, status int, final_url string, headers map<string,string>, text string"


def page(domain, browser, bot=None, referer=None, mobile=None, url=None, **more):
    rows = []
    for v, t in (("browser", browser), ("bot", bot), ("referer", referer), ("mobile", mobile)):
        if t is not None:
            rows.append((domain, v, 0, 200, more.get(f"{v}_url", url or f"https://{domain}/"), more.get("headers") if v == "bot" else None, t))
    return rows


HEX = "\\x41" * 12
ANCHORS = "".join(f'<a href="https://s{i}.example.net/">x</a>' for i in range(5))
ROWS = (
    page("clean.example.org", "<p>hello</p>") + page("strong.example.org", "play judi online now") + page("script.example.org", "<script>judi online</script>ok")
    + page("cloak.example.org", "hi", bot="togel maxwin", referer="bocoran")
    + page("redir.example.org", "hi", url="https://other.example.com/") + page("sub.example.org", "hi", url="https://www.sub.example.org/x")
    + page("foreign.example.org", "<title>こんにちは</title>") + page("deface.example.org", "HACKED BY someone")
    + page("ob3.example.org", "eval(atob('x'))") + page("ob5.example.org", f"eval( unescape('x')) {HEX}") + page("ob2.example.org", HEX)
    + page("frame.example.org", '<iframe width=1 src="https://best-casino.example.net/a"></iframe>')
    + page("hidden.example.org", f'<div style="display:none">{ANCHORS}</div>') + page("hid4.example.org", f'<div style="display:none">{ANCHORS[: ANCHORS.rindex("<a")]}</div>')
    + page("allowed.example.org", '<div class="sr-only" style="display:none">judi online</div>', bot="x")
    + page("relay.example.org", "hi", bot='<link rel="canonical" href="https://bad.example.net/"><link rel="canonical" href="https://cdn.jsdelivr.net/">')
    + page("waf.example.org", "Just a moment...") + page("header.example.org", "hi", bot="x", headers={"Location": "https://win.example.top/"})
    + [("dead.example.org", "browser", 0, 0, None, None, None)]
)


@pytest.fixture(scope="module")
def found(spark):
    got, context = signals.scan(spark.createDataFrame(ROWS, SCHEMA))
    out = {}
    for r in got.orderBy("domain", "ord").collect():
        out.setdefault(r["domain"], {})[r["layer"]] = r["match"]
    return out


def test_page_layers(found):
    assert "clean.example.org" not in found and "script.example.org" not in found and "dead.example.org" not in found
    assert found["strong.example.org"] == {"L1KW_STRONG": "judi"}
    assert found["cloak.example.org"] == {"L2UACLOAK": "maxwin;togel", "L3REFCLOAK": "bocoran"}
    assert found["redir.example.org"]["L9REDIR"] == "other.example.com" and "sub.example.org" not in found
    assert "L10LANG" in found["foreign.example.org"] and found["deface.example.org"] == {"L10DEFACE": "hacked by"}
    assert "ob3.example.org" not in found and "ob2.example.org" not in found
    assert found["ob5.example.org"]["L14OBFUS"] == "score=5:eval-decoder,hexrun"
    assert found["frame.example.org"]["L8IFRAME"] == "https://best-casino.example.net/a"
    assert found["hidden.example.org"]["L17HIDDEN"].startswith("hidden[5-offdomain-anchors]") and "hid4.example.org" not in found
    assert "L17HIDDEN" not in found.get("allowed.example.org", {})
    assert found["relay.example.org"] == {"L20RELAY": "bad.example.net"}
    assert found["waf.example.org"] == {"L18CHALLENGE": "Just a moment..."}
    assert found["header.example.org"] == {"L16HDR": "https://win.example.top/"}


ITEM = '{{"slug":"{}","title":{},"link":"l{}"}}'


def test_items_sitemaps_feeds_and_search(spark):
    listing = "[" + ",".join(ITEM.format("ok" if k > 1 else "situs-judi", '{"rendered":"a &amp; b"}' if k % 2 else '"plain"', k) for k in range(4)) + "]"
    foreign = "[" + ",".join(ITEM.format(f"s{k}", '"カジノ"' if k < 4 else '"text"', k) for k in range(14)) + "]"
    maps = lambda d, n, m: "".join(f"<loc>https://{d}/abcdef{0}/{k}.html</loc>".replace("abcdef0", "abcdefg") for k in range(n)) + "".join(
        f"<loc>https://{d}/dir/bcdfghjk{chr(98 + k % 3)}{'c' * (k + 1)}</loc>" for k in range(m))
    rows = page("a.example.org", "hi") + page("b.example.org", "hi") + page("c.example.org", "judi online") + page("d.example.org", "judi online")
    rows += [("a.example.org", "wp_posts", 1, 200, "u", {"x-wp-total": "300"}, listing), ("b.example.org", "wp_posts", 1, 200, "u", {"x-wp-total": "299"}, foreign)]
    rows += [("b.example.org", "wp_posts", 2, 200, "u", None, '{"error":1}'), ("b.example.org", "wp_posts", 3, 200, "u", None, listing)]
    rows += [("c.example.org", "sitemap", 0, 200, "u", None, maps("c.example.org", 6, 0)), ("d.example.org", "sitemap", 0, 200, "u", None, maps("d.example.org", 5, 9))]
    rows += [("c.example.org", "feed", 0, 200, "f", None, "<title>judi online</title>"), ("a.example.org", "search", 0, 200, "u", None, "togel togel togel togel")]
    got, _ = signals.scan(spark.createDataFrame(rows, SCHEMA))
    out = {}
    for r in got.collect():
        out.setdefault(r["domain"], []).append((r["layer"], r["match"]))
    layers = {d: sorted(x for x, _ in v) for d, v in out.items()}
    assert layers["a.example.org"] == ["L11REST", "L20MASS_CAND", "L5DENSITY"]  # the slug repeats on the page: one signal
    assert "L20SCRIPT" in layers["b.example.org"] and "L20MASS_CAND" not in layers["b.example.org"]
    assert sum(x == "L11REST" for x in layers["b.example.org"]) == 4  # titles; the third page is behind a broken one
    assert layers["c.example.org"] == ["L16FEED", "L1KW_STRONG", "L20SHAPE"]
    assert layers["d.example.org"] == ["L1KW_STRONG"]


def test_audit_end_to_end(spark):
    captures = spark.createDataFrame(ROWS, SCHEMA)
    heuristic = {r["domain"]: r for r in audit(captures).collect()}
    assert heuristic["deface.example.org"]["status"] == "lead" and heuristic["deface.example.org"]["confirmed"] == 1
    assert "strong.example.org" not in heuristic  # open spam without identity
    verdicts = spark.createDataFrame(
        [("cloak.example.org", "hacked_client", "it", 0.9, "r"), ("deface.example.org", "false_positive", "", 0.5, "r")],
        "domain string, classification string, business_type string, confidence double, reason string")
    reviewed = {r["domain"]: r for r in audit(captures, reviewed=verdicts).collect()}
    assert reviewed["cloak.example.org"]["status"] == "lead" and reviewed["cloak.example.org"]["biz_type"] == "it"
    assert "deface.example.org" not in reviewed and "frame.example.org" in reviewed


def test_elements_that_are_no_objects_are_passed_over(spark):
    rows = page("x.example.org", "hi") + [
        ("x.example.org", "wp_posts", 1, 200, "u", None, '[7,"text",null,{"slug":"a","title":{"rendered":"t &amp; u"}}]'),
        ("x.example.org", "wp_posts", 2, 200, "u", None, '[{"slug":"b","title":"plain"}]'), ("x.example.org", "wp_pages", 1, 200, "u", None, "[broken \"slug\"")]
    got = signals.wp_items(spark.createDataFrame(rows, SCHEMA)).orderBy("page").collect()
    assert [(r["page"], r["pos"], r["slug"], r["title"]) for r in got] == [(1, 3, "a", "t & u"), (2, 0, "b", "plain")]


def test_the_first_capture_of_a_variant_counts(spark):
    rows = [("x.org", "browser", 1, 200, "b", None, "second"), ("x.org", "browser", 0, 200, "a", None, "first")]
    for parts in (1, 2):
        assert signals.homepages(spark.createDataFrame(rows, SCHEMA).repartition(parts)).first()["browser"] == "first"
