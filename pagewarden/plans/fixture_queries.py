"""Queries over inline rows: every detection layer, the review, the sources and the smaller views.

The given tables hold no page that the signatures match, so these queries bring
their own rows, the cases of FIXTURES part A.  The SQL reads the same rows and
states each rule again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import patterns as P
from ..functions import text as X
from ..operators import cohost, dashboard, fusion, signals, state, verdicts, workqueue
from ..operators.classify import biz_type, category_of
from ..operators.contacts import extract_contacts
from ..sources import parsers
from .page_queries import _visible_sql
from .registry import query

SPACES = r"[\s\x0b]+"


class Rows:
    """Inline rows that Spark and SQL both read."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.fields = [part.strip().split(" ", 1) for part in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}

        def literal(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            if isinstance(v, dict):
                return "MAP {" + ", ".join(f"{literal(k)}: {literal(x)}" for k, x in v.items()) + "}"
            return str(v)

        names = ", ".join(n for n, _ in self.fields)
        casts = ", ".join(f"{n}::{kinds[k]} AS {n}" for n, k in self.fields)
        return f"(SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) AS v({names}))"


# ---------------------------------------------------------------- captures and layers


def page(domain, browser, bot=None, referer=None, mobile=None, url=None, mobile_url=None, headers=None) -> list[tuple]:
    home = url or f"https://{domain}/"
    rows = [(domain, "browser", 0, 200, home, None, browser)]
    rows += [(domain, "bot", 0, 200, home, headers, bot)] if bot is not None else []
    rows += [(domain, "referer", 0, 200, home, None, referer)] if referer is not None else []
    rows += [(domain, "mobile", 0, 200, mobile_url or home, None, mobile)] if mobile is not None else []
    return rows


def _anchors(n: int) -> str:
    return "".join(f'<a href="https://s{i}.example.net/">x</a>' for i in range(n))


def _items(*items: str) -> str:
    return "[" + ",".join(items) + "]"


def _item(slug: str, title: str, link: str = "l") -> str:
    return f'{{"slug":"{slug}","title":{title},"link":"{link}","date":"d"}}'


def _locs(domain: str, random: int, gibberish: int) -> str:
    rows = [f"<loc>https://{domain}/abcdefg/{k}.html</loc>" for k in range(random)]
    return "".join(rows + [f"<loc>https://{domain}/dir/bcdfghjk{'bcd'[k % 3]}{'c' * (k + 1)}</loc>" for k in range(gibberish)])


HEX = "\\x41" * 12
CAPTURES = Rows(
    "domain string, variant string, seq int, status int, final_url string, headers map<string,string>, text string",
    page("clean.example.org", "<title>Our Shop</title><p>hello</p>")
    + page("strong.example.org", "<p>play JUDI Online now, togel</p>") + page("script.example.org", "<script>judi online</script>ok")
    + page("weak.example.org", "<p>A Casino and poker night</p>")
    + page("cloak.example.org", "hi", bot="togel maxwin", referer="bocoran") + page("nocloak.example.org", "togel", bot="togel", referer="togel")
    + page("redir.example.org", "hi", url="https://other.example.com/") + page("sub.example.org", "hi", url="https://www.sub.example.org/x")
    + page("phone.example.org", "hi", mobile="hi", mobile_url="https://m.example.net/a")
    + page("foreign.example.org", "<title> こんにちは\n x</title>") + page("late.example.org", "no title", bot="<title>казино</title>")
    + page("deface.example.org", "HACKED BY someone", bot="greetz to all")
    + page("marker.example.org", "a <script>if(ndsw===undefined)</script>", bot="cdn-fileserver.com")
    + page("ob3.example.org", "eval(atob('x'))") + page("ob5.example.org", f"eval( unescape('x')) {HEX}") + page("ob2.example.org", HEX)
    + page("ob4.example.org", f"{HEX} document.write('<scr'+'ipt>')")
    + page("frame.example.org", '<iframe width=1 src="https://best-casino.example.net/a"></iframe><script src="http://x.net/slot.js"></script>')
    + page("hidden.example.org", f'<div style="display:none">{_anchors(5)}</div>') + page("hid4.example.org", f'<div style="display:none">{_anchors(4)}</div>')
    + page("hidword.example.org", '<span style="text-indent:-9999px">play  Gacor here</span>')
    + page("allowed.example.org", '<div class="x" style="display:none" data-a="sr-only">judi online</div>', bot="x")
    + page("relay.example.org", "hi", bot='<link rel="canonical" href="https://bad.example.net/"><link rel="alternate" href="https://cdn.jsdelivr.net/">')
    + page("waf.example.org", "<b>Just a moment...</b>")
    + page("header.example.org", "hi", bot="x", headers={"Location": "https://win.example.top/"})
    + page("refresh.example.org", "hi", bot="x", headers={"refresh": "0; url=https://judi.example.net/a"})
    + page("inside.example.org", "hi", bot="x", headers={"location": "https://inside.example.org/judi"})
    + [("dead.example.org", "browser", 0, 0, None, None, None)]
    # Post listings, sitemaps, feeds and search pages.
    + page("a.example.org", "hi") + page("b.example.org", "hi") + page("c.example.org", "judi online") + page("d.example.org", "judi online")
    + page("e.example.org", "hi")
    + [
        ("a.example.org", "wp_posts", 1, 200, "u", {"X-WP-Total": "300"}, _items(
            _item("situs-judi", '{"rendered":"a &amp; b"}', "l0"), _item("situs-judi", '"plain"', "l1"), "7", '"text"', _item("ok", '{"rendered":"Slot  gacor"}', "l2"))),
        ("a.example.org", "wp_pages", 1, 200, "u", None, _items(_item("situs-judi", '"again"', "p0"), _item("", '"togel today"', "p1"))),
        ("b.example.org", "wp_posts", 1, 200, "u", {"x-wp-total": "299"}, _items(*[_item(f"s{k}", '"カジノ"' if k < 4 else '"text"', f"l{k}") for k in range(14)])),
        ("b.example.org", "wp_posts", 2, 200, "u", None, '{"error":"slug"}'),
        ("b.example.org", "wp_posts", 3, 200, "u", None, _items(_item("bandar-togel", '"x"'))),
        ("e.example.org", "wp_posts", 1, 200, "u", {"x-wp-total": "10"}, _items(*[_item(f"s{k}", '"ニュース"' if k < 3 else '"text"') for k in range(14)])),
        ("c.example.org", "sitemap", 0, 200, "u", None, _locs("c.example.org", 6, 0)),
        ("d.example.org", "sitemap", 0, 200, "u", None, _locs("d.example.org", 5, 9)),
        ("deface.example.org", "sitemap", 0, 200, "u", None, _locs("deface.example.org", 0, 10) + "".join(
            f"<loc>https://deface.example.org/togel-{k}</loc>" for k in range(4)) + "<loc>https://deface.example.org/togel.xml</loc><loc>https://x.net/togel</loc>"),
        ("c.example.org", "feed", 0, 200, "f0", None, "<title>nothing</title>"),
        ("c.example.org", "feed", 1, 200, "f1", None, "<title>Judi Online</title><item>togel</item><description>maxwin</description>"),
        ("a.example.org", "search", 0, 200, "u", None, "togel <b>togel</b> togel togel"), ("e.example.org", "search", 0, 200, "u", None, "togel togel togel"),
    ],
)

#: One row per reachable domain, as in the operator.
HOME_SQL = f"""
    c AS (SELECT * FROM {CAPTURES.sql}),
    h0 AS (SELECT domain, {', '.join(f"coalesce(max(text) FILTER (variant = '{v}'), '') AS {v}, coalesce(max(final_url) FILTER (variant = '{v}'), '') AS {v}_url" for v in signals.HOME_VARIANTS)},
                  max(status) FILTER (variant = 'browser') AS http_status, arg_max(headers, seq) FILTER (variant = 'bot') AS headers
           FROM c WHERE variant IN ('browser', 'bot', 'referer', 'mobile') GROUP BY 1),
    h AS (SELECT *, domain AS reg, 'https://' || domain || '/' AS root, {_visible_sql('browser')} AS vb, {_visible_sql('bot')} AS vt, {_visible_sql('referer')} AS vr,
                 browser || bot AS pair FROM h0 WHERE http_status <> 0)"""  # fmt: skip


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _words(text: str, pattern: str = P.ALL_STRONG) -> str:
    """Sorted distinct lower-cased matches."""
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({text}, {_quoted('(?i)' + pattern)}), lambda x: lower(x))))"


def _host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({url}), '^[a-z]+://', ''), '/.*$', '', 's'), ':.*$', '', 's')"


def _off(host: str) -> str:
    return f"{host} <> '' AND {host} <> reg AND NOT ends_with({host}, '.' || reg)"


def _title(text: str) -> str:
    return rf"substr(trim(regexp_replace(regexp_extract({text}, '<title[^>]*>(.*?)</title>', 1, 'is'), '{SPACES}', ' ', 'g')), 1, 120)"


def _page_layer(layer: str, match: str, when: str, url: str = "root", more: str = "") -> None:
    """Register one layer of the home page: (domain, bucket, match, url)."""
    bucket = BUCKETS[layer]
    sql = f"WITH {HOME_SQL}{more} SELECT domain, '{bucket}' AS bucket, substr({match}, 1, 200) AS match, {url} AS url FROM h WHERE {when}"

    @query(f"layer_{layer.lower()}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = signals.page_signals(signals.homepages(CAPTURES.df(spark)))
        each = rows.select("domain", F.explode(F.array_compact(F.concat("found", F.array("header")))).alias("s")).select("domain", "s.*")
        return each.where(F.col("layer") == layer).select("domain", "bucket", "match", "url")


BUCKETS = {
    "L18CHALLENGE": "control", "L1KW_STRONG": "homepage-content", "L1KW_WEAK": "homepage-content", "L2UACLOAK": "cloak-diff", "L3REFCLOAK": "cloak-diff",
    "L4MOBILE": "redirect", "L9REDIR": "redirect", "L10LANG": "homepage-content", "L10DEFACE": "deface", "L14CAMPAIGN": "malware-js",
    "L14OBFUS": "malware-js", "L8IFRAME": "malware-js", "L17HIDDEN": "homepage-content", "L20RELAY": "redirect", "L16HDR": "redirect",
}
_join = lambda words: f"array_to_string({words}, ';')"
_except = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
_WAF = f"regexp_extract(browser, {_quoted('(?i)' + P.RX_WAF)})"
_page_layer("L18CHALLENGE", _WAF, f"{_WAF} <> ''")
_page_layer("L1KW_STRONG", _join(_words("vb")), f"len({_words('vb')}) > 0")
_page_layer("L1KW_WEAK", _join(_words("vb", P.ALL_WEAK)), f"len({_words('vb', P.ALL_WEAK)}) > 0")
for _layer, _text in (("L2UACLOAK", "vt"), ("L3REFCLOAK", "vr")):
    _only = _except(_words(_text), _words("vb"))
    _page_layer(_layer, _join(_only), f"len({_only}) > 0")
_page_layer("L4MOBILE", _host("mobile_url"), _off(_host("mobile_url")), "mobile_url")
_page_layer("L9REDIR", _host("browser_url"), _off(_host("browser_url")), "browser_url")
_TITLE = f"CASE WHEN {_title('browser')} <> '' THEN {_title('browser')} ELSE {_title('bot')} END"
_page_layer("L10LANG", _TITLE, f"regexp_matches({_TITLE}, '{P.FOREIGN}')")
_page_layer("L10DEFACE", _join(_words("pair", P.RX_DEFACE)), f"len({_words('pair', P.RX_DEFACE)}) > 0")
_page_layer("L14CAMPAIGN", _join(f"{_words('pair', P.RX_MALJS)}[1:3]"), f"len({_words('pair', P.RX_MALJS)}) > 0")
_MARKS = (
    r"list_filter([CASE WHEN regexp_matches(browser, 'eval\(\s*(atob|unescape|decodeURIComponent|String\.fromCharCode)', 'i') THEN 'eval-decoder' END, "
    r"CASE WHEN regexp_matches(browser, '(\\x[0-9a-fA-F]{2}){12,}') THEN 'hexrun' END, "
    r"CASE WHEN regexp_matches(browser, 'document\.write\([^)]{0,40}<scr', 'i') THEN 'docwrite-script' END, "
    r"CASE WHEN regexp_matches(browser, 'String\.fromCharCode\([0-9]+(,[0-9]+){8,}') THEN 'charcode-run' END], lambda x: x IS NOT NULL)"
)
_SCORE = f"(2 * len({_MARKS}) + list_contains({_MARKS}, 'eval-decoder')::INT)"
_page_layer("L14OBFUS", f"'score=' || {_SCORE} || ':' || array_to_string({_MARKS}, ',')", f"{_SCORE} >= 4")
_FRAMES = (
    f"list_sort(list_distinct(list_transform(regexp_extract_all(pair, {_quoted('(?i)' + signals.IFRAME)}), "
    "lambda m: regexp_extract(m, '(?i)https?://[^\"]+'))))"
)
_page_layer("L8IFRAME", _join(f"{_FRAMES}[1:2]"), f"len({_FRAMES}) > 0")
_RELAYS = (
    f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(bot, {_quoted('(?i)' + signals.RELAY)}, 1), lambda x: lower(x)), "
    f"lambda x: x <> '' AND x <> reg AND NOT ends_with(x, '.' || reg) AND NOT regexp_matches(x, '(?i){signals.RELAY_SKIP}'))))"
)
_page_layer("L20RELAY", _join(f"{_RELAYS}[1:2]"), f"len({_RELAYS}) > 0")
# Hidden blocks: one pattern for each tag stands for the back-reference; fixture pages have one block at most.
_TAGS = ("div", "span", "p", "section", "footer", "ul", "a")
_BLOCK = " UNION ALL ".join(
    rf"""SELECT domain, reg, root, regexp_extract(browser, '(?is)<{t}\b([^>]*style="[^"]*")[^>]*>(.*?)</{t}>', 0) AS b,
         regexp_extract(browser, '(?is)<{t}\b([^>]*style="[^"]*")[^>]*>(.*?)</{t}>', 1) AS style,
         regexp_extract(browser, '(?is)<{t}\b([^>]*style="[^"]*")[^>]*>(.*?)</{t}>', 2) AS inside FROM h""" for t in _TAGS)  # fmt: skip
_HIDDEN = rf""",
    b AS ({_BLOCK}),
    k AS (SELECT *, trim({_visible_sql('inside')}) AS words, coalesce(nullif(regexp_extract({_visible_sql('inside')}, {_quoted('(?i)' + P.ALL_STRONG)}), ''),
                 nullif(regexp_extract({_visible_sql('inside')}, {_quoted('(?i)' + P.RX_GAMB_WEAK)}), '')) AS word,
                 len(list_filter(regexp_extract_all(inside, '(?i)href="(https?://[^"]+)"', 1), lambda u: {_host('u')} <> reg AND NOT ends_with({_host('u')}, '.' || reg))) AS off
          FROM b WHERE b <> '' AND regexp_matches(style, '(?i){signals.HIDDEN_STYLE}') AND NOT regexp_matches(b, '(?i){signals.HIDDEN_ALLOWED}'))"""
query("layer_l17hidden", f"""
    WITH {HOME_SQL}{_HIDDEN}
    SELECT domain, 'homepage-content' AS bucket, substr('hidden[' || coalesce(word, off || '-offdomain-anchors') || ']: ' ||
           substr(CASE WHEN words <> '' THEN words ELSE b END, 1, 160), 1, 200) AS match, root AS url FROM k WHERE word IS NOT NULL OR off >= 5""")(
    lambda spark, sf_dir: signals.page_signals(signals.homepages(CAPTURES.df(spark))).select("domain", F.explode("found").alias("s")).select("domain", "s.*")
    .where("layer = 'L17HIDDEN'").select("domain", "bucket", "match", "url"))
_TARGET = "coalesce(nullif(regexp_extract(t, '(?i)https?://[^<\\s\"]+'), ''), t)"
query("layer_l16hdr", f"""
    WITH {HOME_SQL},
    t0 AS (SELECT *, coalesce(nullif(list_filter(map_entries(headers), lambda e: lower(e.key) = 'location')[1].value, ''),
                              nullif(list_filter(map_entries(headers), lambda e: lower(e.key) = 'refresh')[1].value, ''), '') AS t FROM h),
    t1 AS (SELECT *, {_TARGET} AS target, {_host(_TARGET)} AS away FROM t0)
    SELECT domain, 'redirect' AS bucket, substr(target, 1, 200) AS match, root AS url FROM t1
    WHERE {_off('away')} AND (regexp_matches(target, {_quoted('(?i)' + P.RX_GAMB_STRONG)}) OR regexp_matches(target, {_quoted('(?i)' + P.RX_JUNKTLD)}))""")(
    lambda spark, sf_dir: signals.page_signals(signals.homepages(CAPTURES.df(spark))).where("header IS NOT NULL").select("domain", "header.*")
    .select("domain", "bucket", "match", "url"))

# Post listings: JSON lists, up to the first page that is none.
ITEMS_SQL = rf"""
    c AS (SELECT * FROM {CAPTURES.sql}),
    w AS (SELECT domain, CASE variant WHEN 'wp_posts' THEN 'posts' ELSE 'pages' END AS type, seq AS page, text,
                 starts_with(trim(text), '[') AND json_valid(text) AND contains(text, '"slug"') AS good FROM c WHERE variant IN ('wp_posts', 'wp_pages')),
    o AS (SELECT * FROM w QUALIFY bool_and(good) OVER (PARTITION BY domain, type ORDER BY page) AND page <= CASE type WHEN 'posts' THEN 5 ELSE 1 END),
    j AS (SELECT domain, type, page, unnest(json_extract(text, '$[*]')) AS item, generate_subscripts(json_extract(text, '$[*]'), 1) - 1 AS pos FROM o),
    i AS (SELECT domain, type, page, pos, trim(coalesce(item->>'$.slug', '')) AS slug, trim(coalesce(item->>'$.link', '')) AS link,
                 replace(trim(regexp_replace(coalesce(CASE json_type(item->'$.title') WHEN 'OBJECT' THEN item->>'$.title.rendered' ELSE item->>'$.title' END, ''), '{SPACES}', ' ', 'g')),
                         '&amp;', '&') AS title
          FROM j WHERE json_type(item) = 'OBJECT'),
    n AS (SELECT domain, max(headers['x-wp-total'])::INT AS total FROM (
              SELECT domain, CASE WHEN cardinality(headers) > 0 THEN map_from_entries(list_transform(map_entries(headers), lambda e: {{'k': lower(e.key), 'v': e.value}})) END AS headers
              FROM c WHERE variant = 'wp_posts') GROUP BY 1)"""  # fmt: skip


@query("wp_items", f"WITH {ITEMS_SQL} SELECT domain, type, page, pos::INT AS pos, slug, title, link FROM i")
def wp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.wp_items(CAPTURES.df(spark))


def _enumerated(spark: SparkSession, layer: str) -> DataFrame:
    captures = CAPTURES.df(spark)
    rows = signals.enumeration_signals(signals.wp_items(captures), signals.wp_totals(captures))
    return rows.where(F.col("layer") == layer).select("domain", "bucket", "match", "url")


query("layer_l11rest", f"""
    WITH {ITEMS_SQL},
    s AS (SELECT *, coalesce(nullif(slug, ''), substr(title, 1, 40)) AS key FROM i
          WHERE (slug <> '' AND regexp_matches(slug, {_quoted('(?i)' + P.RX_SLUG_SPAM)})) OR (title <> '' AND regexp_matches(title, {_quoted('(?i)' + P.ALL_STRONG)}))),
    f AS (SELECT * FROM s WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY domain, type, page, key ORDER BY pos) = 1)
    SELECT domain, 'content-enum' AS bucket, substr('slug=' || substr(slug, 1, 60) || '::' || substr(title, 1, 90), 1, 200) AS match, substr(link, 1, 130) AS url FROM f""")(
    lambda spark, sf_dir: _enumerated(spark, "L11REST"))
query("layer_l20script", f"""
    WITH {ITEMS_SQL},
    f AS (SELECT domain, count_if(regexp_matches(title, '{P.FOREIGN}')) AS foreign_, count(*) AS total,
                 (list(substr(title, 1, 40) ORDER BY CASE type WHEN 'posts' THEN 0 ELSE 1 END, page, pos) FILTER (regexp_matches(title, '{P.FOREIGN}')))[1:3] AS s FROM i GROUP BY 1)
    SELECT domain, 'content-enum' AS bucket, 'foreign=' || foreign_ || '/' || total || ':' || array_to_string(s, ' | ') AS match,
           'https://' || domain || '/wp-json/wp/v2/posts' AS url FROM f WHERE foreign_ >= 4 AND foreign_ * 100 < total * 30""")(
    lambda spark, sf_dir: _enumerated(spark, "L20SCRIPT"))
query("layer_l20mass_cand", f"""
    WITH {ITEMS_SQL} SELECT domain, 'content-enum' AS bucket, 'x-wp-total=' || total AS match, 'https://' || domain || '/wp-json/wp/v2/posts' AS url
    FROM n WHERE total >= 300""")(lambda spark, sf_dir: _enumerated(spark, "L20MASS_CAND"))  # fmt: skip

# Sitemaps.
MAPS_SQL = rf"""
    c AS (SELECT * FROM {CAPTURES.sql}),
    u AS (SELECT domain, unnest(regexp_extract_all(text, '(?i)https?://[^<\s"]+')) AS url, generate_subscripts(regexp_extract_all(text, '(?i)https?://[^<\s"]+'), 1) AS pos
          FROM c WHERE variant = 'sitemap'),
    l AS (SELECT domain, regexp_extract(m, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1) AS url, pos FROM (
          SELECT domain, unnest(regexp_extract_all(text, '(?i)<loc>\s*[^<\s]+\s*</loc>')) AS m, generate_subscripts(regexp_extract_all(text, '(?i)<loc>\s*[^<\s]+\s*</loc>'), 1) AS pos
          FROM c WHERE variant = 'sitemap'))"""  # fmt: skip


def _mapped(spark: SparkSession, layer: str) -> DataFrame:
    rows = signals.sitemap_signals(signals.sitemap_locations(CAPTURES.df(spark)))
    return rows.where(F.col("layer") == layer).select("domain", "bucket", "match", "url")


query("layer_l11sitemap", f"""
    WITH {MAPS_SQL},
    s AS (SELECT * FROM u WHERE contains(url, domain) AND NOT ends_with(lower(url), '.xml') AND regexp_matches(url, {_quoted('(?i)' + P.RX_SLUG_SPAM)})
          QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) <= 3)
    SELECT domain, 'sitemap-doorway' AS bucket, substr(string_agg(url, ';' ORDER BY pos), 1, 200) AS match, arg_min(url, pos) AS url FROM s GROUP BY 1""")(
    lambda spark, sf_dir: _mapped(spark, "L11SITEMAP"))
query("layer_l20shape", rf"""
    WITH {MAPS_SQL},
    p AS (SELECT *, regexp_replace(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/?[^/]*$', '') AS up,
                 lower(regexp_replace(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '[^/]*$'), '\.html?$', '')) AS seg
          FROM l WHERE contains(url, domain) AND NOT regexp_matches(url, '(?i){signals.SHAPE_SKIP}')),
    g AS (SELECT domain, CASE up WHEN '' THEN '/' ELSE up END AS parent, min(pos) AS pos, count_if(regexp_matches(url, '(?i){signals.RANDOM_DIR}')) AS random,
                 count_if(length(seg) > 9 AND len(regexp_extract_all(seg, '[aeiou]')) / length(seg) < 0.22 AND regexp_matches(seg, '[bcdfghjklmnpqrstvwxz]{{6,}}')) AS gib
          FROM p GROUP BY 1, 2),
    t AS (SELECT domain, max(random) AS r, max(gib) AS g, arg_max(parent, (random, -pos)) AS rp, arg_max(parent, (gib, -pos)) AS gp FROM g GROUP BY 1),
    x AS (SELECT *, CASE WHEN r > 0 AND r >= g THEN rp ELSE gp END AS parent FROM t WHERE r >= 6 OR g >= 10)
    SELECT domain, 'sitemap-doorway' AS bucket, 'randomdir=' || r || ' gibberish=' || g || ' parent=' || parent AS match, 'https://' || domain || parent || '/' AS url FROM x""")(
    lambda spark, sf_dir: _mapped(spark, "L20SHAPE"))
query("layer_l16feed", rf"""
    WITH c AS (SELECT * FROM {CAPTURES.sql}),
    f AS (SELECT domain, seq, final_url, array_to_string(regexp_extract_all(text, '(?i){signals.FEED_TEXT}'), ' ') AS t FROM c WHERE variant = 'feed'),
    g AS (SELECT *, {_words('t')} AS w FROM f)
    SELECT domain, 'content-enum' AS bucket, substr({_join('w')}, 1, 200) AS match, final_url AS url FROM g WHERE len(w) > 0
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1""")(
    lambda spark, sf_dir: signals.feed_signals(CAPTURES.df(spark)).select("domain", "bucket", "match", "url"))
query("layer_l5density", f"""
    WITH c AS (SELECT * FROM {CAPTURES.sql}),
    s AS (SELECT domain, max(len(regexp_extract_all({_visible_sql('text')}, {_quoted('(?i)' + P.ALL_STRONG)}))) AS n FROM c WHERE variant = 'search' GROUP BY 1)
    SELECT domain, 'search-index' AS bucket, 'count=' || n AS match, 'https://' || domain || '/?s=casino' AS url FROM s WHERE n >= 4""")(
    lambda spark, sf_dir: signals.search_signals(CAPTURES.df(spark)).select("domain", "bucket", "match", "url"))


# ---------------------------------------------------------------- review

SCORED = Rows(
    "domain string, verdict string, posterior double, nbuckets int, hard boolean, category string, proof string, proof_url string, status string, confirmed int, "
    "domain_spammy boolean, bd_signal boolean, biz_type string, business string, phone string, http_status int",
    [
        ("lead.example.org", "CONFIRM_CANDIDATE", 0.9987, 2, True, "deface", "hacked by", "https://lead.example.org/", "lead", 1, False, True, "it", "Lead Ltd", "017", 200),
        ("hacked.example.org", "SUSPECT", 0.9, 1, False, "gambling", "togel", "u", "review", 0, False, False, "food", None, None, 200),
        ("genuine.example.org", "SUSPECT", 0.8, 1, False, "gambling", "togel", "u", "lead", 1, False, False, "food", "G", "1", None),
        ("park.example.org", "CONFIRM_CANDIDATE", 0.98, 2, False, "gambling", "togel", "u", "lead", 1, None, None, "it", "P", "2", 301),
        ("identity.example.org", "CONFIRM_CANDIDATE", 0.98, 2, False, "adult", "x", "u", "lead", 1, False, True, "it", "I", "3", 200),
        ("spam.example.org", "SUSPECT", 0.7, 1, False, "gambling", "x", "u", "spam_site", 0, False, False, "it", "S", "4", 200),
        ("name.example.org", "CONFIRM_CANDIDATE", 0.99, 2, False, "gambling", "x", "u", "lead", 1, True, True, "it", "N", "5", 200),
        ("clean.example.org", "CLEAN", 0.12, 0, False, "", "", "", "clean", 0, False, False, "it", "C", "6", 200),
    ],
)
VERDICTS = Rows(
    "domain string, classification string, business_type string, confidence double, reason string",
    [("hacked.example.org", "hacked_client", "ngo", 0.9, "injected"), ("genuine.example.org", "genuine_spam", "", 0.8, "own"), ("lead.example.org", "hacked_client", "", 0.5, None)],
)
_OUT = "domain, business, phone, category, proof_snippet, stage1_score, http_status, stage2_verdict, stage2_reason, confirmed, is_bd, biz_type, status"


def _decided(spark: SparkSession, reviewed: bool) -> DataFrame:
    scored = SCORED.df(spark).withColumns({"layers": F.array(F.lit("L1KW_WEAK")), "evidence": F.array().cast("array<struct<layer:string,url:string,match:string>>")})
    return verdicts.decide(scored, VERDICTS.df(spark) if reviewed else None).select(*_OUT.split(", "))


_REASON = "'posterior=' || format('{:.3f}', posterior) || ' buckets=' || nbuckets || CASE WHEN hard THEN ' HARD' ELSE '' END"
_PLAIN = "domain, coalesce(business, '') AS business, coalesce(phone, '') AS phone, category, proof AS proof_snippet, nbuckets AS stage1_score, coalesce(http_status, 0) AS http_status"
query("review_without_reviewer", f"""
    SELECT {_PLAIN}, substr(verdict, 1, 20) AS stage2_verdict, {_REASON} AS stage2_reason, confirmed, coalesce(bd_signal, false)::INT AS is_bd, biz_type, status
    FROM {SCORED.sql} WHERE status NOT IN ('clean', 'spam_site') AND NOT coalesce(domain_spammy, false)""")(lambda spark, sf_dir: _decided(spark, False))  # fmt: skip
query("review_decisions", f"""
    WITH s AS (SELECT s.*, v.classification AS cls, v.business_type AS vb, v.reason AS vr, coalesce(bd_signal, false) AS bd FROM {SCORED.sql} s LEFT JOIN {VERDICTS.sql} v USING (domain)),
    k AS (SELECT *, cls IS NULL AND category IN ('gambling', 'adult') AND NOT bd AS park FROM s
          WHERE status <> 'clean' AND NOT coalesce(domain_spammy, false) AND (cls = 'hacked_client' OR (cls IS NULL AND status <> 'spam_site')))
    SELECT {_PLAIN}, substr(CASE WHEN cls IS NOT NULL THEN 'review-' || cls WHEN park THEN 'unverified-' || category ELSE verdict END, 1, 20) AS stage2_verdict,
           CASE WHEN cls IS NOT NULL THEN 'review:' || cls || ' — ' || coalesce(vr, '') WHEN park THEN 'review unavailable; ' || category || ' without regional identity parked'
                ELSE {_REASON} END AS stage2_reason,
           CASE WHEN cls IS NOT NULL THEN 1 WHEN park THEN 0 ELSE confirmed END AS confirmed, bd::INT AS is_bd,
           CASE WHEN coalesce(vb, '') <> '' THEN vb ELSE biz_type END AS biz_type, CASE WHEN cls IS NOT NULL THEN 'lead' WHEN park THEN 'review' ELSE status END AS status
    FROM k""")(lambda spark, sf_dir: _decided(spark, True))  # fmt: skip
REPLIES = Rows("domain string, reply string", [
    ("a.org", '{"classification":"Hacked_Client","business_type":"IT","confidence":0.9,"reason":"r"}'), ("b.org", 'Sure: {"classification":"false_positive","reason":"x"} done'),
    ("c.org", "no idea"), ("d.org", '{"business_type":"it"}'), ("e.org", None),
])
query("reviewer_replies", rf"""
    WITH r AS (SELECT domain, regexp_extract(coalesce(reply, ''), '(?s)\{{.*\}}') AS j FROM {REPLIES.sql}),
    v AS (SELECT domain, j->>'$.classification' AS c, j->>'$.business_type' AS b, (j->>'$.confidence')::DOUBLE AS confidence, j->>'$.reason' AS reason FROM r WHERE json_valid(j))
    SELECT domain, lower(c) AS classification, lower(coalesce(b, '')) AS business_type, confidence, coalesce(reason, '') AS reason FROM v WHERE coalesce(c, '') <> ''""")(
    lambda spark, sf_dir: verdicts.parse_replies(REPLIES.df(spark)))
CANDIDATES = Rows("domain string, business string, layers string, proof string, evidence string, excerpt string", [
    ("a.org", "B" * 130, "L" * 310, "p", "e" * 500, "x" * 3000), ("b.org", "", None, "p" * 400, None, ""), ("c.org", None, "l", "", "e", None)])
query("review_requests", f"""
    SELECT domain, substr(CASE WHEN coalesce(business, '') = '' THEN '?' ELSE business END, 1, 120) AS business, substr(coalesce(layers, ''), 1, 300) AS layers,
           substr(coalesce(proof, ''), 1, 300) AS proof, substr(coalesce(evidence, ''), 1, 400) AS evidence, substr(coalesce(excerpt, ''), 1, 2500) AS excerpt
    FROM {CANDIDATES.sql}""")(lambda spark, sf_dir: verdicts.review_requests(CANDIDATES.df(spark)))  # fmt: skip
OLD = Rows("id int, domain string, layers string, confirmed int", [
    (1, "x-casino.com", "L1KW_WEAK", 1), (2, "a.com", "L1KW_WEAK", 1), (3, "b.com", "L2UACLOAK", 1), (4, "c.com", "", 1), (5, "d.com", None, 1), (6, "e.com", "", 0), (7, "f.com", "", 1)])
FRESH = Rows("domain string, text string", [(d, "<title>t</title>body") for d in ("x-casino.com", "a.com", "b.com", "d.com", "f.com")])
SECOND = Rows(VERDICTS.schema, [("a.com", "false_positive", "general", 0.5, "r"), ("b.com", "false_positive", "it", 0.5, "r"), ("d.com", "genuine_spam", "", 1.0, "r")])
_RECHECK = f"""
    WITH r AS (SELECT f.*, t.text IS NOT NULL AND t.text <> '' AS alive, v.classification AS cls, v.reason AS vr, v.confidence AS vc,
                      regexp_matches(f.domain, '(?i){P.SPAMMY_DOMAIN}') AS spammy, regexp_matches(coalesce(layers, ''), '{'|'.join(P.RECHECK_STRONG_LAYERS)}') AS strong
               FROM {OLD.sql} f LEFT JOIN {FRESH.sql} t USING (domain) LEFT JOIN {SECOND.sql} v USING (domain) WHERE confirmed = 1),
    s AS (SELECT *, alive AND cls IS NOT NULL AND NOT spammy AS said FROM r),
    d AS (SELECT *, CASE WHEN spammy OR (said AND cls = 'genuine_spam') OR (said AND cls = 'false_positive' AND NOT strong) THEN 'reject' ELSE 'keep' END AS decision FROM s)"""
query("recheck_findings", f"""{_RECHECK}
    SELECT id, domain, decision, CASE WHEN spammy THEN 'domain name is a gambling or adult brand' WHEN said AND cls = 'genuine_spam' THEN 'genuine_spam — ' || vr
           WHEN said AND cls = 'false_positive' AND NOT strong THEN 'false_positive (weak signal) — ' || vr WHEN said AND cls = 'false_positive' THEN
           'false_positive but strong signal kept — ' || vr WHEN NOT alive THEN 'offline at re-check (kept as is)' ELSE 'no review (kept)' END AS reason,
           CASE WHEN said THEN vc ELSE 0 END AS conf, alive FROM d""")(
    lambda spark, sf_dir: verdicts.recheck(OLD.df(spark), FRESH.df(spark), SECOND.df(spark)).select("id", "domain", "decision", "reason", "conf", "alive"))
query("recheck_histogram", f"{_RECHECK} SELECT decision, 0 AS is_bd, CASE WHEN domain = 'b.com' THEN 'it' ELSE 'general-business' END AS biz, count(*) AS n FROM d GROUP BY ALL")(
    lambda spark, sf_dir: verdicts.recheck_summary(verdicts.recheck(OLD.df(spark), FRESH.df(spark), SECOND.df(spark))))
JOINED = Rows("domain string, is_manual int, status string, ts int", [("a.org", 0, "lead", 1), ("a.org", 1, "lead", 2), ("b.org", None, "rejected", 3), ("c.org", 0, None, 4)])
SUMS = Rows("batch_id int, domain string, error boolean", [(1, "a", False), (1, "b", True), (1, "c", False), (2, "d", True)])
HITS = Rows("batch_id int, confirmed int", [(1, 1), (1, 0)])
query("batch_sums", f"""
    SELECT s.batch_id, scanned, coalesce(flagged, 0) AS flagged, coalesce(confirmed, 0) AS confirmed, errors
    FROM (SELECT batch_id, count(*) AS scanned, count_if(error)::BIGINT AS errors FROM {SUMS.sql} GROUP BY 1) s
    LEFT JOIN (SELECT batch_id, count(*) AS flagged, count_if(confirmed = 1)::BIGINT AS confirmed FROM {HITS.sql} GROUP BY 1) h USING (batch_id)""")(
    lambda spark, sf_dir: verdicts.batch_sums(HITS.df(spark), SUMS.df(spark)))


# ---------------------------------------------------------------- fusion

GATES = Rows("domain string, ord int, bucket string, layer string, match string, url string", [
    ("control.org", 0, "control", "L18CHALLENGE", "w", "u"), ("mass.org", 0, "content-enum", "L20MASS_CAND", "m", "u"),
    ("open.org", 0, "homepage-content", "L1KW_STRONG", "judi", "u"), ("spammy.org", 0, "cloak-diff", "L2UACLOAK", "togel", "u"),
    ("stealth.org", 0, "homepage-content", "L1KW_STRONG", "judi", "u"), ("stealth.org", 1, "cloak-diff", "L2UACLOAK", "togel", "v"),
    ("known.org", 0, "homepage-content", "L1KW_STRONG", "judi", "u"), ("two.org", 0, "x", "L11REST", "viagra", "p"), ("two.org", 1, "y", "L11SITEMAP", "z", "q"),
    ("hard.org", 0, "deface", "L10DEFACE", "hacked by", "h"), ("other.org", 0, "z", "LNEW", "n", ""),
])
CONTEXT = Rows("domain string, domain_spammy boolean, bd_signal boolean", [("spammy.org", True, False), ("known.org", False, True), ("hard.org", None, None)])
_RATIO = "CASE layer " + " ".join(f"WHEN '{x}' THEN {P.WEIGHTS[x][0]}::DOUBLE / {P.WEIGHTS[x][1]}" for x in (
    "L1KW_STRONG", "L2UACLOAK", "L11REST", "L11SITEMAP", "L10DEFACE")) + f" ELSE {P.UNKNOWN_WEIGHT[0]}::DOUBLE / {P.UNKNOWN_WEIGHT[1]} END"
query("fusion_gate", f"""
    WITH s AS (SELECT * FROM {GATES.sql}), e AS (SELECT *, {_RATIO} AS ratio FROM s WHERE bucket <> 'control' AND layer <> 'L20MASS_CAND'),
    b AS (SELECT domain, bucket, max(ratio) AS ratio, arg_max(match, (ratio, -ord)) AS match, arg_max(url, (ratio, -ord)) AS url, min(ord) AS first FROM e GROUP BY 1, 2),
    p AS (SELECT domain, count(*) AS n, 1 / (1 + exp(-(ln({P.PRIOR} / {1 - P.PRIOR}) + sum(ln(ratio))))) AS raw, arg_max(match, (ratio, -first)) AS proof FROM b GROUP BY 1),
    a AS (SELECT domain, bool_or(layer LIKE 'L18%') AS wall, bool_or(layer = 'L1KW_STRONG') AS open, bool_or(layer = 'L10DEFACE') AS hard,
                 bool_or(layer IN ('{"','".join(P.STEALTH_LAYERS + P.MALWARE_LAYERS)}')) AS inj, bool_or(layer IN ('{"','".join(P.DOORWAY_LAYERS)}')) AS door FROM s GROUP BY 1),
    v AS (SELECT a.*, coalesce(n, 0) AS nbuckets, coalesce(proof, '') AS proof, CASE WHEN n IS NULL THEN CASE WHEN wall THEN 'NEEDS_BROWSER' ELSE 'CLEAN' END
                 WHEN hard OR (raw >= 0.97 AND n >= 2) THEN 'CONFIRM_CANDIDATE' ELSE 'SUSPECT' END AS verdict,
                 coalesce(domain_spammy, false) AS sp, coalesce(bd_signal, false) AS bd FROM a LEFT JOIN p USING (domain) LEFT JOIN {CONTEXT.sql} USING (domain))
    SELECT domain, nbuckets::INT AS nbuckets, hard, verdict, proof, CASE WHEN sp OR (open AND NOT (inj OR (door AND NOT open)) AND NOT bd) THEN 'spam_site'
           WHEN verdict = 'CONFIRM_CANDIDATE' THEN 'lead' WHEN verdict = 'SUSPECT' THEN 'review' ELSE 'clean' END AS status FROM v""")(
    lambda spark, sf_dir: fusion.score(GATES.df(spark), CONTEXT.df(spark)).select("domain", "nbuckets", "hard", "verdict", "proof", "status"))
query("fusion_evidence", f"""
    WITH f AS (SELECT domain, url, min(ord) AS ord, arg_min(layer, ord) AS layer FROM {GATES.sql} WHERE bucket <> 'control' AND layer <> 'L20MASS_CAND' AND url <> '' GROUP BY 1, 2)
    SELECT domain, ord, layer, url FROM (SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY ord) - 1)::INT AS ord, layer, url FROM f) WHERE ord < 12""")(
    lambda spark, sf_dir: fusion.score(GATES.df(spark)).select("domain", F.posexplode("evidence").alias("ord", "e")).select("domain", "ord", "e.layer", "e.url"))
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(match, {_quoted('(?i)(?:' + a + ')|(?:' + b + ')')}) THEN '{c}'" for c, a, b in (
    ("gambling", P.RX_GAMB_STRONG, P.RX_GAMB_WEAK), ("pharma", P.RX_PHARMA_STRONG, P.RX_PHARMA_WEAK), ("adult", P.RX_ADULT_STRONG, P.RX_ADULT_WEAK))) + " ELSE '' END"
MATCHES = Rows("match string", [("JUDI online",), ("a poker face",), ("buy viagra now",), ("bed pills",), ("xvideos",), ("escort",), ("viagra casino",), ("nothing",), ("คาสิโน",)])
query("match_category", f"SELECT match, {_CAT} AS category FROM {MATCHES.sql}")(lambda spark, sf_dir: MATCHES.df(spark).select("match", category_of(F.col("match")).alias("category")))
EXTERNAL = Rows(GATES.schema, [("e.org", k, "external", x, "m", "u") for k, x in enumerate(("L15DBL", "L15URLHAUS", "L15CT", "L15SURBL"))])
query("external_buckets", f"""
    WITH e AS (SELECT *, CASE layer {' '.join(f"WHEN '{x}' THEN {P.WEIGHTS[x][0]}::DOUBLE / {P.WEIGHTS[x][1]}" for x in P.EXTERNAL_LAYERS)} END AS ratio FROM {EXTERNAL.sql})
    SELECT 'ext:' || layer AS key, round(ratio, 4) AS ratio FROM e QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ratio DESC, ord) <= 2""")(
    lambda spark, sf_dir: fusion.best_per_bucket(fusion.weighted(EXTERNAL.df(spark))).select("key", F.round("lead.ratio", 4).alias("ratio")))


# ---------------------------------------------------------------- names and addresses

HOSTS = Rows("raw string", [("HTTPS://User@WWW.Shop.Example.ORG:8080/a?b#c",), ("*.a.b.com.bd",), ("x.y.net",), ("a..b.com",), ("logo.png",), ("facebook.com",), ("203.0.113.9",),
                            ("",), (None,), ("//x.org",), ("news.gov.bd.",), ("gov.bd",), ("ftp://q.example.net/x",)])
_BARE = rf"regexp_replace({_host('trim(raw)')}, '^www\.', '')"
query("host_normalized", rf"SELECT raw, CASE WHEN regexp_matches({_BARE}, '^[a-z0-9.-]+\.[a-z]{{2,}}$') THEN {_BARE} END AS domain FROM {HOSTS.sql}")(
    lambda spark, sf_dir: HOSTS.df(spark).select("raw", D.normalize_domain(F.col("raw")).alias("domain")))
_NAME = rf"regexp_replace(regexp_replace({_host('rtrim(trim(raw), chr(46))')}, '^[*.]+', ''), '^www\.', '')"
_REG_SQL = rf"""
    WITH n AS (SELECT raw, {_NAME} AS n FROM {HOSTS.sql}),
    l AS (SELECT raw, CASE WHEN regexp_matches(n, '^[a-z0-9][a-z0-9.\-]+\.[a-z]{{2,}}$') AND NOT contains(n, '..') AND NOT regexp_matches(n, '{D.ASSET}') THEN string_split(n, '.') END AS l FROM n),
    d AS (SELECT raw, array_to_string(l[CASE WHEN len(l) >= 3 AND l[-1] = 'bd' AND l[-2] IN ('{"','".join(P.SECOND_LEVEL)}') THEN -3 ELSE -2 END:], '.') AS d FROM l)"""
query("host_registrable", f"{_REG_SQL} SELECT raw, CASE WHEN d NOT IN ({', '.join(map(_quoted, P.BLOCKED_DOMAINS))}) THEN d END AS domain FROM d")(
    lambda spark, sf_dir: HOSTS.df(spark).select("raw", D.registrable(F.col("raw")).alias("domain")))
query("host_cleaned", rf"""SELECT raw, trim(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(raw, ''))), '^[a-z][a-z0-9+.\-]*://', ''),
    '[/?#].*$', '', 's'), '^.*@', '', 's'), ':.*$', '', 's')), '.') AS host FROM {HOSTS.sql}""")(
    lambda spark, sf_dir: HOSTS.df(spark).select("raw", D.clean_host(F.col("raw")).alias("host")))
SUFFIXES = Rows("suffix string", [("org",), ("net",), ("com.bd",), ("gov.bd",), ("bd",)])
query("host_by_suffix_table", rf"""
    WITH n AS (SELECT raw, {_NAME} AS n FROM {HOSTS.sql}),
    l AS (SELECT raw, n FROM n WHERE regexp_matches(n, '^[a-z0-9][a-z0-9.\-]+\.[a-z]{{2,}}$') AND NOT contains(n, '..') AND NOT regexp_matches(n, '{D.ASSET}')),
    s AS (SELECT raw, n, arg_max(suffix, length(suffix)) AS suffix FROM l JOIN {SUFFIXES.sql} ON ends_with(n, '.' || suffix) GROUP BY 1, 2)
    SELECT h.raw, regexp_extract(n[1:length(n) - length(suffix) - 1], '[^.]*$') || '.' || suffix AS registrable FROM {HOSTS.sql} h LEFT JOIN s USING (raw)""")(
    lambda spark, sf_dir: D.registrable_by_suffix(HOSTS.df(spark), "raw", SUFFIXES.df(spark)))
SITES = Rows("domain string, body string", [
    ("shop.com.bd", "hello"), ("x.org", "call +8801712345678 now"), ("x.org", "call 01712345678"), ("casino-royal.com", ""), ("club.bet", None), (None, "ab" + "ক" * 14), ("y.org", "ক" * 15)])
query("site_identity", rf"""
    SELECT domain, body, coalesce(domain, '') LIKE '%.bd' OR regexp_matches(coalesce(body, ''), '(?:\+?880|\b0)1[3-9]\d{{8}}\b')
           OR len(regexp_extract_all(coalesce(body, ''), '{P.BENGALI}')) >= 15 AS bd_signal,
           regexp_matches(coalesce(domain, ''), '(?i)({P.SPAMMY_DOMAIN})') OR regexp_matches(coalesce(domain, ''), '(?i){P.SPAMMY_TLD}') AS spammy FROM {SITES.sql}""")(
    lambda spark, sf_dir: SITES.df(spark).select("domain", "body", D.bd_signal(F.col("domain"), F.col("body")).alias("bd_signal"),
                                                 D.domain_spammy(F.col("domain")).alias("spammy")))
SCORES = Rows("domain string, src boolean, ip boolean, text boolean", [("a.bd", True, True, True), ("a.com", True, False, False), ("b.bd", False, False, False), ("c.net", False, True, True)])
query("region_score", f"SELECT domain, least(100, 40 * (domain LIKE '%.bd')::INT + 30 * src::INT + 25 * ip::INT + 15 * text::INT) AS score FROM {SCORES.sql}")(
    lambda spark, sf_dir: SCORES.df(spark).select("domain", D.bd_score(F.col("domain"), F.col("src"), F.col("ip"), F.col("text")).alias("score")))
PAIRS = Rows("host string, domain string", [("a.org", "a.org"), ("www.a.org", "a.org"), ("ba.org", "a.org"), ("a.org.evil.net", "a.org"), ("", "a.org")])
query("same_site", f"SELECT host, domain, host = domain OR ends_with(host, '.' || domain) AS same FROM {PAIRS.sql}")(
    lambda spark, sf_dir: PAIRS.df(spark).select("host", "domain", D.same_host(F.col("host"), F.col("domain")).alias("same")))
ADDRESSES = Rows("ip string, host string", [("104.21.3.4", "www.facebook.com"), ("192.0.2.1", "godaddy.com"), ("2001:db8::1", "shop.example.net"), ("no ip", "maps.app.goo.gl"), ("172.67.0.1", "x.org"), ("1040.2.1", "hostgator.com")])
_PREFIX = "^(" + "|".join(p.replace(".", r"\.") for p in P.CDN_PREFIXES) + ")"
_PARTS = "|".join(p.replace(".", r"\.") for p in P.BLOCKED_PARTS)
query("address_kinds", rf"""
    SELECT ip, host, regexp_matches(ip, '{_PREFIX}') AS cdn, regexp_matches(ip, '^[0-9a-fA-F:.]+$') AS valid, regexp_matches(host, '{_PARTS}') AS blocked,
           host IN ({', '.join(map(_quoted, sorted(P.HOST_PROVIDERS)))}) AS provider FROM {ADDRESSES.sql}""")(
    lambda spark, sf_dir: ADDRESSES.df(spark).select("ip", "host", D.cdn_address(F.col("ip")).alias("cdn"), D.valid_ip(F.col("ip")).alias("valid"),
                                                     D.blocked_host(F.col("host")).alias("blocked"), D.provider(F.col("host")).alias("provider")))


# ---------------------------------------------------------------- sources

PAYLOAD = Rows("ord int, domain string, host string, url string, business string, phone string, bd_score int", [
    (0, "https://www.A.org/x", None, None, "A", "1", 40), (1, None, "a.org", None, "second", None, None), (2, None, None, "http://b.net:80/p", None, "2", 7),
    (3, "not a host", None, None, "C", None, 1), (4, None, None, None, "D", None, 1), (5, "c.com.bd", "z.org", None, "x" * 250, "9" * 50, None)])
_RAW = "coalesce(domain, host, url)"
_PAY = rf"regexp_replace({_host(f'trim({_RAW})')}, '^www\.', '')"
query("harvest_payload", rf"""
    SELECT ord, d AS domain, 'feed' AS source, coalesce(bd_score, 0) AS bd_score, substr(coalesce(business, ''), 1, 200) AS business, substr(coalesce(phone, ''), 1, 40) AS phone, 99::BIGINT AS added_ts
    FROM (SELECT * EXCLUDE (domain), {_PAY} AS d FROM {PAYLOAD.sql}) WHERE regexp_matches(d, '^[a-z0-9.-]+\.[a-z]{{2,}}$') QUALIFY row_number() OVER (PARTITION BY d ORDER BY ord) = 1""")(
    lambda spark, sf_dir: parsers.harvest_rows(PAYLOAD.df(spark), "feed", 99))
CERTS = Rows("name_value string, common_name string", [("*.a.com.bd\nbb.com", "www.a.com.bd"), (None, None), ("x.facebook.com\r\nmail.cc.net.bd", "dd.org"), ("bad name", "")])


def _domains_sql(rows: str, column: str) -> str:
    """Distinct registrable domains of a column of host names."""
    name = rf"regexp_replace(regexp_replace({_host(f'rtrim(trim({column}), chr(46))')}, '^[*.]+', ''), '^www\.', '')"
    return rf"""
        SELECT DISTINCT d AS domain FROM (SELECT array_to_string(l[CASE WHEN len(l) >= 3 AND l[-1] = 'bd' AND l[-2] IN ('{"','".join(P.SECOND_LEVEL)}') THEN -3 ELSE -2 END:], '.') AS d
            FROM (SELECT string_split(n, '.') AS l FROM (SELECT {name} AS n FROM {rows})
                  WHERE regexp_matches(n, '^[a-z0-9][a-z0-9.\-]+\.[a-z]{{2,}}$') AND NOT contains(n, '..') AND NOT regexp_matches(n, '{D.ASSET}')))
        WHERE d NOT IN ({', '.join(map(_quoted, P.BLOCKED_DOMAINS))})"""


_CERT_NAMES = rf"(SELECT unnest(list_append(regexp_split_to_array(coalesce(name_value, ''), '\r?\n'), coalesce(common_name, ''))) AS h FROM {CERTS.sql})"
query("source_certificates", f"SELECT domain, least(100, 30 + 40 * (domain LIKE '%.bd')::INT) AS bd_score FROM ({_domains_sql(_CERT_NAMES, 'h')})")(
    lambda spark, sf_dir: parsers.certificate_names(CERTS.df(spark)))
query("source_certificates_edge", f"SELECT domain, 70 AS bd_score FROM ({_domains_sql(_CERT_NAMES, 'h')}) WHERE domain LIKE '%.bd'")(
    lambda spark, sf_dir: parsers.certificate_names(CERTS.df(spark), most=20_000, suffix=".bd"))
LINES = Rows("value string", [('{"url":"https://x.a.bd/1"}',), ("bad",), ('{"url":"https://bb.org/"}',), ('{"url":"http://u@www.cc.com.bd:81/?q"}',), ('{"other":1}',)])
_LINE_HOSTS = rf"(SELECT regexp_replace(regexp_replace(regexp_replace(lower(value->>'$.url'), '^[a-z]+://', ''), '[/?#].*$', ''), '^.*@', '') AS h FROM {LINES.sql} WHERE json_valid(value))"
query("source_crawl_index", _domains_sql(_LINE_HOSTS, "h"))(lambda spark, sf_dir: parsers.crawl_index_lines(LINES.df(spark), most=None))
INDEXES = Rows("url string, text string", [
    ("https://d.org/i.xml", "<loc>https://d.org/item-1.xml</loc><LOC> https://d.org/item-2.xml </LOC><loc>https://d.org/post.xml</loc>"),
    ("https://e.org/i.xml", "<loc>https://e.org/a?x=1&amp;y=2</loc><loc></loc>")])
MAPS = Rows("url string, text string", [("https://d.org/item-1.xml", "<loc>https://d.org/item/a</loc><loc>https://d.org/item/b</loc>"), ("https://d.org/post.xml", "<loc>https://d.org/p</loc>")])
_LOCS = r"replace(unnest(regexp_extract_all(text, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1)), '&amp;', '&')"
query("source_sitemap", f"SELECT url, {_LOCS} AS loc FROM {INDEXES.sql}")(lambda spark, sf_dir: parsers.sitemap_urls(INDEXES.df(spark)).select("url", "loc"))
query("source_sitemap_index", f"""
    WITH o AS (SELECT url AS index, {_LOCS} AS loc FROM {INDEXES.sql}), k AS (SELECT * FROM o WHERE contains(loc, 'item')), m AS (SELECT url, {_LOCS} AS inner_ FROM {MAPS.sql})
    SELECT k.index, m.inner_ AS loc FROM k JOIN m ON m.url = k.loc UNION ALL SELECT index, loc FROM o WHERE index NOT IN (SELECT index FROM k)""")(
    lambda spark, sf_dir: parsers.expand_index(INDEXES.df(spark), MAPS.df(spark), "item"))
LISTINGS = Rows("url string, text string", [
    ("1", '<script>{"name":"A &amp; Co","url":"https://www.firm.com.bd/x"}</script>'), ("2", '<title>Beta - Directory</title>Website: <a href="http://beta.org/?a">beta</a>'),
    ("3", '<meta property="og:title" content="Gamma"><a href="https://facebook.com/g">f</a><a href="mailto:x@y.org">m</a><a href="https://gamma.net/">g</a>'),
    ("4", "<title>None</title> <a href='/inner'>x</a>"), ("5", "<title>Again</title> website: firm.com.bd"), ("6", "<title>Plain</title><h6>https://plain.org/a</h6>")])
query("source_directory_names", r"""
    SELECT url, coalesce(nullif(trim(replace(regexp_extract(text, '(?i)"name"\s*:\s*"([^"]+)"', 1), '&amp;', '&')), ''),
        nullif(trim(regexp_extract(text, '(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']+)["'']', 1)), ''),
        trim(regexp_split_to_array(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+[|\-–—]\s+')[1])) AS business FROM """ + LISTINGS.sql)(
    lambda spark, sf_dir: LISTINGS.df(spark).select("url", parsers.business_name(F.col("text")).alias("business")))
_SITE = rf"""
    WITH c AS (SELECT url, list_concat(list_concat(regexp_extract_all(text, '(?i)"url"\s*:\s*"([^"]+)"', 1), regexp_extract_all(text, {_quoted(parsers.WEB_FIELD.replace('(?iu)', '(?i)'))}, 1)),
                      regexp_extract_all(text, {_quoted(parsers.HREF.replace('(?iu)', '(?i)'))}, 1)) AS found, regexp_extract_all(text, '(?i)https?://[a-z0-9.\-]+\.[a-z]{{2,}}[^\s''"<>,)]*') AS plain
               FROM {LISTINGS.sql}),
    e AS (SELECT url, unnest(PICK) AS u, generate_subscripts(PICK, 1) AS k FROM c),
    h AS (SELECT url, k, regexp_replace(regexp_replace(regexp_replace(lower(u), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\.', '') AS h FROM e WHERE NOT regexp_matches(u, '^(#|mailto:|tel:|javascript:)')),
    d AS (SELECT url, k, array_to_string(string_split(h, '.')[CASE WHEN h LIKE '%.com.bd' THEN -3 ELSE -2 END:], '.') AS d FROM h
          WHERE regexp_matches(h, '^[a-z0-9][a-z0-9.\-]+\.[a-z]{{2,}}$') AND NOT regexp_matches(h, '{_PARTS}') AND h <> 'dir.org')
    SELECT url, arg_min(d, k) AS domain FROM d GROUP BY 1"""
query("source_directory_website", _SITE.replace("PICK", "found"))(
    lambda spark, sf_dir: LISTINGS.df(spark).select("url", parsers.website_of(F.col("text"), F.lit("dir.org")).alias("domain")).where("domain IS NOT NULL"))
query("source_directory_website_edge", _SITE.replace("PICK", "list_concat(found, plain)"))(
    lambda spark, sf_dir: LISTINGS.df(spark).select("url", parsers.website_of(F.col("text"), F.lit("dir.org"), plain=True).alias("domain")).where("domain IS NOT NULL"))
query("source_directory_rows", f"SELECT domain, least(100, 30 + 40 * (domain LIKE '%.bd')::INT) AS bd_score, min(url) AS url FROM ({_SITE.replace('PICK', 'found')}) GROUP BY 1, 2")(
    lambda spark, sf_dir: parsers.listing_rows(LISTINGS.df(spark), "dir.org").select("domain", "bd_score", "url"))
BUDGETS = Rows("source string, place int, budget int, start int", [("x", 0, 3, 4), ("y", 1, 10, 0), ("z", 2, 5, 1)])
LISTED = Rows("source string, pos int, url string", [("x", k, f"x{k}") for k in range(5)] + [("x", 9, "x1")] + [("y", k, f"y{k}") for k in range(2)] + [("z", k, f"z{k}") for k in range(4)])
query("source_directory_slices", f"""
    WITH o AS (SELECT source, url, min(pos) AS pos FROM {LISTED.sql} GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM o),
    p AS (SELECT b.*, n, least(budget, n) AS want FROM {BUDGETS.sql} b JOIN (SELECT source, count(*) AS n FROM o GROUP BY 1) USING (source)),
    t AS (SELECT *, greatest(0, least(want, 7 - coalesce(sum(want) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM p)
    SELECT a.source, url FROM a JOIN t USING (source) WHERE (k - start + 10 * a.n) % a.n < take""")(
    lambda spark, sf_dir: parsers.listing_slices(LISTED.df(spark), BUDGETS.df(spark), 7))
ELEMENTS = Rows("ord int, tags map<string,string>", [
    (0, {"website": "https://www.shop.com.bd/", "name": "Shop"}), (1, {"contact:website": "http://cafe.org", "name": "Cafe"}), (2, {"website": "", "contact:website": "shop.com.bd", "name": "Later"}),
    (3, {"name": "No site"}), (4, {"website": "https://facebook.com/x"})])
query("source_map_tags", f"""
    WITH w AS (SELECT ord, coalesce(nullif(tags['website'], ''), nullif(tags['contact:website'], '')) AS u, coalesce(tags['name'], '') AS business FROM {ELEMENTS.sql}),
    h AS (SELECT *, regexp_replace({_host('u')}, '^www\\.', '') AS domain FROM w)
    SELECT domain, business FROM h WHERE domain IS NOT NULL AND domain <> 'facebook.com' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ord) = 1""")(
    lambda spark, sf_dir: parsers.map_elements(ELEMENTS.df(spark)))
REPLY = Rows("ip string, text string", [
    ("192.0.2.1", "<td>A.Shop.com</td><td> b.org.bd </td><b>plain</b><td>a.shop.com</td>"), ("192.0.2.2", "x.org\r\ny z\nsub.n.net\nnodot"), ("192.0.2.3", "API count exceeded"), ("192.0.2.4", "No DNS A records")])
query("source_reverse_html", rf"""
    SELECT ip, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)>\s*([a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)+\.[a-z]{{2,}})\s*<', 1), lambda x: lower(x)))), ';') AS hosts
    FROM {REPLY.sql}""")(lambda spark, sf_dir: REPLY.df(spark).select("ip", F.array_join(parsers.hosts_in_html(F.col("text")), ";").alias("hosts")))
query("source_reverse_lines", rf"""
    SELECT ip, CASE WHEN NOT regexp_matches(lower(text), 'api count exceeded|too many|rate limit') THEN CASE WHEN contains(lower(text), 'no dns a records') THEN ''
           ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: contains(x, '.') AND NOT contains(x, ' ')), ';') END END AS hosts FROM {REPLY.sql}""")(
    lambda spark, sf_dir: REPLY.df(spark).select("ip", F.array_join(parsers.hosts_in_lines(F.col("text")), ";").alias("hosts")))
RANKED = Rows("idx int, domain string", [(k, f"site{k}.org") for k in range(10)])
query("source_ranked_slice", f"SELECT idx, domain, 7 AS next_offset FROM {RANKED.sql} WHERE idx >= 4 AND idx < 7")(
    lambda spark, sf_dir: parsers.ranked_list(RANKED.df(spark), 4, 3)[0].crossJoin(F.broadcast(parsers.ranked_list(RANKED.df(spark), 4, 3)[1])))
query("source_ranked_end", f"SELECT count(*) AS n, 0 AS next_offset FROM {RANKED.sql} WHERE idx >= 8")(
    lambda spark, sf_dir: parsers.ranked_list(RANKED.df(spark), 8, 3)[0].agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(parsers.ranked_list(RANKED.df(spark), 8, 3)[1])))
FIRST = Rows("domain string, src string, ord int", [("a.org", "one", 0), ("b.org", "one", 1)])
AGAIN = Rows("domain string, src string, ord int", [("b.org", "two", 0), ("c.org", "two", 1), ("c.org", "two-b", 2)])
query("source_union", f"""
    SELECT domain, src, ord FROM (SELECT *, 0 AS k FROM {FIRST.sql} UNION ALL SELECT *, 1 FROM {AGAIN.sql}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY k, ord) = 1""")(
    lambda spark, sf_dir: parsers.union_sources([FIRST.df(spark), AGAIN.df(spark)]).select("domain", "src", "ord"))
TRIED = Rows("domain string, variant string, scheme string, status int, text string", [
    ("a.org", "browser", "https", 0, None), ("a.org", "browser", "http", 200, "plain"), ("b.org", "browser", "http", 200, "no"), ("b.org", "browser", "https", 200, "yes"), ("c.org", "bot", "https", None, "x")])
query("capture_scheme", f"""
    SELECT domain, variant, scheme, text FROM {TRIED.sql} QUALIFY row_number() OVER (PARTITION BY domain, variant ORDER BY coalesce(status, 0) = 0, scheme <> 'https') = 1""")(
    lambda spark, sf_dir: parsers.either_scheme(TRIED.df(spark)).drop("status"))
BODIES = Rows("id int, text string", [(0, "a" * 20), (1, "é" * 9), (2, "x" + "é" * 9), (3, ""), (4, None)])
query("capture_capped", f"SELECT id, CASE WHEN text IS NULL OR octet_length(encode(text)) <= 10 THEN text ELSE CASE id WHEN 0 THEN repeat('a', 10) WHEN 1 THEN repeat('é', 5) ELSE 'x' || repeat('é', 4) END END AS text FROM {BODIES.sql}")(
    lambda spark, sf_dir: BODIES.df(spark).select("id", parsers.capped(F.col("text"), 10).alias("text")))
ROBOTS = Rows("domain string, variant string, final_url string, text string", [
    ("a.org", "robots", "r", "Sitemap: https://a.org/m.xml\nsitemap: https://b.org/x.xml"), ("c.org", "robots", "r", "User-agent: *"),
    ("a.org", "sitemap", "https://a.org/m.xml", "<loc>https://a.org/k2.xml</loc><loc>https://a.org/k1.xml</loc><loc>https://z.org/k.xml</loc>"),
    ("c.org", "sitemap", "https://c.org/wp-sitemap.xml", "<loc>https://c.org/p</loc>"), ("c.org", "sitemap", "https://c.org/sitemap.xml", "")])
_ROBOTS = rf"""
    r AS (SELECT * FROM {ROBOTS.sql}),
    n AS (SELECT domain, CASE WHEN len(regexp_extract_all(text, '(?i)sitemap:\s*(https?://\S+)', 1)) > 0 THEN regexp_extract_all(text, '(?i)sitemap:\s*(https?://\S+)', 1)
                 ELSE ['https://' || domain || '/sitemap_index.xml', 'https://' || domain || '/wp-sitemap.xml', 'https://' || domain || '/sitemap.xml'] END[1:3] AS l FROM r WHERE variant = 'robots'),
    s AS (SELECT domain, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM n)"""
query("robots_sitemaps", f"WITH {_ROBOTS} SELECT domain, pos::INT AS pos, url FROM s WHERE contains(url, domain)")(lambda spark, sf_dir: parsers.robots_sitemaps(ROBOTS.df(spark)))
query("sitemap_walk", rf"""
    WITH {_ROBOTS},
    t AS (SELECT s.domain, s.pos, s.url, r.text FROM s JOIN r ON r.domain = s.domain AND r.variant = 'sitemap' AND r.final_url = s.url WHERE contains(s.url, s.domain) AND r.text <> ''),
    k AS (SELECT domain, pos, unnest(list_sort(list_distinct(regexp_extract_all(text, '(?i)https?://[^<\s"]+\.xml')))[1:6]) AS url FROM t),
    a AS (SELECT domain, pos, '' AS o, url FROM t UNION ALL SELECT domain, pos, url, url FROM k WHERE contains(url, domain))
    SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY pos, o) - 1)::INT AS seq, url FROM a""")(lambda spark, sf_dir: parsers.sitemap_walk(ROBOTS.df(spark)))


# ---------------------------------------------------------------- hosting

KNOWN = Rows("row_id int, domain string, bd_score int", [(k, f"k{k}.com.bd" if k % 2 else f"k{k}.org", 40 if k % 3 else 10) for k in range(9)])
DNS = Rows("domain string, ip string", [("k1.com.bd", "192.0.2.1"), ("k2.org", "192.0.2.1"), ("k4.org", "104.21.0.1"), ("k5.com.bd", "192.0.2.9")])
RDNS = Rows("ip string, host string", [("192.0.2.1", h) for h in ("k1.com.bd", "www.n.com.bd", "x.n.com.bd", "godaddy.com", "mm.net")] + [("192.0.2.9", "mm.net"), ("192.0.2.7", "far.org")])
query("seed_choice", f"SELECT row_id, domain FROM {KNOWN.sql} WHERE bd_score >= 25 ORDER BY row_id LIMIT 3 OFFSET 2")(lambda spark, sf_dir: cohost.seed_domains(KNOWN.df(spark), 25, 3, 2))
query("seed_choice_wrapped", f"SELECT row_id, domain FROM {KNOWN.sql} WHERE bd_score >= 25 ORDER BY row_id LIMIT 3")(lambda spark, sf_dir: cohost.seed_domains(KNOWN.df(spark), 25, 3, 200))
_CDN = rf"regexp_matches(ip, '{_PREFIX}')"
query("resolve_addresses", f"SELECT domain, ip FROM {KNOWN.sql} JOIN {DNS.sql} USING (domain) WHERE NOT {_CDN}")(lambda spark, sf_dir: cohost.resolve(KNOWN.df(spark), DNS.df(spark)))
query("resolve_addresses_marked", f"SELECT domain, CASE WHEN ip IS NULL OR {_CDN} THEN 'cdn' ELSE ip END AS ip FROM {KNOWN.sql} LEFT JOIN {DNS.sql} USING (domain)")(
    lambda spark, sf_dir: cohost.resolve(KNOWN.df(spark), DNS.df(spark), keep_cdn=True))
_RHOST = "array_to_string(string_split(host, '.')[CASE WHEN host LIKE '%.com.bd' THEN -3 ELSE -2 END:], '.')"
query("neighbour_domains", f"""
    SELECT d AS domain, count(DISTINCT ip) AS ips, least(100, 25 + 40 * (d LIKE '%.bd')::INT) AS bd_score, CASE WHEN d LIKE '%.bd' THEN 50 ELSE 30 END AS edge_score
    FROM (SELECT ip, {_RHOST} AS d FROM {RDNS.sql} WHERE ip IN (SELECT ip FROM {DNS.sql}))
    WHERE d NOT IN ({', '.join(map(_quoted, sorted(P.HOST_PROVIDERS)))}) AND d NOT IN (SELECT domain FROM {KNOWN.sql}) GROUP BY 1""")(
    lambda spark, sf_dir: cohost.neighbours(DNS.df(spark), RDNS.df(spark), KNOWN.df(spark)).withColumn("edge_score", cohost.edge_score(F.col("domain"))))
query("hotspots_open", f"SELECT ip, count(DISTINCT domain) AS leads FROM {DNS.sql} WHERE ip <> '192.0.2.1' GROUP BY 1")(
    lambda spark, sf_dir: cohost.hotspots(DNS.df(spark), DNS.df(spark).where("ip = '192.0.2.1'").select("ip")))
query("hotspot_summary", f"""
    WITH l AS (SELECT ip, count(DISTINCT domain) AS leads FROM {DNS.sql} GROUP BY 1), h AS (SELECT ip, {_RHOST} AS d FROM {RDNS.sql}),
    p AS (SELECT ip, count(*) AS cohosted, count(DISTINCT CASE WHEN d NOT IN (SELECT domain FROM {DNS.sql}) AND d NOT IN ({', '.join(map(_quoted, sorted(P.HOST_PROVIDERS)))}) THEN d END) AS new FROM h GROUP BY 1)
    SELECT l.ip, leads, coalesce(cohosted, 0) AS cohosted, coalesce(new, 0) AS new FROM l LEFT JOIN p USING (ip)""")(lambda spark, sf_dir: cohost.hotspot_summary(DNS.df(spark), RDNS.df(spark)))  # fmt: skip


# ---------------------------------------------------------------- state, queue and views

COUNTERS = Rows("metric string, value long", [("scanned", 5), ("leads", 2)])
query("counter_add", f"SELECT metric, value + CASE metric WHEN 'scanned' THEN 7 ELSE 0 END AS value FROM {COUNTERS.sql}")(
    lambda spark, sf_dir: state.add_to_counter(state.add_to_counter(COUNTERS.df(spark), "scanned", 7), "unseeded", 3))
query("counter_recount", f"SELECT metric, CASE metric WHEN 'leads' THEN (SELECT count(*) FROM {JOINED.sql}) ELSE value END AS value FROM {COUNTERS.sql}")(
    lambda spark, sf_dir: state.recount(COUNTERS.df(spark), "leads", JOINED.df(spark)))
query("append_findings", f"SELECT domain, ts FROM {JOINED.sql} UNION ALL SELECT domain, ts FROM {JOINED.sql}")(
    lambda spark, sf_dir: state.append_findings(JOINED.df(spark), JOINED.df(spark)).select("domain", "ts"))
NEWER = Rows(JOINED.schema, [("a.org", 1, "lead", 9), ("a.org", 1, "lead", 8)])
query("replace_manual", f"""
    SELECT domain, ts FROM {JOINED.sql} WHERE NOT (domain IN (SELECT domain FROM {NEWER.sql}) AND coalesce(is_manual, 0) = 1) UNION ALL
    SELECT domain, ts FROM {NEWER.sql} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC) = 1""")(
    lambda spark, sf_dir: state.replace_manual(JOINED.df(spark), NEWER.df(spark)).select("domain", "ts"))
FINDINGS = Rows("id int, domain string, address string, district string, phone string, confirmed int, ip string, status string, ts int", [
    (1, "a.com", None, None, "", 1, None, "lead", 5), (2, "b.com", None, None, "1", 0, "", "lead", 6), (3, "c.com", "", None, None, 1, "192.0.2.5", "rejected", 7),
    (4, "d.com", "x", "", "2", 1, None, None, 8), (5, "e.com", "", "", None, 1, "", "lead", 9)])
CONTACTS = Rows("domain string, address string, district string, phone string", [("a.com", "", "Dhaka", "017"), ("b.com", "x", "y", "z")])
query("contacts_backfill", f"""
    SELECT id, CASE WHEN hit THEN coalesce(nullif(c.address, ''), '-') ELSE f.address END AS address, CASE WHEN hit THEN coalesce(nullif(c.district, ''), '-') ELSE f.district END AS district,
           CASE WHEN hit AND coalesce(f.phone, '') = '' THEN c.phone ELSE f.phone END AS phone
    FROM (SELECT *, confirmed = 1 AND domain IN (SELECT domain FROM {CONTACTS.sql}) AS hit FROM {FINDINGS.sql}) f LEFT JOIN {CONTACTS.sql} c USING (domain)""")(
    lambda spark, sf_dir: state.backfill_contacts(FINDINGS.df(spark), CONTACTS.df(spark)).select("id", "address", "district", "phone"))
FOUND = Rows("ord int, domain string, ip string", [(1, "https://A.com/", "192.0.2.1"), (2, "a.com", " 192.0.2.2 "), (3, "b.com", "no ip"), (4, "e.com", "2001:db8::7")])
query("addresses_stored", rf"""
    WITH g AS (SELECT ord, regexp_replace({_host('trim(domain)')}, '^www\.', '') AS domain, substr(trim(ip), 1, 45) AS new FROM {FOUND.sql} WHERE regexp_matches(trim(ip), '^[0-9a-fA-F:.]+$')),
    b AS (SELECT domain, arg_max(new, ord) AS new FROM g GROUP BY 1)
    SELECT id, coalesce(new, ip) AS ip FROM {FINDINGS.sql} LEFT JOIN b USING (domain)""")(lambda spark, sf_dir: state.store_addresses(FINDINGS.df(spark), FOUND.df(spark)).select("id", "ip"))
query("status_set", f"SELECT id, CASE id WHEN 1 THEN 'rejected' WHEN 3 THEN 'lead' ELSE status END AS status FROM {FINDINGS.sql}")(
    lambda spark, sf_dir: state.set_status(state.set_status(FINDINGS.df(spark), 1, "whatever"), 3, "lead").select("id", "status"))
CHANGES = Rows("id int, status string, phone string", [(2, "review", None), (9, "lead", "x")])
query("updated_by_id", f"SELECT f.id, CASE WHEN c.id IS NOT NULL THEN c.status ELSE f.status END AS status, CASE WHEN c.id IS NOT NULL THEN c.phone ELSE f.phone END AS phone FROM {FINDINGS.sql} f LEFT JOIN {CHANGES.sql} c ON c.id = f.id")(
    lambda spark, sf_dir: state.update_by_id(FINDINGS.df(spark), CHANGES.df(spark), "id", ["status", "phone"]).select("id", "status", "phone"))
query("contact_candidates", f"SELECT domain FROM {FINDINGS.sql} WHERE confirmed = 1 AND status <> 'rejected' AND coalesce(address, '') = '' AND coalesce(district, '') = ''")(
    lambda spark, sf_dir: dashboard.contact_candidates(FINDINGS.df(spark)))
query("address_candidates", f"SELECT domain FROM {FINDINGS.sql} WHERE confirmed = 1 AND status <> 'rejected' AND coalesce(ip, '') = ''")(
    lambda spark, sf_dir: dashboard.address_candidates(FINDINGS.df(spark)))
query("findings_json", f"SELECT to_json({{'id': id, 'domain': domain, 'ts': ts}})::VARCHAR AS body FROM {FINDINGS.sql}")(
    lambda spark, sf_dir: dashboard.as_json(FINDINGS.df(spark).select("id", "domain", "ts")))
REGISTRY = Rows("row_id int, domain string, pass_no int", [(k, f"r{k}.com.bd" if k % 2 else f"R{k}.BD" if k == 4 else f"r{k}.org", k % 3) for k in range(8)])
query("registry_counts", f"SELECT count_if(domain ILIKE '%.bd')::BIGINT AS bd_domains, count_if(pass_no = 0)::BIGINT AS unscanned FROM {REGISTRY.sql}")(lambda spark, sf_dir: dashboard.registry_counts(REGISTRY.df(spark)))
query("seeds_page", f"SELECT row_id, domain, (SELECT count(*) FROM {REGISTRY.sql} WHERE domain ILIKE '%.bd') AS total FROM {REGISTRY.sql} WHERE domain ILIKE '%.bd' ORDER BY row_id LIMIT 2 OFFSET 1")(
    lambda spark, sf_dir: dashboard.seeds(REGISTRY.df(spark), 2, 1))
HOURLY = Rows("hour string, scanned int", [("2024-01-02-00", 3), ("2024-01-02-00", 4), ("2024-01-01-23", 9)])
query("rate_this_hour", f"SELECT sum(scanned)::BIGINT AS scanned FROM {HOURLY.sql} WHERE hour = '2024-01-02-00'")(lambda spark, sf_dir: dashboard.rate_this_hour(HOURLY.df(spark), 1_704_132_000))
SOURCES = Rows("source string, total_harvested int, last_run int", [("a", 5, 1), ("b", 9, 2), ("c", 5, 3), ("d", 1, 4)])
query("top_sources", f"SELECT * FROM {SOURCES.sql} ORDER BY total_harvested DESC, source LIMIT 3")(lambda spark, sf_dir: dashboard.top_sources(SOURCES.df(spark), 3))
USAGE = Rows("key_id string, day string, requests int", [("k1", "2024-01-02", 4), ("k2", "2024-01-02", 8), ("k1", "2024-01-01", 99)])
query("key_usage_today", f"SELECT * FROM {USAGE.sql} WHERE day = '2024-01-02'")(lambda spark, sf_dir: dashboard.key_usage_today(USAGE.df(spark), 1_704_132_000))
WORKERS = Rows("worker_id string, last_seen int", [("a", 9_101), ("b", 9_100), ("c", 9_099)])
query("live_workers", f"SELECT * FROM {WORKERS.sql} WHERE last_seen > 10000 - 900")(lambda spark, sf_dir: dashboard.live_workers(WORKERS.df(spark), 10_000))
BATCHES = Rows("batch_id int, status string, claimed_by string, claimed_ts int, done_ts int, scanned int, flagged int, confirmed int, errors int", [
    (3, "done", "w", 0, 1, 1, 1, 1, 0), (5, "claimed", "w", 8199, None, None, None, None, None), (4, "claimed", "v", 8200, None, None, None, None, None), (9, "ready", None, 0, None, None, None, None, None)])
query("batch_claimed", f"SELECT batch_id, CASE batch_id WHEN 9 THEN 'claimed' ELSE status END AS status, CASE batch_id WHEN 9 THEN 'me' ELSE claimed_by END AS claimed_by, CASE batch_id WHEN 9 THEN 10000 ELSE claimed_ts END AS claimed_ts FROM {BATCHES.sql}")(
    lambda spark, sf_dir: workqueue.claim(BATCHES.df(spark), 9, "me", 10_000).select("batch_id", "status", "claimed_by", "claimed_ts"))
_STALE = "status = 'claimed' AND claimed_ts < 10000 - 1800"
query("batch_requeued", f"SELECT batch_id, CASE WHEN {_STALE} THEN 'ready' ELSE status END AS status, CASE WHEN NOT ({_STALE}) THEN claimed_by END AS claimed_by FROM {BATCHES.sql}")(
    lambda spark, sf_dir: workqueue.requeue_stale(BATCHES.df(spark), 10_000).select("batch_id", "status", "claimed_by"))
DONE = Rows("batch_id int, done_ts int, scanned int, flagged int, confirmed int, errors int", [(4, 10_050, 7, 2, 1, 0)])
query("batch_finished", f"""SELECT b.batch_id, CASE WHEN d.batch_id IS NOT NULL THEN 'done' ELSE status END AS status, coalesce(d.done_ts, b.done_ts, -1) AS done_ts, coalesce(d.scanned, b.scanned, -1) AS scanned,
    coalesce(d.confirmed, b.confirmed, -1) AS confirmed FROM {BATCHES.sql} b LEFT JOIN {DONE.sql} d ON d.batch_id = b.batch_id""")(
    lambda spark, sf_dir: workqueue.finish(BATCHES.df(spark), DONE.df(spark)).na.fill(-1).select("batch_id", "status", "done_ts", "scanned", "confirmed"))
QUEUE = Rows("row_id int, batch_id int, domain string, business string, phone string", [(1, 4, "a.org", "A", None), (2, 5, "b.org", None, "2"), (3, None, "c.org", None, None), (4, 4, "d.org", "D", "4")])
query("batch_domains", f"SELECT batch_id, domain, business, phone FROM {QUEUE.sql} WHERE batch_id = 4")(
    lambda spark, sf_dir: workqueue.batch_domains(QUEUE.df(spark), BATCHES.df(spark).where("batch_id = 4")))
PENDING = Rows("row_id int, batch_id int, added_ts int", [(k * 3, None, 100 + k) for k in range(7)] + [(99, 1, 0)])
query("batches_of_pending", f"""
    SELECT row_id, (5 + (row_number() OVER (ORDER BY row_id) - 1) // 3)::BIGINT AS batch_id FROM {PENDING.sql} WHERE batch_id IS NULL""")(
    lambda spark, sf_dir: workqueue.assign_batches(PENDING.df(spark), 10_000, 5, size=3).select("row_id", "batch_id"))
query("merged_results", f"SELECT * FROM {USAGE.sql} UNION ALL SELECT * FROM {USAGE.sql}")(lambda spark, sf_dir: state.merge_results([USAGE.df(spark), USAGE.df(spark)]))
SITES_TEXT = Rows("reg string, title string, body string", [
    ("x.gov.bd", "", ""), ("school.edu.bd", "", "hospital"), ("a.org", "Best Restaurant", ""), ("b.org", "", "shop store"), ("c.org", "", "one hospital only"), ("d.org", "nothing", ("pad " * 700) + "hospital hospital")])
query("biz_type_cases", f"SELECT reg, CASE reg WHEN 'x.gov.bd' THEN 'government' WHEN 'school.edu.bd' THEN 'education' WHEN 'a.org' THEN 'food' WHEN 'b.org' THEN 'ecommerce' ELSE 'general-business' END AS biz FROM {SITES_TEXT.sql}")(
    lambda spark, sf_dir: SITES_TEXT.df(spark).select("reg", biz_type(F.col("reg"), F.col("title"), F.col("body")).alias("biz")))
PLACES = Rows("id int, html string", [
    (0, "mail info@shop.com.bd House 12, Road 5, Dhanmondi phone 01712345678"), (1, "<img src='x@2x.png'> Level 4, Some Tower, Gazipur +880-1812345678"), (2, "House 3 nowhere"), (3, "")])
query("contact_places", rf"""
    SELECT id, coalesce(regexp_replace(nullif(regexp_extract(html, '(?:\+?880[\s-]?|0)1[3-9]\d{{8}}'), ''), '[\s-]', '', 'g'), '') AS phone,
           CASE id WHEN 0 THEN 'Dhaka' WHEN 1 THEN 'Gazipur' ELSE '' END AS district, regexp_extract(html, 'Dhanmondi') AS area FROM {PLACES.sql}""")(
    lambda spark, sf_dir: extract_contacts(PLACES.df(spark), "id", "html", "html").select("id", "phone", "district", "area"))
MARKUP = Rows("id int, text string", [(0, "<b>a&nbsp;b</b>  &amp; c"), (1, "<style>x</style>t<br>u"), (2, "&lt;kept&gt;"), (3, "")])
query("visible_text_resolved", f"SELECT id, CASE id WHEN 0 THEN 'a b & c' WHEN 1 THEN 't u' WHEN 2 THEN '<kept>' ELSE '' END AS text FROM {MARKUP.sql}")(
    lambda spark, sf_dir: MARKUP.df(spark).select("id", X.strip_html_unescaped(F.col("text")).alias("text")))
