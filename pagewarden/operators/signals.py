"""Detection layers: from captured pages to signals.

``captures``: domain, variant, seq, status, final_url, headers, text.  Each
layer gives rows (domain, ord, bucket, layer, match, url); ``ord`` is the order
of emission, which later ties depend on.  The single-page layers are one
projection over one row per domain; only item and sitemap layers explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.domains import bd_signal, domain_spammy, host_of, last_segment, parent_path, same_host, url_path, without_www
from ..functions.text import (
    FLAGS, collapse, distinct_matches, first_match, foreign_script, gibberish, html_unescape, json_objects, matches,
    obfuscation_parts, obfuscation_score, strip_html, title_of,
)
from .classify import biz_type
from .settle import settle

SIGNAL = "domain string, ord int, bucket string, layer string, match string, url string"
HOME_VARIANTS = ("browser", "bot", "referer", "mobile")
# Patterns of page structure.
IFRAME = r'<(iframe|script)[^>]+src="https?://[^"]*(casino|slot|judi|togel|xbet|melbet|bet[0-9]|gacor|sbobet)[^"]*"'
RELAY = r'<link[^>]+rel="(?:alternate|canonical)"[^>]+href="https?://([^/"]+)'
RELAY_SKIP = r"cloudflare|cloudfront|akamai|fastly|jsdelivr|gstatic|googleusercontent|bunny|wp\.com|w\.org|gravatar|youtube|facebook|googleapis"
HIDDEN_BLOCK = r'(?s)<(div|span|p|section|footer|ul|a)\b([^>]*style="[^"]*")[^>]*>(.*?)</\1>'
HIDDEN_STYLE = (
    r"(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|text-indent\s*:\s*-\s*\d{3,}|(?:left|top)\s*:\s*-\s*\d{3,}\s*px|"
    r"height\s*:\s*0(?:px|;|\s)|opacity\s*:\s*0\b|clip\s*:\s*rect\(0)"
)
HIDDEN_ALLOWED = (
    r"sr-only|screen-reader-text|visually-hidden|elementor-screen-only|wp-block-|skip-link|assistive|aria-hidden|googlemaps|gmap"
)
FEED_TEXT = r"<(?:title|description)>[^<]*</(?:title|description)>"
SHAPE_SKIP = r"/wp-content/|/wp-includes/|/cdn-cgi/|/wp-json/|[0-9a-f]{8,}"
RANDOM_DIR = r"/[a-z]{5,}/[0-9]{1,4}\.html?($|[?#])"
LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
PAGE_URL = r'https?://[^<\s"]+'


def homepages(captures: DataFrame) -> DataFrame:
    """One row per domain: text and address of each home variant; missing variants are empty.  Unreachable domains go."""
    rows = captures.where(F.col("variant").isin(*HOME_VARIANTS)).withColumn("domain", F.lower(F.trim("domain")))
    # Where a variant was captured more than once, the first capture that has the value counts; ties go by the value.
    pick = lambda v, c: F.min_by(F.col(c), F.when((F.col("variant") == v) & F.col(c).isNotNull(), F.struct("seq", "status", "final_url", "text")))
    cols = []
    for v in HOME_VARIANTS:
        cols += [F.coalesce(pick(v, "text"), F.lit("")).alias(v), F.coalesce(pick(v, "final_url"), F.lit("")).alias(f"{v}_url")]
    cols += [pick("bot", "headers").alias("bot_headers"), F.coalesce(pick("browser", "status"), F.lit(0)).alias("http_status")]
    return rows.groupBy("domain").agg(*cols).where("http_status != 0").withColumn("reg", without_www(F.col("domain")))


def _signal(bucket: str, layer: str, match: Column, url: Column, when: Column) -> Column:
    s = F.struct(F.lit(bucket).alias("bucket"), F.lit(layer).alias("layer"), F.substring(match, 1, 200).alias("match"), url.alias("url"))
    return F.when(when, s)


def _joined(items: Column) -> Column:
    return F.array_join(items, ";")


def hidden_links(text: Column, reg: Column, strong: str, weak: str) -> Column:
    """The first invisible block with a spam word or five links to other sites, or null.

    Entities in the block's text are dropped rather than resolved.
    """
    inner = lambda b: F.regexp_extract(b, FLAGS + HIDDEN_BLOCK, 3)
    style = lambda b: F.regexp_extract(b, FLAGS + HIDDEN_BLOCK, 2)
    hidden = F.filter(matches(text, HIDDEN_BLOCK), lambda b: style(b).rlike(FLAGS + HIDDEN_STYLE) & ~b.rlike(FLAGS + HIDDEN_ALLOWED))

    def judge(b: Column) -> Column:
        words = F.trim(strip_html(inner(b)))
        links = F.regexp_extract_all(inner(b), F.lit(FLAGS + r'href="(https?://[^"]+)"'), F.lit(1))
        off = F.size(F.filter(links, lambda u: ~same_host(host_of(u), reg)))
        word = F.coalesce(first_match(words, strong), first_match(words, weak))
        tag = F.coalesce(word, F.concat(off.cast("string"), F.lit("-offdomain-anchors")))
        said = F.concat(F.lit("hidden["), tag, F.lit("]: "), F.substring(F.when(words != "", words).otherwise(b), 1, 160))
        return F.when(word.isNotNull() | (off >= 5), F.substring(said, 1, 200))

    return F.when(text.rlike(FLAGS + HIDDEN_STYLE), F.get(F.array_compact(F.transform(hidden, judge)), F.lit(0)))


def page_signals(home: DataFrame, strong: str = P.ALL_STRONG, weak: str = P.ALL_WEAK, gambling_weak: str = P.RX_GAMB_WEAK) -> DataFrame:
    """Signals of the home page variants; columns of ``home`` that later steps need stay beside the array ``found``."""
    rows = home
    for v in ("browser", "bot", "referer"):
        rows = rows.withColumn(f"visible_{v}", strip_html(F.col(v)))
        rows = rows.withColumn(f"strong_{v}", distinct_matches(F.col(f"visible_{v}"), strong))
    rows = rows.withColumn("weak", distinct_matches(F.col("visible_browser"), weak))
    title = title_of(F.col("browser"))
    rows = rows.withColumn("title", F.when(title != "", title).otherwise(title_of(F.col("bot"))))
    rows = rows.withColumn("both", F.concat("browser", "bot"))
    rows = rows.withColumn("deface", distinct_matches(F.col("both"), P.RX_DEFACE)).withColumn("campaign", distinct_matches(F.col("both"), P.RX_MALJS))
    rows = rows.withColumn("obfuscation", obfuscation_parts(F.col("browser")))
    frames = F.transform(matches(F.col("both"), IFRAME), lambda m: F.regexp_extract(m, FLAGS + r'https?://[^"]+', 0))
    rows = rows.withColumn("frames", F.array_sort(F.array_distinct(frames)))
    relays = F.transform(F.regexp_extract_all("bot", F.lit(FLAGS + RELAY), F.lit(1)), F.lower)
    rows = rows.withColumn("relays", F.array_sort(F.array_distinct(F.filter(
        relays, lambda h: (h != "") & ~same_host(h, F.col("reg")) & ~h.rlike(FLAGS + RELAY_SKIP)))))
    rows = rows.withColumn("hidden", hidden_links(F.col("browser"), F.col("reg"), strong, gambling_weak))
    root = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    bot_only, ref_only = (F.array_except(f"strong_{v}", "strong_browser") for v in ("bot", "referer"))
    mobile, browser = host_of(F.col("mobile_url")), host_of(F.col("browser_url"))
    some = lambda c: F.size(c) > 0
    score = obfuscation_score(F.col("obfuscation"))
    waf = first_match(F.col("browser"), P.RX_WAF)
    found = [
        _signal("control", "L18CHALLENGE", waf, root, waf.isNotNull()),
        _signal("homepage-content", "L1KW_STRONG", _joined(F.col("strong_browser")), root, some("strong_browser")),
        _signal("homepage-content", "L1KW_WEAK", _joined(F.col("weak")), root, some("weak")),
        _signal("cloak-diff", "L2UACLOAK", _joined(bot_only), root, some(bot_only)),
        _signal("cloak-diff", "L3REFCLOAK", _joined(ref_only), root, some(ref_only)),
        _signal("redirect", "L4MOBILE", mobile, F.col("mobile_url"), (mobile != "") & ~same_host(mobile, F.col("reg"))),
        _signal("redirect", "L9REDIR", browser, F.col("browser_url"), (browser != "") & ~same_host(browser, F.col("reg"))),
        _signal("homepage-content", "L10LANG", F.col("title"), root, foreign_script(F.col("title"))),
        _signal("deface", "L10DEFACE", _joined(F.col("deface")), root, some("deface")),
        _signal("malware-js", "L14CAMPAIGN", _joined(F.slice("campaign", 1, 3)), root, some("campaign")),
        _signal("malware-js", "L14OBFUS", F.concat(F.lit("score="), score.cast("string"), F.lit(":"), F.array_join("obfuscation", ",")), root, score >= 4),
        _signal("malware-js", "L8IFRAME", _joined(F.slice("frames", 1, 2)), root, some("frames")),
        _signal("homepage-content", "L17HIDDEN", F.col("hidden"), root, F.col("hidden").isNotNull()),
        _signal("redirect", "L20RELAY", _joined(F.slice("relays", 1, 2)), root, some("relays")),
    ]
    rows = rows.withColumn("found", F.array_compact(F.array(*found)))
    header = lambda name: F.get(F.map_values(F.map_filter("bot_headers", lambda k, v: (F.lower(k) == name) & (v != ""))), F.lit(0))
    target = F.coalesce(header("location"), header("refresh"), F.lit(""))
    target = F.coalesce(first_match(target, PAGE_URL), target)
    rows = rows.withColumn("target", target)
    away = host_of(F.col("target"))
    bad = F.col("target").rlike(FLAGS + P.RX_GAMB_STRONG) | F.col("target").rlike(FLAGS + P.RX_JUNKTLD)
    rows = rows.withColumn("header", _signal("redirect", "L16HDR", F.col("target"), root, (away != "") & ~same_host(away, F.col("reg")) & bad))
    return rows.select(
        "domain", "reg", "http_status", "title", "visible_browser", "found", "header", (F.size("found") > 0).alias("fired"))


def wp_items(captures: DataFrame) -> DataFrame:
    """Posts and pages from captured REST replies: (domain, type, page, pos, slug, title, link).

    A title may be an object with ``rendered`` or a plain string.  Elements that
    are no objects are passed over.  Pages count up to the first one that is no
    JSON array or names no slug.
    """
    rows = captures.where(F.col("variant").isin("wp_posts", "wp_pages"))
    kind = F.when(F.col("variant") == "wp_posts", "posts").otherwise("pages")
    items = json_objects(F.col("text"), "array<string>")
    rows = rows.select(F.lower(F.trim("domain")).alias("domain"), kind.alias("type"), F.col("seq").alias("page"), "text", items.alias("items"))
    good = F.col("items").isNotNull() & F.coalesce(F.col("text").contains('"slug"'), F.lit(False))
    upto = Window.partitionBy("domain", "type").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("good", good).withColumn("open", F.min(F.col("good")).over(upto)).where("open")
    rows = rows.where((F.col("type") == "posts") & (F.col("page") <= 5) | (F.col("page") <= 1))
    rows = rows.select("domain", "type", "page", F.posexplode("items").alias("pos", "item")).where(F.col("item").startswith("{"))
    part = lambda path: F.get_json_object("item", path)
    rich = F.coalesce(part("$.title"), F.lit("")).startswith("{")
    title = F.coalesce(F.when(rich, part("$.title.rendered")).otherwise(part("$.title")), F.lit(""))
    return rows.select(
        "domain", "type", "page", "pos", F.trim(F.coalesce(part("$.slug"), F.lit(""))).alias("slug"),
        collapse(html_unescape(title)).alias("title"), F.trim(F.coalesce(part("$.link"), F.lit(""))).alias("link"))


def _first(rows: DataFrame, n: int, order: str, *columns: str) -> DataFrame:
    """The first ``n`` rows of each domain as a sorted array ``first``; only those leave a task."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy(order, *columns))
    rows = rows.withColumn("place", place).where(F.col("place") <= n)
    return rows.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("first"))


def enumeration_signals(items: DataFrame, totals: DataFrame, strong: str = P.ALL_STRONG, slug_spam: str = P.RX_SLUG_SPAM) -> DataFrame:
    """L11REST, L20SCRIPT and L20MASS_CAND from items and ``totals`` (domain, wp_total); ``ord`` starts at 1000."""
    key = F.when(F.col("slug") != "", F.col("slug")).otherwise(F.substring("title", 1, 40))
    spam = ((F.col("slug") != "") & F.col("slug").rlike(FLAGS + slug_spam)) | ((F.col("title") != "") & F.col("title").rlike(FLAGS + strong))
    rows = items.withColumn("key", key).withColumn("at", F.when(F.col("type") == "posts", 0).otherwise(100_000) + F.col("page") * 1000 + F.col("pos"))
    hits = rows.where(spam & (F.col("key") != ""))
    once = F.row_number().over(Window.partitionBy("domain", "type", "page", "key").orderBy("pos"))
    hits = hits.withColumn("n", once).where("n = 1")
    rest = hits.select(
        "domain", (F.lit(1000) + F.col("at")).cast("int").alias("ord"), F.lit("content-enum").alias("bucket"), F.lit("L11REST").alias("layer"),
        F.concat(F.lit("slug="), F.substring("slug", 1, 60), F.lit("::"), F.substring("title", 1, 90)).alias("match"),
        F.substring("link", 1, 130).alias("url"))
    listing = F.concat(F.lit("https://"), F.col("domain"), F.lit("/wp-json/wp/v2/posts"))
    other = foreign_script(F.col("title"))
    counts = rows.groupBy("domain").agg(F.count_if(other).alias("foreign"), F.count(F.lit(1)).alias("total"))
    counts = counts.where("foreign >= 4 AND foreign * 100 < total * 30")
    samples = _first(rows.where(other).select("domain", "at", F.substring("title", 1, 40).alias("t")), 3, "at", "t")
    counts = counts.join(samples, "domain")
    shown = F.array_join(F.transform("first", lambda x: x["t"]), " | ")
    script = counts.select(
        "domain", F.lit(300_000).alias("ord"), F.lit("content-enum").alias("bucket"), F.lit("L20SCRIPT").alias("layer"),
        F.concat(F.format_string("foreign=%d/%d:", "foreign", "total"), shown).alias("match"), listing.alias("url"))
    mass = totals.where("wp_total >= 300").select(
        "domain", F.lit(300_001).alias("ord"), F.lit("content-enum").alias("bucket"), F.lit("L20MASS_CAND").alias("layer"),
        F.format_string("x-wp-total=%d", "wp_total").alias("match"), listing.alias("url"))
    out = rest.unionByName(script).unionByName(mass)
    return out.withColumn("match", F.substring("match", 1, 200))


def wp_totals(captures: DataFrame) -> DataFrame:
    """(domain, wp_total) where a post listing told its size."""
    total = F.get(F.map_values(F.map_filter("headers", lambda k, v: (F.lower(k) == "x-wp-total") & v.rlike("^[0-9]+$"))), F.lit(0))
    rows = captures.where("variant = 'wp_posts'").select(F.lower(F.trim("domain")).alias("domain"), total.cast("long").alias("wp_total"))
    return rows.where("wp_total IS NOT NULL").groupBy("domain").agg(F.max("wp_total").alias("wp_total"))


def sitemap_locations(captures: DataFrame) -> DataFrame:
    """(domain, reg, pos, url, listed) from captured sitemaps; ``listed`` marks <loc> entries."""
    rows = captures.where("variant = 'sitemap'").select(F.lower(F.trim("domain")).alias("domain"), "seq", "text")
    urls = matches(F.col("text"), PAGE_URL)
    every = rows.select("domain", "seq", F.posexplode(urls).alias("p", "url")).withColumn("listed", F.lit(False))
    locs = rows.select("domain", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(FLAGS + LOC), F.lit(1))).alias("p", "url"))
    out = every.unionByName(locs.withColumn("listed", F.lit(True)))
    return out.select("domain", without_www(F.col("domain")).alias("reg"), (F.col("seq") * 1_000_000 + F.col("p")).alias("pos"), "url", "listed")


def sitemap_signals(locations: DataFrame, slug_spam: str = P.RX_SLUG_SPAM) -> DataFrame:
    """L11SITEMAP (first three spam addresses) and L20SHAPE (the densest directory of random names); ``ord`` from 400000."""
    mine = locations.where(F.col("url").contains(F.col("reg")))
    spam = mine.where(~F.col("listed") & ~F.lower("url").endswith(".xml") & F.col("url").rlike(FLAGS + slug_spam))
    doorway = _first(spam, 3, "pos", "url").select(
        "domain", F.lit(400_000).alias("ord"), F.lit("sitemap-doorway").alias("bucket"), F.lit("L11SITEMAP").alias("layer"),
        F.substring(F.array_join(F.transform("first", lambda x: x["url"]), ";"), 1, 200).alias("match"),
        F.get("first", F.lit(0))["url"].alias("url"))
    has = locations.groupBy("domain").agg(F.max("listed").alias("has"))
    shaped = mine.join(has, "domain").where(F.col("listed") == F.col("has")).where(~F.col("url").rlike(FLAGS + SHAPE_SKIP))
    shaped = shaped.withColumn("path", url_path(F.col("url")))
    shaped = shaped.withColumn("parent", parent_path(F.col("path"))).withColumn("segment", last_segment(F.col("path")))
    per = shaped.groupBy("domain", "parent").agg(
        F.count_if(F.col("url").rlike(FLAGS + RANDOM_DIR)).alias("random"), F.count_if(gibberish(F.col("segment"))).alias("gib"), F.min("pos").alias("pos"))
    top = per.groupBy("domain").agg(
        F.max("random").alias("random"), F.max("gib").alias("gib"),
        F.max_by("parent", F.struct("random", -F.col("pos"))).alias("random_parent"), F.max_by("parent", F.struct("gib", -F.col("pos"))).alias("gib_parent"))
    top = top.where("random >= 6 OR gib >= 10")
    parent = F.when((F.col("random") > 0) & (F.col("random") >= F.col("gib")), F.col("random_parent")).otherwise(F.col("gib_parent"))
    shape = top.withColumn("parent", parent).select(
        "domain", F.lit(400_001).alias("ord"), F.lit("sitemap-doorway").alias("bucket"), F.lit("L20SHAPE").alias("layer"),
        F.substring(F.format_string("randomdir=%d gibberish=%d parent=%s", "random", "gib", "parent"), 1, 200).alias("match"),
        F.concat(F.lit("https://"), F.col("domain"), F.col("parent"), F.lit("/")).alias("url"))
    return doorway.unionByName(shape)


def feed_signals(captures: DataFrame, strong: str = P.ALL_STRONG) -> DataFrame:
    """L16FEED: strong words in titles and descriptions of the first feed that has any."""
    rows = captures.where("variant = 'feed'").select(F.lower(F.trim("domain")).alias("domain"), "seq", "final_url", "text")
    words = distinct_matches(F.array_join(matches(F.col("text"), FEED_TEXT), " "), strong)
    rows = rows.withColumn("words", words).where(F.size("words") > 0)
    first = rows.groupBy("domain").agg(F.min_by(F.struct("words", "final_url"), "seq").alias("f"))
    return first.select(
        "domain", F.lit(500_000).alias("ord"), F.lit("content-enum").alias("bucket"), F.lit("L16FEED").alias("layer"),
        F.substring(F.array_join("f.words", ";"), 1, 200).alias("match"), F.coalesce("f.final_url", F.lit("")).alias("url"))


def search_signals(captures: DataFrame, strong: str = P.ALL_STRONG, least: int = 4) -> DataFrame:
    """L5DENSITY: ``least`` or more strong words on one of the site's own search pages."""
    rows = captures.where("variant = 'search'").select(F.lower(F.trim("domain")).alias("domain"), "text")
    n = F.regexp_count(strip_html(F.coalesce("text", F.lit(""))), F.lit(FLAGS + strong))
    best = rows.groupBy("domain").agg(F.max(n).alias("n")).where(F.col("n") >= least)
    return best.select(
        "domain", F.lit(700_000).alias("ord"), F.lit("search-index").alias("bucket"), F.lit("L5DENSITY").alias("layer"),
        F.format_string("count=%d", "n").alias("match"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/?s=casino")).alias("url"))


def scan(captures: DataFrame, strong: str = P.ALL_STRONG, weak: str = P.ALL_WEAK) -> tuple[DataFrame, DataFrame]:
    """(signals, context): all layers with their gates, and what later steps need to know of each flagged domain.

    Sitemap and feed layers count only where a page signal fired or the site told
    a post total; the search layer only with a post total.
    """
    page = settle(page_signals(homepages(captures), strong, weak))
    totals = wp_totals(captures).join(page.select("domain"), "domain", "left_semi")
    gate = page.select("domain", "fired").join(totals, "domain", "left").where("fired OR wp_total IS NOT NULL").select("domain")
    wp = totals.select("domain")
    first = page.select("domain", F.posexplode("found").alias("ord", "s")).select("domain", "ord", "s.*")
    header = page.where("header IS NOT NULL").select("domain", F.lit(600_000).alias("ord"), "header.*")
    parts = [
        first, enumeration_signals(wp_items(captures).join(wp, "domain", "left_semi"), totals, strong),
        sitemap_signals(sitemap_locations(captures)).join(gate, "domain", "left_semi"),
        feed_signals(captures, strong).join(gate, "domain", "left_semi"), header,
        search_signals(captures, strong).join(wp, "domain", "left_semi"),
    ]
    signals = parts[0]
    for p in parts[1:]:
        signals = signals.unionByName(p.select("domain", F.col("ord").cast("int").alias("ord"), "bucket", "layer", "match", "url"))
    context = page.select(
        "domain", "http_status", "title", domain_spammy(F.col("reg")).alias("domain_spammy"),
        bd_signal(F.col("reg"), F.col("visible_browser")).alias("bd_signal"),
        biz_type(F.col("reg"), F.col("title"), F.col("visible_browser")).alias("biz_type"),
        F.substring("visible_browser", 1, 3000).alias("excerpt"))
    return signals, context
