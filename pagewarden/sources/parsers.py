"""Domain sources: parsers over text that was captured before.  Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..functions.domains import bd_score, blocked_host, clean_host, normalize_domain, registrable
from ..functions.text import DOTALL, FLAGS, collapse, html_unescape
from ..operators.state import first_wins

# Patterns of what the sources hold.
LOC = FLAGS + r"<loc>\s*([^<\s]+)\s*</loc>"
HOST_IN_HTML = FLAGS + r">\s*([a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)+\.[a-z]{2,})\s*<"
JSONLD_URL = FLAGS + r'"url"\s*:\s*"([^"]+)"'
WEB_FIELD = FLAGS + (
    r"(?:web(?:\s*site)?|website|url)\s*[:\-]?\s*(?:</[^>]+>\s*)*(?:<a[^>]+href=['\"])?"
    r"\s*((?:https?://)?[a-z0-9.\-]+\.[a-z]{2,}[^\s'\"<>]*)"
)
HREF = FLAGS + r"<a\b[^>]*\bhref\s*=\s*['\"]([^'\"]+)['\"]"
JSONLD_NAME = FLAGS + r'"name"\s*:\s*"([^"]+)"'
OG_TITLE = FLAGS + r"<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)[\"']"
PLAIN_URL = FLAGS + r"https?://[a-z0-9.\-]+\.[a-z]{2,}[^\s'\"<>,)]*"
CHILD_MAP = FLAGS + r'https?://[^<\s"]+\.xml'
ANY_HOST = FLAGS + r"\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"


def harvest_rows(payload: DataFrame, source: str, now: int) -> DataFrame:
    """Registry rows from a payload (ord, domain, host, url, business, phone, bd_score); first of equal domains wins."""
    name = normalize_domain(F.coalesce("domain", "host", "url"))
    rows = payload.select(
        "ord", name.alias("domain"), F.lit(source[:64]).alias("source"), F.coalesce(F.col("bd_score").cast("int"), F.lit(0)).alias("bd_score"),
        F.substring(F.coalesce("business", F.lit("")), 1, 200).alias("business"), F.substring(F.coalesce("phone", F.lit("")), 1, 40).alias("phone"),
        F.lit(now).cast("long").alias("added_ts"))
    return first_wins(rows, ["domain"], ["ord"])


def union_sources(parts: list[DataFrame], key: str = "domain") -> DataFrame:
    """Sources in order of rank: of a domain in several, the first source's row stays."""
    ranked = None
    for k, p in enumerate(parts):
        p = p.withColumn("__rank", F.lit(k)).withColumn("__in", F.monotonically_increasing_id() if "ord" not in p.columns else F.col("ord"))
        ranked = p if ranked is None else ranked.unionByName(p, allowMissingColumns=True)
    return first_wins(ranked, [key], ["__rank", "__in"]).drop("__rank", "__in")


def certificate_names(rows: DataFrame, common_name: bool = True, most: int | None = None, suffix: str | None = None) -> DataFrame:
    """Registrable domains in certificate rows (name_value with one name a line, common_name), of one ``suffix`` if given."""
    names = F.split(F.coalesce("name_value", F.lit("")), r"\r?\n")
    if common_name:
        names = F.concat(names, F.array(F.coalesce("common_name", F.lit(""))))
    out = rows.select(F.explode(names).alias("n")).select(registrable(F.col("n")).alias("domain")).where("domain IS NOT NULL").distinct()
    out = out.where(F.col("domain").endswith(suffix)) if suffix else out
    out = out.withColumn("bd_score", bd_score(F.col("domain"), source_bd=True))
    return out if most is None else out.orderBy("domain").limit(most)


def crawl_index_lines(lines: DataFrame, most: int | None = 700, suffix: str | None = None) -> DataFrame:
    """Registrable domains of the ``url`` in JSON lines (column value); lines that are no JSON go.  First ``most`` by name."""
    url = F.get_json_object("value", "$.url")
    rows = lines.select(registrable(clean_host(url)).alias("domain")).where("domain IS NOT NULL").distinct()
    rows = rows.where(F.col("domain").endswith(suffix)) if suffix else rows
    return rows if most is None else rows.orderBy("domain").limit(most)


def sitemap_urls(pages: DataFrame, text: str = "text", most_chars: int | None = None) -> DataFrame:
    """Adds ``loc``: one row for each address of a sitemap; ``most_chars`` limits what is read of one."""
    body = F.substring(text, 1, most_chars) if most_chars else F.col(text)
    locs = F.regexp_extract_all(body, F.lit(LOC), F.lit(1))
    rows = pages.select(*[c for c in pages.columns if c != text], F.posexplode(locs).alias("pos", "loc"))
    return rows.withColumn("loc", F.trim(html_unescape(F.col("loc")))).where("loc != ''")


def expand_index(indexes: DataFrame, sitemaps: DataFrame, child: str, most_children: int = 80) -> DataFrame:
    """(index, loc): addresses in the child sitemaps of an index that contain ``child``; without any, the index's own.

    ``indexes`` and ``sitemaps``: url, text.  Two levels only.
    """
    own = sitemap_urls(indexes.withColumnRenamed("url", "index"))
    picked = own.where(F.col("loc").contains(child))
    heads = picked.groupBy("index").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "loc"))), 1, most_children).alias("c"))
    kids = heads.select("index", F.explode("c").alias("c")).select("index", F.col("c.pos").alias("at"), F.col("c.loc").alias("url"))
    inner = kids.join(sitemap_urls(sitemaps), "url").select("index", "loc")
    flat = own.join(heads.select("index"), "index", "left_anti").select("index", "loc")
    return inner.unionByName(flat)


def business_name(text: Column) -> Column:
    """The name in JSON-LD, else og:title, else the title up to a separator; 200 characters."""
    found = lambda p: F.nullif(F.trim(html_unescape(F.regexp_extract(text, p, 1))), F.lit(""))
    title = collapse(html_unescape(F.regexp_extract(text, DOTALL + r"<title[^>]*>(.*?)</title>", 1)))
    title = F.nullif(F.trim(F.get(F.split(title, r"\s+[|\-–—]\s+", 2), F.lit(0))), F.lit(""))
    return F.substring(F.coalesce(found(JSONLD_NAME), found(OG_TITLE), title, F.lit("")), 1, 200)


def website_of(text: Column, apex: Column, most_links: int | None = 400, plain: bool = False) -> Column:
    """The first acceptable registrable domain: JSON-LD addresses, then labelled fields, then links.

    ``plain`` adds addresses that stand in the text without a link, after all
    others.  ``most_links`` limits links and such addresses; None sets no limit.
    """
    every = lambda p, group=1: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    some = lambda found: F.slice(found, 1, most_links) if most_links else found
    found = F.concat(every(JSONLD_URL), every(WEB_FIELD), some(every(HREF)), *([some(every(PLAIN_URL, 0))] if plain else []))
    raw = F.transform(found, lambda u: F.trim(F.replace(u, F.lit("&amp;"), F.lit("&"))))
    good = F.filter(raw, lambda u: (u != "") & ~u.rlike(r"^(#|mailto:|tel:|javascript:)"))

    def accept(u: Column) -> Column:
        host, name = clean_host(u), registrable(u)
        mine = (host == apex) | host.endswith(F.concat(F.lit("."), apex)) | (name == apex)
        return F.when(host.contains(".") & ~blocked_host(host) & ~mine & ~blocked_host(name), name)

    return F.get(F.array_compact(F.transform(good, accept)), F.lit(0))


def listing_rows(pages: DataFrame, apex: str, plain: bool = False) -> DataFrame:
    """(domain, business, bd_score) from directory pages (url, text); the first page of a domain wins."""
    rows = pages.select("url", website_of(F.col("text"), F.lit(apex), plain=plain).alias("domain"), business_name(F.col("text")).alias("business"))
    rows = first_wins(rows, ["domain"], ["url"])
    return rows.withColumn("bd_score", bd_score(F.col("domain"), source_bd=True))


def listing_slices(listings: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, url): the pages to read in this run, by a budget and a rotating start for each source.

    ``listings``: source, pos, url; ``sources``: source, place, budget, start.  Of
    equal addresses the first counts.  Sources take from the total ``most`` in the
    order of ``place``; a slice that runs over the end wraps round.
    """
    once = first_wins(listings, ["source", "url"], ["pos"])
    order = Window.partitionBy("source").orderBy("pos")
    once = once.withColumn("at", F.row_number().over(order) - 1)
    size = once.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = sources.join(size, "source")  # a row for each source
    want = F.least("budget", "n")
    before = F.coalesce(F.sum(want).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = plan.withColumn("take", F.greatest(F.lit(0), F.least(want, F.lit(most) - before)))
    rows = once.join(plan.select("source", "n", "take", "start"), "source")
    return rows.where(F.pmod(F.col("at") - F.col("start"), F.col("n")) < F.col("take")).select("source", "url")


def map_elements(elements: DataFrame, most: int = 20_000) -> DataFrame:
    """(domain, business) from map elements (ord, tags): website or contact:website; the first name wins."""
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    rows = elements.select("ord", registrable(F.coalesce(tag("website"), tag("contact:website"))).alias("domain"), F.coalesce(tag("name"), F.lit("")).alias("business"))
    return first_wins(rows, ["domain"], ["ord"]).orderBy("ord").limit(most).drop("ord")


def hosts_in_html(text: Column) -> Column:
    """Distinct host names that fill a tag's content, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HOST_IN_HTML), F.lit(1)), F.lower)))


def hosts_in_lines(text: Column) -> Column:
    """Host names one a line; null if the reply says that a limit was reached, empty if there are none."""
    low = F.lower(text)
    limited = low.contains("api count exceeded") | low.contains("too many") | low.contains("rate limit")
    none = low.contains("no dns a records")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: x.contains(".") & ~x.contains(" "))
    return F.when(~limited, F.when(none, F.array().cast("array<string>")).otherwise(good))


def hosts_in_text(spark: SparkSession, path: str) -> DataFrame:
    """Distinct registrable domains anywhere in the text files at ``path``, sorted."""
    rows = spark.read.text(path)
    hosts = F.regexp_extract_all(F.lower("value"), F.lit(ANY_HOST), F.lit(0))
    return rows.select(F.explode(hosts).alias("h")).select(registrable(F.col("h")).alias("domain")).where("domain IS NOT NULL").distinct().orderBy("domain")


def ranked_list(rows: DataFrame, offset: int, take: int = 25_000) -> tuple[DataFrame, DataFrame]:
    """(slice, state): rows (idx, domain) of ``[offset, offset + take)``, and one row with the next offset (0 at the end)."""
    part = rows.where((F.col("idx") >= offset) & (F.col("idx") < offset + take))
    part = part.select("idx", registrable(F.col("domain")).alias("domain")).where("domain IS NOT NULL")
    seen = rows.where(F.col("idx") >= offset).where(F.col("idx") < offset + take).agg(F.count(F.lit(1)).alias("n"))
    return part, seen.select(F.when(F.col("n") < take, F.lit(0)).otherwise(F.lit(offset + take)).alias("next_offset"))


def capped(text: Column, most_bytes: int = 170_000) -> Column:
    """The first ``most_bytes`` bytes of a body as text; a character cut in two is dropped."""
    part = F.substring(F.encode(text, "UTF-8"), 1, most_bytes)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.rtrim(F.make_valid_utf8(part.cast("string")), F.lit("�")))


def either_scheme(captures: DataFrame) -> DataFrame:
    """One row per domain and variant where both schemes were tried (column scheme): https if it answered, else http."""
    rows = captures.withColumn("__bad", (F.coalesce("status", F.lit(0)) == 0)).withColumn("__s", F.col("scheme") != "https")
    return first_wins(rows, ["domain", "variant"], ["__bad", "__s"]).drop("__bad", "__s")


def robots_sitemaps(captures: DataFrame, most: int = 3) -> DataFrame:
    """(domain, pos, url): sitemaps a robots file names, or the three usual places; those outside the site go."""
    rows = captures.where("variant = 'robots'")
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(FLAGS + r"sitemap:\s*(https?://\S+)"), F.lit(1))
    base = F.concat(F.lit("https://"), "domain")
    usual = F.array(*[F.concat(base, F.lit(p)) for p in ("/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap.xml")])
    some = F.slice(F.when(F.size(named) > 0, named).otherwise(usual), 1, most)
    reg = F.regexp_replace("domain", r"^www\.", "")
    return rows.select("domain", reg.alias("reg"), F.posexplode(some).alias("pos", "url")).where(F.col("url").contains(F.col("reg"))).drop("reg")


def sitemap_walk(captures: DataFrame, most_maps: int = 3, most_children: int = 6) -> DataFrame:
    """(domain, seq, url): the sitemaps a site's walk reads, in order, from its captured ``robots`` and ``sitemap`` rows.

    A sitemap is followed by the ``.xml`` addresses it names, sorted, at most
    ``most_children`` in a map; of a site no more than that many are read in all.
    Two levels only; addresses outside the site go.
    """
    named = robots_sitemaps(captures, most_maps)
    maps = captures.where("variant = 'sitemap'").select("domain", F.col("final_url").alias("url"), "text")
    roots = named.join(maps, ["domain", "url"]).where("text != ''")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(CHILD_MAP), F.lit(0))))
    kids = roots.select("domain", "pos", F.posexplode(F.slice(found, 1, most_children)).alias("k", "url"))
    kids = kids.where(F.col("url").contains(F.regexp_replace("domain", r"^www\.", "")))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("pos", "k"))
    kids = kids.withColumn("n", place).where(F.col("n") <= most_children)
    both = roots.select("domain", "pos", F.lit(-1).alias("k"), "url").unionByName(kids.select("domain", "pos", "k", "url"))
    seq = F.row_number().over(Window.partitionBy("domain").orderBy("pos", "k")) - 1
    return both.select("domain", seq.alias("seq"), "url")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, CSV (header, quoted) or text; a schema spares the pass that infers one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
