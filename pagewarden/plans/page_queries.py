"""Queries over pages, documents and conversations.

The given tables hold no page that the real signatures match, so these queries
run the operators with words that do occur; the signature library itself is
tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import patterns as P
from ..functions import text as X
from ..operators.census import count_matching
from ..operators.classify import biz_type
from ..operators.contacts import extract_contacts
from .registry import query

TAGS = ("script", "style", "noscript", "template")
WORDS = {"gambling": r"casino|poker|jackpot", "pharma": r"pills|license|version", "adult": r"click|subscribe|cookie"}
TERMS = [("it", r"software|version|cloud|source"), ("news", r"news|daily|press"), ("legal", r"license|rights|copyright"), ("shop", r"shop|price|cart")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _visible_sql(column: str) -> str:
    out = column
    for t in TAGS:
        out = rf"regexp_replace({out}, '<{t}\b.*?</{t}>', ' ', 'gis')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'gi'), '[\s\x0b]+', ' ', 'g')"


HOST_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '/.*$', '', 's'), ':.*$', '', 's')"
NORM_SQL = rf"regexp_replace({HOST_SQL}, '^www\.', '')"
TITLE_SQL = r"substr(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '[\s\x0b]+', ' ', 'g')), 1, 120)"


@query("page_host_counts", f"SELECT {HOST_SQL} AS host, count(*) AS pages FROM pages GROUP BY 1")
def page_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(D.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("page_normalized_domains", rf"""
    SELECT page_id, CASE WHEN regexp_matches({NORM_SQL}, '^[a-z0-9.-]+\.[a-z]{{2,}}$') THEN {NORM_SQL} END AS domain FROM pages""")
def page_normalized_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.normalize_domain(F.col("url")).alias("domain"))


@query("page_registrable_counts", rf"""
    WITH h AS (SELECT {NORM_SQL} AS h FROM pages),
         l AS (SELECT string_split(h, '.') AS l FROM h WHERE regexp_matches(h, '^[a-z0-9][a-z0-9.\-]+\.[a-z]{{2,}}$') AND NOT contains(h, '..'))
    SELECT domain, count(*) AS pages FROM (
        SELECT array_to_string(l[CASE WHEN len(l) >= 3 AND l[-1] = 'bd' AND l[-2] IN ('com','gov','edu','org','net','ac','mil','info','co')
                                 THEN -3 ELSE -2 END:], '.') AS domain FROM l)
    WHERE domain NOT IN ('example.com', 'domain.com') GROUP BY 1""")
def page_registrable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(D.registrable(F.col("url")).alias("domain")).where("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


@query("page_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.title_of(F.col("html")).alias("title"))


@query("page_visible_text", f"SELECT page_id, md5({_visible_sql('html')}) AS text_md5, length({_visible_sql('html')}) AS n_chars FROM pages")
def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


def _hits_sql(table_sql: str) -> str:
    parts = [f"SELECT id, '{c}' AS category, unnest(regexp_extract_all(lower(t), '{p}')) AS word FROM ({table_sql})" for c, p in WORDS.items()]
    return " UNION ALL ".join(parts)


@query("keyword_hits_by_category", f"""
    SELECT category, count(*) AS hits, count(DISTINCT id) AS pages, count(DISTINCT word) AS words
    FROM ({_hits_sql(f"SELECT page_id AS id, {_visible_sql('html')} AS t FROM pages")}) GROUP BY 1""")
def keyword_hits_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip, match, categorise, count: the flagship query."""
    rows = table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    found = F.array(*[F.struct(F.lit(c).alias("category"), X.matches(F.col("t"), p).alias("w")) for c, p in WORDS.items()])
    each = rows.select("page_id", F.inline(found)).select("page_id", "category", F.explode("w").alias("word")).withColumn("word", F.lower("word"))
    return each.groupBy("category").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("page_id").alias("pages"), F.countDistinct("word").alias("words"))


DOC_WORDS = r"apache|license|version|idiot|stupid|password|token"


@query("keyword_distinct_per_doc", f"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{DOC_WORDS}'))), ';') AS words
    FROM documents WHERE regexp_matches(lower(text), '{DOC_WORDS}')""")
def keyword_distinct_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.distinct_matches(F.col("text"), DOC_WORDS).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.array_join("w", ";").alias("words"))


TALK_WORDS = r"[a-z]*tion[a-z]*"


@query("keyword_diff_variants", f"""
    WITH v AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn) AS u,
                      string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn) AS a FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(a, '')), '{TALK_WORDS}')),
           lambda x: NOT list_contains(regexp_extract_all(lower(coalesce(u, '')), '{TALK_WORDS}'), x))), ';') AS only_assistant FROM v""")
def keyword_diff_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in one variant of a text and not in the other (the cloaking test)."""
    talk = table(spark, sf_dir, "conversations")
    said = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    rows = talk.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    only = F.array_except(X.distinct_matches(F.col("a"), TALK_WORDS), X.distinct_matches(F.col("u"), TALK_WORDS))
    return rows.select("conv_id", F.array_join(only, ";").alias("only_assistant"))


@query("domain_spammy_pages", rf"""
    SELECT page_id, regexp_matches(lower(url), 'casino|cassino|kasino|slot|togel|toto|judi|poker|pills')
                    OR regexp_matches(lower({HOST_SQL}), '\.(bet|casino|poker|porn|sex|xxx|adult)$') AS spammy FROM pages""")
def domain_spammy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.lower("url").rlike("casino|cassino|kasino|slot|togel|toto|judi|poker|pills")
    host = D.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", (words | host.rlike(X.FLAGS + D.SPAMMY_TLD)).alias("spammy"))


def _biz_sql() -> str:
    body = f"substr({_visible_sql('html')}, 1, 2500)"
    points = [
        f"{{'less': -(5 * len(regexp_extract_all(d, '{p}')) + 3 * len(regexp_extract_all(t, '{p}')) + len(regexp_extract_all(b, '{p}'))), "
        f"'place': {i}, 'name': '{n}'}}" for i, (n, p) in enumerate(TERMS)
    ]
    return f"""
        WITH p AS (SELECT page_id, lower({NORM_SQL}) AS d, lower({TITLE_SQL}) AS t, lower({body}) AS b FROM pages),
             s AS (SELECT page_id, list_sort([{', '.join(points)}])[1] AS best FROM p)
        SELECT page_id, CASE WHEN -best.less < 2 THEN 'general-business' ELSE best.name END AS biz_type FROM s"""


@query("biz_type_pages", _biz_sql())
def biz_type_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(
        "page_id", D.without_www(D.host_of(F.col("url"))).alias("d"), X.title_of(F.col("html")).alias("t"), X.strip_html(F.col("html")).alias("b"))
    return rows.select("page_id", biz_type(F.col("d"), F.col("t"), F.col("b"), TERMS, [n for n, _ in TERMS]).alias("biz_type"))


@query("links_per_page", r"""
    SELECT page_id, len(regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1, 'i')) AS links,
           len(list_distinct(regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1, 'i'))) AS distinct_links FROM pages""")
def links_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("links"), F.size(F.array_distinct(links)).alias("distinct_links"))


@query("gibberish_segments", r"""
    WITH s AS (SELECT page_id, lower(regexp_replace(regexp_extract(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'),
                      '([^/]*)$', 1), '\.html?$', '')) AS segment FROM pages)
    SELECT page_id, segment, length(segment) > 9 AND len(regexp_extract_all(segment, '[aeiou]')) / length(segment) < 0.22
           AND regexp_matches(segment, '[bcdfghjklmnpqrstvwxz]{6,}') AS gibberish FROM s WHERE length(segment) > 0""")
def gibberish_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", D.last_segment(D.url_path(F.col("url"))).alias("segment"))
    return rows.where(F.length("segment") > 0).select("page_id", "segment", X.gibberish(F.col("segment")).alias("gibberish"))


@query("obfuscation_score", r"""
    SELECT page_id, 3 * regexp_matches(html, 'eval\(\s*(atob|unescape|decodeuricomponent|string\.fromcharcode)', 'i')::INT
           + 2 * regexp_matches(html, '(\\x[0-9a-fA-F]{2}){12,}')::INT + 2 * regexp_matches(html, 'document\.write\([^)]{0,40}<scr', 'i')::INT
           + 2 * regexp_matches(html, 'String\.fromCharCode\([0-9]+(,[0-9]+){8,}')::INT AS score FROM pages""")
def obfuscation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", X.obfuscation_parts(F.col("html")).alias("o"))
    return rows.select("page_id", X.obfuscation_score(F.col("o")).alias("score"))


@query("contact_extract", r"""
    SELECT doc_id, coalesce(regexp_replace(nullif(regexp_extract(text, '(?:\+?880[\s-]?|0)1[3-9]\d{8}'), ''), '[\s-]', '', 'g'), '') AS phone,
           CASE WHEN regexp_matches(e, '(example|sentry|wixpress|godaddy|\.png|\.jpg|domain\.com|email\.com|yourdomain|wordpress)') THEN '' ELSE e END AS email
    FROM (SELECT *, lower(regexp_extract(coalesce(text, ''), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS e FROM documents)""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_contacts(table(spark, sf_dir, "documents"), "doc_id", "text", "text").select("doc_id", "phone", "email")


def _signature_sql(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT '{name}' AS list, count_if(regexp_matches(text, '(?i){quoted}'))::BIGINT AS docs FROM documents"


SIGNATURES = {"strong": P.ALL_STRONG, "weak": P.ALL_WEAK, "deface": P.RX_DEFACE, "campaign": P.RX_MALJS, "slug": P.RX_SLUG_SPAM}


@query("signature_documents", " UNION ALL ".join(_signature_sql(n, p) for n, p in SIGNATURES.items()))
def signature_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many whole documents the signature lists match: the cost of the library itself."""
    return count_matching(table(spark, sf_dir, "documents"), "text", SIGNATURES)
