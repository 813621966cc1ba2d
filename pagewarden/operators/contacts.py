"""Phone, e-mail and address of a site from its text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import FLAGS, running_starts

# Phone and e-mail patterns, what opens an address, and addresses that belong to tools.
PHONE = r"(?:\+?880[\s-]?|0)1[3-9]\d{8}"
MAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
ADDRESS_WORD = r"(house|holding|plot|flat|road|block|sector|level|floor|suite|lane|avenue|tower|bhaban|bhavan|plaza|complex|রোড|সড়ক|বাড়ি|ব্লক|সেক্টর)"
MAIL_SKIP = r"(example|sentry|wixpress|godaddy|\.png|\.jpg|domain\.com|email\.com|yourdomain|wordpress)"
# Limits of the edge scanner, for callers that want them; off by default.
MOST_TEXT = 60_000
MOST_WORDS = 200


def phone_of(text: Column) -> Column:
    found = F.regexp_substr(text, F.lit(PHONE))
    return F.coalesce(F.regexp_replace(found, r"[\s-]", ""), F.lit(""))


def email_of(html: Column) -> Column:
    found = F.lower(F.regexp_substr(html, F.lit(MAIL)))
    return F.coalesce(F.when(~found.rlike(MAIL_SKIP), found), F.lit(""))


def _first_place(window: Column, names: list[str]) -> Column:
    """The first of ``names``, in list order, that stands in the window as a whole word; empty if none does."""
    hit = F.coalesce(*[F.when(window.rlike(r"(?i)\b" + re.escape(n) + r"\b"), F.lit(n)) for n in names])
    return F.when(window.rlike(r"(?i)\b(" + "|".join(re.escape(n) for n in names) + r")\b"), hit).otherwise("")


def windows(text: Column, before: int = 45, after: int = 155, most_words: int | None = None) -> Column:
    """Text around each address word, in order; with ``most_words`` around the first so many."""
    gaps = F.split(text, FLAGS + ADDRESS_WORD, most_words + 1 if most_words else -1)
    words = F.regexp_extract_all(text, F.lit(FLAGS + ADDRESS_WORD), F.lit(0))
    words = F.slice(words, 1, most_words) if most_words else words
    gap = F.transform(F.slice(gaps, 1, F.size(words)), lambda g: F.length(g))
    places = running_starts(gap, F.transform(words, lambda w: F.length(w)))
    return F.transform(places, lambda p: F.substring(text, F.greatest(p - before, F.lit(0)) + 1, after + F.least(p, F.lit(before))))


def extract_contacts(
    pages: DataFrame, id_col: str, html_col: str, text_col: str, most_text: int | None = None, most_words: int | None = None
) -> DataFrame:
    """id, phone, email, address, district, area.

    The address is the first window around an address word that names an area or
    a district; an area alone implies the capital's district.  Missing parts are
    empty.  Whole texts are read; ``most_text`` (characters) and ``most_words``
    (address words) set limits.
    """
    text = F.coalesce(text_col, F.lit(""))
    text = F.substring(text, 1, most_text) if most_text else text
    rows = pages.select(F.col(id_col), text.alias("__t"), F.coalesce(html_col, F.lit("")).alias("__h"))
    any_place = r"(?i)\b(" + "|".join(re.escape(n) for n in [*P.AREAS, *P.DISTRICTS]) + r")\b"
    has = F.col("__t").rlike(FLAGS + ADDRESS_WORD) & F.col("__t").rlike(any_place)
    first = F.get(F.filter(windows(F.col("__t"), most_words=most_words), lambda w: w.rlike(any_place)), F.lit(0))
    rows = rows.withColumn("__w", F.coalesce(F.when(has, first), F.lit("")))
    rows = rows.withColumn("area", _first_place(F.col("__w"), P.AREAS)).withColumn("__d", _first_place(F.col("__w"), P.DISTRICTS))
    address = F.regexp_replace(F.regexp_replace("__w", r"\s+", " "), r"^[^A-Za-zঀ-৿]+", "")
    return rows.select(
        id_col, phone_of(F.col("__t")).alias("phone"), email_of(F.col("__h")).alias("email"),
        F.substring(F.trim(address), 1, 160).alias("address"),
        F.when(F.col("__d") != "", F.col("__d")).when(F.col("area") != "", "Dhaka").otherwise("").alias("district"), "area")


