"""Spam category of a match, and the business type of a site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import FLAGS

GENERAL = "general-business"


def _alt(*patterns: str) -> str:
    return FLAGS + "|".join(f"(?:{p})" for p in patterns)


def category_of(text: Column) -> Column:
    """gambling, then pharma, then adult; the empty string otherwise."""
    out = F.when(text.rlike(_alt(P.RX_GAMB_STRONG, P.RX_GAMB_WEAK)), "gambling")
    out = out.when(text.rlike(_alt(P.RX_PHARMA_STRONG, P.RX_PHARMA_WEAK)), "pharma")
    return out.when(text.rlike(_alt(P.RX_ADULT_STRONG, P.RX_ADULT_WEAK)), "adult").otherwise("")


def biz_type(domain: Column, title: Column, body: Column, categories=None, priority=None, least: int = 2, most_body: int = 2500) -> Column:
    """The category with most points: 5 for a match in the domain, 3 in the title, 1 in the first ``most_body`` characters.

    Under ``least`` points the type is general; ties go by ``priority``.
    """
    categories = categories or P.CATS
    priority = list(priority or P.PRIORITY)
    domain, title = F.lower(F.coalesce(domain, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    body = F.substring(F.coalesce(body, F.lit("")), 1, most_body)
    scores = []
    for name, pattern in categories:
        p = F.lit(FLAGS + pattern)
        points = F.regexp_count(domain, p) * 5 + F.regexp_count(title, p) * 3 + F.regexp_count(body, p)
        scores.append(F.struct((-points).alias("less"), F.lit(priority.index(name) if name in priority else 99).alias("place"), F.lit(name).alias("name")))
    best = F.array_min(F.array(*scores))
    return (
        F.when(domain.rlike(r"\.(gov|mil)\.bd$"), "government")
        .when(domain.rlike(r"\.(edu|ac)\.bd$"), "education")
        .when(-best["less"] < least, GENERAL)
        .otherwise(best["name"])
    )
