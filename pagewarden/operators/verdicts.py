"""Second-stage review: verdict rows joined to scored candidates, and the re-check of old findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.domains import bd_signal, domain_spammy, without_www
from ..functions.text import cap, json_inside, strip_html_unescaped, title_of
from .classify import GENERAL, biz_type

REPLY = "classification string, business_type string, confidence double, reason string"
#: Most characters of each part of a review request.
PROMPT_PARTS = {"business": 120, "layers": 300, "proof": 300, "evidence": 400, "excerpt": 2500}


def review_requests(candidates: DataFrame) -> DataFrame:
    """What a reviewer gets per domain: parts cut to length, an empty business as ``?``."""
    parts = [cap(F.col(c), n).alias(c) for c, n in PROMPT_PARTS.items() if c != "business"]
    business = cap(F.when(F.coalesce("business", F.lit("")) == "", "?").otherwise(F.col("business")), PROMPT_PARTS["business"])
    return candidates.select("domain", business.alias("business"), *parts)


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """domain and verdict columns from reviewer replies (JSON, also inside prose); replies without a class are dropped."""
    rows = replies.select("domain", json_inside(F.col(column), REPLY).alias("v")).where(F.coalesce("v.classification", F.lit("")) != "")
    return rows.select(
        "domain", F.lower("v.classification").alias("classification"), F.lower(F.coalesce("v.business_type", F.lit(""))).alias("business_type"),
        F.col("v.confidence").alias("confidence"), cap(F.col("v.reason"), 300).alias("reason"))


def decide(scored: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Findings from scored candidates.

    ``scored``: the columns of :func:`fusion.score` and domain_spammy, bd_signal,
    biz_type, business, phone, http_status.  Clean and spam-by-name domains are
    not candidates.  With ``verdicts``, hacked clients are leads and other classes
    go; without a row for a domain the heuristic holds, but spam sites go and
    gambling or adult hits without regional identity are parked for review.
    ``verdicts=None`` means no reviewer at all: then only spam sites go.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = scored.where((F.col("status") != "clean") & ~yes("domain_spammy"))
    reason = F.concat(
        F.format_string("posterior=%.3f buckets=%d", "posterior", "nbuckets"), F.when(F.col("hard"), " HARD").otherwise(""))
    rows = rows.withColumn("stage2_reason", reason).withColumn("stage2_verdict", F.col("verdict"))
    if verdicts is None:
        rows = rows.where("status != 'spam_site'")
    else:
        v = verdicts.select("domain", F.col("classification").alias("cls"), F.col("business_type").alias("v_biz"), F.col("reason").alias("v_reason"))
        rows = rows.join(v, "domain", "left")
        said = F.col("cls").isNotNull()
        rows = rows.where((said & (F.col("cls") == "hacked_client")) | (~said & (F.col("status") != "spam_site")))
        park = ~said & F.col("category").isin("gambling", "adult") & ~yes("bd_signal")
        rows = rows.withColumns({
            "status": F.when(said, "lead").when(park, "review").otherwise(F.col("status")),
            "confirmed": F.when(said, 1).when(park, 0).otherwise(F.col("confirmed")),
            "biz_type": F.when(said & (F.coalesce("v_biz", F.lit("")) != ""), F.col("v_biz")).otherwise(F.col("biz_type")),
            "stage2_verdict": F.when(said, F.concat(F.lit("review-"), "cls")).when(park, F.concat(F.lit("unverified-"), "category")).otherwise(F.col("verdict")),
            "stage2_reason": F.when(said, F.concat(F.lit("review:"), "cls", F.lit(" — "), F.coalesce("v_reason", F.lit(""))))
            .when(park, F.concat(F.lit("review unavailable; "), "category", F.lit(" without regional identity parked")))
            .otherwise(F.col("stage2_reason")),
        })
    return rows.select(
        "domain", cap(F.col("business"), 200).alias("business"), cap(F.col("phone"), 40).alias("phone"), "category",
        F.substring(F.array_join("layers", ","), 1, 200).alias("layers"), F.col("proof").alias("proof_snippet"),
        F.substring("proof_url", 1, 300).alias("proof_url"), F.coalesce("http_status", F.lit(0)).alias("http_status"),
        F.col("nbuckets").alias("stage1_score"), F.substring("stage2_verdict", 1, 20).alias("stage2_verdict"),
        F.substring("stage2_reason", 1, 400).alias("stage2_reason"), F.col("category").alias("stage2_category"), "confirmed",
        F.substring(F.to_json("evidence"), 1, 4000).alias("evidence"), yes("bd_signal").cast("int").alias("is_bd"),
        cap(F.col("biz_type"), 30).alias("biz_type"), "status",
    )


def batch_sums(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """Per batch: scanned, flagged, confirmed and errors, from ``findings`` (batch_id, confirmed) and ``scanned`` (batch_id, domain, error)."""
    done = scanned.groupBy("batch_id").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("error")).alias("errors"))
    found = findings.groupBy("batch_id").agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.col("confirmed") == 1).alias("confirmed"))
    return done.join(found, "batch_id", "left").na.fill(0, ["flagged", "confirmed"]).select("batch_id", "scanned", "flagged", "confirmed", "errors")


def recheck(findings: DataFrame, captures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Keep-or-reject decision for confirmed findings against fresh captures (domain, text) and verdicts.

    A spammy name is rejected outright.  "genuine_spam" is rejected; a
    "false_positive" only if no strong layer fired.  Domains without a capture or
    verdict are kept.
    """
    rows = findings.where("confirmed = 1").join(captures.select("domain", F.col("text").alias("body")), "domain", "left")
    rows = rows.join(verdicts.select("domain", "classification", "business_type", "confidence", "reason"), "domain", "left")
    reg = without_www(F.lower("domain"))
    rows = rows.withColumn("alive", F.coalesce("body", F.lit("")) != "")
    rows = rows.withColumn("visible", F.substring(strip_html_unescaped(F.coalesce("body", F.lit(""))), 1, 3000))
    rows = rows.withColumn("title", title_of(F.coalesce("body", F.lit(""))))
    rows = rows.withColumn("spammy", domain_spammy(reg)).withColumn("is_bd", bd_signal(reg, F.col("visible")).cast("int"))
    rows = rows.withColumn("biz", biz_type(reg, F.col("title"), F.col("visible")))
    said = F.col("alive") & F.col("classification").isNotNull() & ~F.col("spammy")
    strong = F.coalesce("layers", F.lit("")).rlike("|".join(P.RECHECK_STRONG_LAYERS))
    wrong = F.col("classification") == "false_positive"
    rows = rows.withColumn("decision", F.when(F.col("spammy"), "reject").when(said & (F.col("classification") == "genuine_spam"), "reject")
                           .when(said & wrong & ~strong, "reject").otherwise("keep"))
    text = F.coalesce("reason", F.lit(""))
    reason = (
        F.when(F.col("spammy"), "domain name is a gambling or adult brand")
        .when(said & (F.col("classification") == "genuine_spam"), F.concat(F.lit("genuine_spam — "), text))
        .when(said & wrong & ~strong, F.concat(F.lit("false_positive (weak signal) — "), text))
        .when(said & wrong, F.concat(F.lit("false_positive but strong signal kept — "), text))
        .when(said, text)
        .when(~F.col("alive"), "offline at re-check (kept as is)")
        .otherwise("no review (kept)")
    )
    given = F.lower(F.trim(F.coalesce("business_type", F.lit(""))))
    given = F.when(given == "general", GENERAL).when(given == "gambling", "gambling-site").otherwise(given)
    valid = [*P.PRIORITY, GENERAL, "gambling-site"]
    biz = F.when(said & given.isin(*valid), given).otherwise(F.col("biz"))
    return rows.select("id", "domain", "decision", "is_bd", biz.alias("biz"), F.substring(reason, 1, 180).alias("reason"),
                       F.coalesce(F.when(said, F.col("confidence")), F.lit(0.0)).alias("conf"), "alive")


def recheck_summary(decisions: DataFrame) -> DataFrame:
    """Counts by decision, region and business type."""
    return decisions.groupBy("decision", "is_bd", "biz").agg(F.count(F.lit(1)).alias("n"))
