"""Fusing a domain's signals into one verdict: independence buckets, log-odds, and the hacked-or-genuine gate.

Input ``signals``: domain, ord (order of emission), bucket, layer, match, url.
All steps are grouped aggregates or windows by domain, so a domain's signals
meet in one task and nothing else does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .classify import category_of

EVIDENCE = 12
EXTERNAL_BUCKETS = 2


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def effective(signals: DataFrame) -> DataFrame:
    """Scored signals: control signals go; a mass-count candidate counts only beside content enumeration, as L20MASS."""
    w = Window.partitionBy("domain")
    enumerated = F.max(F.col("layer").isin("L11REST", "L20SCRIPT") & (F.col("bucket") != "control")).over(w)
    rows = signals.withColumn("enumerated", enumerated).where("bucket != 'control'")
    rows = rows.where((F.col("layer") != "L20MASS_CAND") | F.col("enumerated")).drop("enumerated")
    return rows.withColumn("layer", F.when(F.col("layer") == "L20MASS_CAND", "L20MASS").otherwise(F.col("layer")))


def weighted(rows: DataFrame) -> DataFrame:
    """Adds ratio (detection over false-positive rate) and the bucket key; external sources are buckets of their own."""
    ratio = F.coalesce(_map({k: d / f for k, (d, f) in P.WEIGHTS.items()})[F.col("layer")], F.lit(P.UNKNOWN_WEIGHT[0] / P.UNKNOWN_WEIGHT[1]))
    key = F.when(F.col("layer").isin(*P.EXTERNAL_LAYERS), F.concat(F.lit("ext:"), "layer")).otherwise(F.col("bucket"))
    return rows.withColumn("ratio", ratio).withColumn("key", key)


def best_per_bucket(rows: DataFrame) -> DataFrame:
    """One row per domain and bucket: its strongest signal, first emitted on ties; at most two external buckets."""
    lead = F.max(F.struct("ratio", (-F.col("ord")).alias("earlier"), "layer", "match", "url")).alias("lead")
    best = rows.groupBy("domain", "key").agg(lead, F.min("ord").alias("first"))
    external = F.col("key").startswith("ext:")
    place = F.row_number().over(Window.partitionBy("domain", external).orderBy(F.desc("lead.ratio"), "first"))
    return best.withColumn("place", place).where(~external | (F.col("place") <= EXTERNAL_BUCKETS)).drop("place")


def posterior(log_ratio_sum: Column, prior: float = P.PRIOR) -> Column:
    return 1 / (1 + F.exp(-(F.lit(math.log(prior / (1 - prior))) + log_ratio_sum)))


def _signal_category(rows: DataFrame) -> DataFrame:
    """Category by domain: the first signal whose match names a spam category, else the preferred layer kind, else gambling."""
    kinds = ("deface", "malware", "cloak", "redirect", "foreign_lang")
    named = rows.withColumn("named", category_of(F.coalesce("match", F.lit(""))))
    kind = _map(P.LAYER_CATEGORY)[F.col("layer")]
    place = F.coalesce(_map({k: i for i, k in enumerate(kinds)})[kind], F.lit(len(kinds)))
    named = named.withColumn("kind_place", place)
    got = named.groupBy("domain").agg(
        F.min_by("named", F.when(F.col("named") != "", F.col("ord"))).alias("named"), F.min("kind_place").alias("kind_place"))
    fallback = F.get(F.array(*[F.lit(k) for k in kinds], F.lit("gambling")), F.col("kind_place"))
    return got.select("domain", F.coalesce("named", fallback).alias("category"))


def _evidence(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct non-empty addresses with what was found there."""
    first = rows.where("url != ''").groupBy("domain", "url").agg(F.min(F.struct("ord", "layer", "match")).alias("s"))
    # Only the first ``most`` of a domain leave a task.
    place = F.row_number().over(Window.partitionBy("domain").orderBy("s", "url"))
    first = first.withColumn("place", place).where(F.col("place") <= most)
    item = F.struct(F.col("s.ord").alias("ord"), F.col("s.layer").alias("layer"), F.substring("url", 1, 300).alias("url"),
                    F.substring("s.match", 1, 160).alias("match"))
    ordered = F.slice(F.array_sort(F.collect_list(item)), 1, most)
    items = F.transform(ordered, lambda x: F.struct(x["layer"].alias("layer"), x["url"].alias("url"), x["match"].alias("match")))
    return first.groupBy("domain").agg(items.alias("evidence"))


def score(signals: DataFrame, context: DataFrame | None = None, evidence: int = EVIDENCE) -> DataFrame:
    """One row per domain of ``signals``.

    ``context``: domain, domain_spammy, bd_signal; a missing row or null counts
    as false.  Null matches and addresses count as empty.
    """
    signals = signals.withColumn("match", F.coalesce("match", F.lit(""))).withColumn("url", F.coalesce("url", F.lit("")))
    seen = signals.groupBy("domain").agg(
        F.max(F.col("layer").startswith("L18")).alias("challenge"),
        F.array_sort(F.collect_set(F.when(F.col("bucket") != "control", F.col("layer")))).alias("layers"),
    )
    rows = weighted(effective(signals))
    best = best_per_bucket(rows)
    sums = best.groupBy("domain").agg(
        F.sum(F.log("lead.ratio")).alias("log_ratio"),
        F.count(F.lit(1)).cast("int").alias("nbuckets"),
        F.max(F.struct(F.col("lead.ratio").alias("ratio"), (-F.col("first")).alias("earlier"), "lead")).alias("top"),
    )
    hard = rows.groupBy("domain").agg(F.max(F.col("layer").isin(*P.HARD_LAYERS)).alias("hard"))
    out = seen.join(sums, "domain", "left").join(hard, "domain", "left")
    out = out.join(_signal_category(rows), "domain", "left").join(_evidence(rows, evidence), "domain", "left")
    if context is not None:
        out = out.join(context.select("domain", "domain_spammy", "bd_signal"), "domain", "left")
    else:
        out = out.withColumns({"domain_spammy": F.lit(False), "bd_signal": F.lit(False)})
    out = out.withColumn("nbuckets", F.coalesce("nbuckets", F.lit(0))).withColumn("hard", F.coalesce("hard", F.lit(False)))
    out = out.withColumn("raw", posterior(F.coalesce("log_ratio", F.lit(0.0))))
    verdict = (
        F.when(F.col("nbuckets") == 0, F.when(F.col("challenge"), "NEEDS_BROWSER").otherwise("CLEAN"))
        .when(F.col("hard") | ((F.col("raw") >= 0.97) & (F.col("nbuckets") >= 2)), "CONFIRM_CANDIDATE")
        .otherwise("SUSPECT")
    )
    out = out.withColumn("verdict", verdict)
    any_of = lambda names: F.arrays_overlap("layers", F.array(*[F.lit(x) for x in names]))
    out = out.withColumn("open", F.array_contains("layers", "L1KW_STRONG"))
    injected = any_of(P.STEALTH_LAYERS) | any_of(P.MALWARE_LAYERS) | (any_of(P.DOORWAY_LAYERS) & ~F.col("open"))
    spammy, identity = (F.coalesce(F.col(c), F.lit(False)) for c in ("domain_spammy", "bd_signal"))
    status = (
        F.when(spammy | (F.col("open") & ~injected & ~identity), "spam_site")
        .when(F.col("verdict") == "CONFIRM_CANDIDATE", "lead")
        .when(F.col("verdict") == "SUSPECT", "review")
        .otherwise("clean")
    )
    out = out.withColumn("status", status)
    none = F.array().cast("array<struct<layer:string,url:string,match:string>>")
    return out.select(
        "domain", "verdict", F.round("raw", 4).alias("posterior"), "nbuckets", "hard",
        F.coalesce("category", F.lit("")).alias("category"),
        F.substring(F.coalesce("top.lead.match", F.lit("")), 1, 500).alias("proof"),
        F.coalesce("top.lead.url", F.lit("")).alias("proof_url"),
        "layers", F.coalesce("evidence", none).alias("evidence"), "status",
        (F.col("status") == "lead").cast("int").alias("confirmed"),
        F.col("status").isin("lead", "review").alias("flagged"),
    )
