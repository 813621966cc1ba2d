"""The whole audit: captures and verdicts in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, signals, verdicts
from ..operators.settle import settle


def audit(captures: DataFrame, registry: DataFrame | None = None, reviewed: DataFrame | None = None, **patterns) -> DataFrame:
    """Findings for ``captures``; ``registry`` (domain, business, phone) names the sites, ``reviewed`` holds verdicts."""
    found, context = signals.scan(captures, **patterns)
    found = settle(found)  # small, and read by every step of the fusion
    scored = fusion.score(found, context).join(
        context.select("domain", "domain_spammy", "bd_signal", "biz_type", "http_status"), "domain")
    if registry is not None:
        scored = scored.join(registry.select("domain", "business", "phone"), "domain", "left")
    else:
        scored = scored.withColumns({"business": F.lit(""), "phone": F.lit("")})
    return verdicts.decide(scored, reviewed)
