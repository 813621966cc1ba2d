import math

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import patterns as P
from pagewarden.operators import fusion

SCHEMA = "domain string, ord int, bucket string, layer string, match string, url string"
BUCKET = {
    "L1KW_WEAK": "homepage-content", "L1KW_STRONG": "homepage-content", "L2UACLOAK": "cloak-diff", "L11REST": "content-enum",
    "L10DEFACE": "deface", "L11SITEMAP": "sitemap-doorway", "L20RELAY": "redirect", "L9REDIR": "redirect",
}
VECTORS = [
    ("L1KW_WEAK", 0.3846, "SUSPECT"), ("L1KW_STRONG", 0.7843, "SUSPECT"), ("L2UACLOAK", 0.8625, "SUSPECT"), ("L11REST", 0.9231, "SUSPECT"),
    ("L10DEFACE", 0.9851, "CONFIRM_CANDIDATE"), ("L1KW_WEAK+L11SITEMAP", 0.9606, "SUSPECT"), ("L1KW_WEAK+L2UACLOAK", 0.9664, "SUSPECT"),
    ("L1KW_STRONG+L20RELAY", 0.9732, "CONFIRM_CANDIDATE"), ("L1KW_STRONG+L9REDIR", 0.9770, "CONFIRM_CANDIDATE"),
    ("L1KW_WEAK+L11REST", 0.9821, "CONFIRM_CANDIDATE"), ("L1KW_STRONG+L2UACLOAK", 0.9941, "CONFIRM_CANDIDATE"),
    ("L11REST+L11SITEMAP", 0.9979, "CONFIRM_CANDIDATE"),
]


def test_golden_vectors(spark):
    rows = [(v, i, BUCKET[x], x, "m", f"https://{v}/{i}") for v, _, _ in VECTORS for i, x in enumerate(v.split("+"))]
    got = {r["domain"]: r for r in fusion.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    for name, posterior, verdict in VECTORS:
        assert got[name]["posterior"] == pytest.approx(posterior, abs=1e-4), name
        assert got[name]["verdict"] == verdict, name


def test_buckets_ties_caps_and_gate(spark):
    rows = [("ext", i, "external", x, x, "") for i, x in enumerate(("L15SURBL", "L15DBL", "L15CT"))]
    rows += [("control", 0, "control", "L18CHALLENGE", "w", "u")]
    rows += [("mass", 0, "content-enum", "L20MASS_CAND", "x", "u")]
    rows += [("urls", i, "homepage-content", "L1KW_WEAK", "casino", f"u{i:02}") for i in range(13)]
    rows += [("dup", i, "cloak-diff", "L2UACLOAK", f"m{i}", "u") for i in range(5)]
    rows += [("unknown", 0, "b", "L99", "m", "u")]
    rows += [("open", 0, "homepage-content", "L1KW_STRONG", "judi", "u")]
    context = spark.createDataFrame([("mass", True, False)], "domain string, domain_spammy boolean, bd_signal boolean")
    got = {r["domain"]: r for r in fusion.score(spark.createDataFrame(rows, SCHEMA), context).collect()}
    assert got["ext"]["nbuckets"] == 2
    want = math.log(P.PRIOR / (1 - P.PRIOR)) + sum(sorted((math.log(d / f) for d, f in (P.WEIGHTS[x] for x in ("L15SURBL", "L15DBL", "L15CT"))))[1:])
    assert got["ext"]["posterior"] == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-4)
    assert (got["control"]["verdict"], got["control"]["status"], got["control"]["nbuckets"]) == ("NEEDS_BROWSER", "clean", 0)
    assert got["mass"]["layers"] == ["L20MASS_CAND"] and got["mass"]["nbuckets"] == 0 and got["mass"]["status"] == "spam_site"
    assert len(got["urls"]["evidence"]) == 12 and got["urls"]["evidence"][0]["url"] == "u00"
    assert got["dup"]["nbuckets"] == 1 and got["dup"]["proof"] == "m0" and got["dup"]["category"] == "cloak"
    assert got["unknown"]["category"] == "gambling"
    assert got["open"]["status"] == "spam_site"


def test_empty(spark):
    assert fusion.score(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).count() == 0
