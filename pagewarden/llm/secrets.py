"""Secret scan: fixed patterns, and a battery of randomness tests (JVM side only).

Candidates of the battery are long runs of encoding characters; "=" only ends
one, as padding, so the name and the value of NAME=value are two.  The encoding
is inferred from the characters used (hex, base32, base36, base64); runs without
a digit, or of one case with one of "+/_-", have none.  Three tests ask
whether the run can be random in that alphabet: chi-squared uniformity, runs
above and below the middle of the alphabet, and serial correlation at lag 1.
Their p-values are combined (Cauchy combination, which holds for dependent
tests), and within each class of lengths the Benjamini-Hochberg rule at
``reject`` says which runs are not random, over all runs of the corpus.

The others have not been told from random, which short runs hardly can be.  Each
gets a p-value under the opposite hypothesis, ordinary writing in that alphabet,
from the number of coinciding pairs of characters; its spread depends on the
length, so short runs cannot reach small values.  Within each class of lengths
the same rule at ``rate`` sets the limit from which a run is reported.  Both
limits come from histograms of p-values.

Positions count code points; ends are exclusive.  Empty and null texts have no
spans.  Spans of different kinds may overlap.  Rows that repeat, or share or lack
an id, are scanned each for itself; their runs count for the limits as often as
they occur.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import running_starts
from .common import persist, text_of

# The patterns of the three base kinds and how long a match must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same as runs of AKIA[A-Z0-9]+ that have 20 or more characters
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: Kinds in the order of listing.
KINDS = ("assign", "access", "hex", "random")
#: 20 characters or more with the padding, which is at most six long where it is needed for the 20.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{14})(?:[A-Za-z0-9+/_-]{20,}=*" + "".join(
    rf"|[A-Za-z0-9+/_-]{{{20 - k}}}={{{k},}}" for k in range(1, 7)) + ")"
#: name, full-match pattern, alphabet in order, chance that two characters of ordinary writing coincide.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("base36", r"^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    ("base64", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_-]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05),
)
BINS_PER_DECADE = 20
MOST_BINS = 2000


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as an array of (start, end, part).

    The text between matches gives the starts: split() and regexp_extract_all()
    walk through the same matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    starts = running_starts(F.transform(gaps, lambda g: F.length(g)), F.transform(matches, lambda m: F.length(m)))
    steps = F.arrays_zip(starts.alias("start"), matches.alias("whole"), parts.alias("part"))
    spans = F.transform(steps, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["whole"])).alias("end"), x["part"].alias("part")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,part:string>>"))


def _listed(kind: int, spans: Column) -> Column:
    one = lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    return F.transform(spans, one)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def normal_above(z: Column) -> Column:
    """Upper tail of the standard normal distribution (a published rational approximation, error under 1e-7)."""

    def tail(v: Column) -> Column:
        t = F.transform(F.array(1 / (1 + 0.2316419 * F.abs(v))), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (
            1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        above = F.exp(-v * v / 2) / 2.5066282746310002 * F.get(t, F.lit(0))
        return F.when(v >= 0, above).otherwise(1 - above)

    # A lambda over one element binds z, so that it is worked out once.
    return F.get(F.transform(F.array(z.cast("double")), tail), F.lit(0))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, p_chi, p_runs, p_serial, p_random and p_ordinary to rows with ``part``; rows without encoding go."""
    core = F.rtrim(F.translate("part", "=", " "))  # padding goes
    rows = tokens.withColumn("core", core)
    pick = lambda values: F.coalesce(*[F.when(F.col("core").rlike(p), F.lit(v)) for (_, p, _, _), v in zip(ENCODINGS, values)])
    rows = rows.withColumn("encoding", pick([e[0] for e in ENCODINGS])).where("encoding IS NOT NULL")
    rows = rows.withColumn("alphabet", pick([e[2] for e in ENCODINGS])).withColumn("kappa", pick([e[3] for e in ENCODINGS]))
    plain = F.when(F.col("encoding").isin("hex", "base36"), F.lower("core")).otherwise(F.translate("core", "-_", "+/"))
    rows = rows.withColumn("core", plain).withColumn("n", F.length("core").cast("double"))
    rows = rows.withColumn("m", F.length("alphabet").cast("double"))
    counts = F.transform(F.split("alphabet", ""), lambda c: (F.length("core") - F.length(F.replace(F.col("core"), c, F.lit("")))).cast("double"))
    rows = rows.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    n, m = F.col("n"), F.col("m")
    place = F.transform(F.split("core", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - (F.col("m") + 1) / 2)
    rows = rows.withColumn("x", place)
    # Uniformity.
    chi = m / n * F.col("squares") - n
    rows = rows.withColumn("p_chi", normal_above((chi - (m - 1)) / F.sqrt(2 * (m - 1) * (1 - 1 / n))))
    # Runs on either side of the middle.
    pairs = F.arrays_zip(F.slice("x", 1, F.size("x") - 1).alias("a"), F.slice("x", 2, F.size("x") - 1).alias("b"))
    rows = rows.withColumn("pairs", pairs)
    runs = 1 + F.size(F.filter("pairs", lambda p: (p["a"] > 0) != (p["b"] > 0)))
    above = F.size(F.filter("x", lambda v: v > 0)).cast("double")
    rows = rows.withColumn("runs", runs.cast("double")).withColumn("above", above)
    n1, n2 = F.col("above"), F.col("n") - F.col("above")
    mean = 2 * n1 * n2 / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    rows = rows.withColumn("p_runs", F.when((n1 > 1) & (n2 > 1), 2 * normal_above(F.abs((F.col("runs") - mean) / spread))).otherwise(0.0))
    # Serial correlation.
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    rows = rows.withColumn("mean", total)
    power = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    lagged = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    rows = rows.withColumn("power", power).withColumn("lagged", lagged)
    serial = F.when(F.col("power") > 0, 2 * normal_above(F.abs(F.col("lagged") / F.col("power") * F.sqrt(n)))).otherwise(0.0)
    rows = rows.withColumn("p_serial", serial)
    # All three as one, by the Cauchy combination; p-values near one are cut at 0.99, as one of them would outweigh all others.
    turned = sum(F.tan((0.5 - F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(0.99))) * math.pi) for p in ("p_chi", "p_runs", "p_serial"))
    # For large sums the arc tangent has no digits left; its tail is the reciprocal.
    mean_turned = turned / 3
    rows = rows.withColumn("p_random", F.when(mean_turned > 1e6, 1 / (mean_turned * math.pi)).otherwise(0.5 - F.atan(mean_turned) / math.pi))
    # Ordinary writing: coinciding pairs, with the spread of a sum over pairs.
    kappa, all_pairs = F.col("kappa"), n * (n - 1) / 2
    shared = (F.col("squares") - n) / 2
    triple = F.greatest(F.lit(0.0), kappa * F.sqrt(kappa) * F.lit(0.9) - kappa * kappa)
    spread = F.sqrt(all_pairs * kappa * (1 - kappa) + n * (n - 1) * (n - 2) * triple * 0.25)
    rows = rows.withColumn("p_ordinary", 1 - normal_above((shared - kappa * all_pairs) / spread))
    return rows.drop("core", "alphabet", "kappa", "m", "squares", "x", "pairs", "runs", "above", "mean", "power", "lagged")


def _level(p: Column) -> Column:
    """The histogram bin of a p-value: steps of a twentieth of a power of ten."""
    level = F.floor(-F.log10(F.greatest(p, F.lit(1e-90))) * BINS_PER_DECADE)
    return F.greatest(F.least(level, F.lit(MOST_BINS)), F.lit(0)).cast("int")


def _limits(tested: DataFrame, level: str, eligible: Column, rate: float) -> DataFrame:
    """(class, limit): by the Benjamini-Hochberg rule, the least bin from which ``eligible`` rows are discoveries."""
    bins = tested.groupBy("class", F.col(level).alias("bin")).agg(
        F.count(F.lit(1)).alias("tests"), F.count(F.when(eligible, 1)).alias("passed"))
    whole = Window.partitionBy("class")
    down = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("m", F.sum("tests").over(whole)).withColumn("k", F.sum("passed").over(down))
    worst = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_PER_DECADE)))
    return bins.where(worst * F.col("m") <= rate * F.col("k")).groupBy("class").agg(F.min("bin").alias("limit"))


def discoveries(spark: SparkSession, tokens: DataFrame, rate: float, reject: float) -> DataFrame:
    """The tokens that are not told from random and lie beyond the false-discovery limit of their class of lengths."""
    tested = battery(tokens).withColumn("class", F.floor(F.log2("n")).cast("int"))
    tested = tested.withColumn("away", _level(F.col("p_random"))).withColumn("level", _level(F.col("p_ordinary")))
    tested = persist(spark, tested, "secrets-tested")
    # One row for each power of two among the lengths: a few dozen at any size.
    ordered = F.broadcast(_limits(tested, "away", F.lit(True), reject).withColumnRenamed("limit", "ordered"))
    tested = tested.join(ordered, "class", "left").withColumn("random", F.col("ordered").isNull() | (F.col("away") < F.col("ordered")))
    found = F.broadcast(_limits(tested, "level", F.col("random"), rate))
    kept = tested.join(found, "class").where(F.col("random") & (F.col("level") >= F.col("limit")))
    return kept.select("row", "start", "end", "encoding", "p_chi", "p_runs", "p_serial", "p_random", "p_ordinary")


def scan_secrets(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, reject: float = 0.01
) -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans, and all spans as an array.

    ``rate`` is the false-discovery rate of reported runs, ``reject`` that of runs
    declared not random.
    """
    text = text_of(text_col)
    part = lambda spans: F.filter(spans, lambda s: F.length(s["part"]) >= ASSIGN_VALUE)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        part(found(text, ASSIGN, 2)).alias("assign"),
        found(text, ACCESS).alias("access"),
        found(text, HEX).alias("hex"),
        found(text, CANDIDATE).alias("candidates"),
    )
    base = F.concat(*[_listed(k, F.col(name)) for k, name in enumerate(KINDS[:3])])
    rows = rows.select(
        "doc_id", "row", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), "candidates"
    )
    rows = persist(spark, rows, "secrets-found")
    tokens = rows.where(F.size("candidates") > 0).select("row", F.inline("candidates"))
    random = discoveries(spark, tokens, rate, reject)
    one = F.struct("start", F.lit(3).alias("kind"), "end")
    random = random.groupBy("row").agg(F.collect_list(one).alias("random"))
    rows = rows.join(random, "row", "left")
    every = F.concat("base", F.coalesce("random", F.array().cast(rows.schema["base"].dataType)))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_sort(every).alias("all_spans"),
    )
