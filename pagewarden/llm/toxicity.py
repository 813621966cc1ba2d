"""Toxicity by weak supervision.

Voters are lexicon words and patterns (beginnings of words), a short fixed
lexicon and lists learned from the labels of the training fold, and the label
itself where a training row has one.  A generative model estimates, without
taking any voter for true, each voter's accuracy on both classes by
expectation-maximisation; voters that agree more than their accuracies explain
share their weight.  A linear classifier over words and beginnings of words is
then trained on the posterior labels and scores whole texts.

Everything is fitted on bounded samples (documented parameters) of the training
fold: ``sample_rows`` rows with a label, and ``unlabelled_rows`` without one, on
which the label abstains and the other voters decide.

Null and empty texts have no feature.  Rows that repeat, or share or lack an id,
are scored each for itself; of the texts of one labelled id the least counts for
training.  Scores that tie at 0.5 count as toxic.  An empty table gives no rows.
Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_bucket, persist, text_of

# Plain insults that start the lexicon.
LEXICON = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def features(text: str) -> set[str]:
    """Distinct words ("=word") and beginnings of longer words ("^begi")."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.add("=" + w)
        for k in BEGINNINGS:
            if len(w) >= k:
                out.add("^" + w[:k])
    return out


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.words = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.starts = {f[1:]: w for f, w in weights.items() if f[0] == "^"}
        self.sizes = sorted({len(f) for f in self.starts})
        self.bias = bias

    def score(self, text: str) -> float:
        words, starts, sizes = self.words, self.starts, self.sizes
        seen = set(_WORD.findall(text.lower())) if text else ()
        z, used = self.bias, set()
        for w in seen:
            if w in words:
                z += words[w]
            for k in sizes:
                s = w[:k]
                if len(s) == k and s in starts and s not in used:
                    used.add(s)
                    z += starts[s]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Posterior of the positive class per row.

    ``votes``: rows by voters, 1 for, -1 against, 0 abstains.  Each voter has a
    chance to speak for and against in either class.  After the first fit,
    correlations that remain within the classes divide the voters' weights.
    """
    start = votes.clip(0).sum(1)
    post = np.where(start > 0, 0.9, 0.5 * prior)
    weight = np.ones(votes.shape[1])
    for k in range(rounds):
        prior = float(np.clip(post.mean(), 1e-3, 0.5))
        gap = np.full(len(votes), math.log(prior / (1 - prior)))
        for side in (1, -1):
            says = (votes == side).astype(float)
            yes = (says.T @ post + 0.5) / (post.sum() + 10)
            no = (says.T @ (1 - post) + 0.05) / ((1 - post).sum() + 10)
            gap += says @ (weight * np.log(yes / no))
        post = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        if k == rounds // 3:
            weight = 1 / (1 + _shared(votes, post))
    return post


def _shared(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Per voter, the sum of its positive correlations with the others, given the class."""
    v = (votes > 0).astype(float)
    mean = np.outer(post, (v.T @ post) / max(post.sum(), 1)) + np.outer(1 - post, (v.T @ (1 - post)) / max((1 - post).sum(), 1))
    rest = v - mean
    cov = rest.T @ rest
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return np.where(corr > 0.1, corr, 0).sum(1)


def linear(rows: list[np.ndarray], target: np.ndarray, n: int, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sparse 0/1 rows, by accelerated gradient steps."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    rate = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.05
    w[n] = math.log(rate / (1 - rate))
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(rows)) + w[n]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(col, err[row], n) + l2 * w[:n], err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:n], float(w[n])


def train(
    docs: DataFrame, labels: DataFrame, where=None, sample_rows: int = 12_000, unlabelled_rows: int = 6_000,
    most_features: int = 4000, voters: int = 200, least_yes: int = 4, least_z: float = 3.0,
) -> Scorer:
    """Fit on a sample of the training fold (``where``, by default ids whose crc32 mod 5 is not 0).

    Several labels of a document count as the highest.  Features occur in
    ``least_yes`` toxic documents or more, ``least_z`` deviations above what
    chance gives; the best ``most_features`` are weighed, ``voters`` of them vote.
    What comes to the driver is bounded by these parameters.  Without a row to fit
    on, or any label, all scores are those of the fixed lexicon.
    """
    fold = crc_bucket("doc_id", 5) != 0 if where is None else where
    every = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    gold = bounded_sample(every.where(fold), "doc_id", sample_rows)
    ones, n = gold.agg(F.sum((F.col("toxic") > 0).cast("int")), F.count(F.lit(1))).first()
    fixed = ["=" + w for w in LEXICON]
    plain = Scorer({f: 6.0 for f in fixed}, -3.0)
    if not n or not ones:
        return plain
    rate = ones / n
    other = docs.select("doc_id").where(F.col("doc_id").isNotNull() & fold).distinct().join(every.select("doc_id"), "doc_id", "left_anti")
    other = bounded_sample(other, "doc_id", unlabelled_rows).withColumn("toxic", F.lit(None).cast("int"))
    wanted = F.broadcast(gold.unionByName(other))  # bounded by sample_rows and unlabelled_rows
    rows = docs.select("doc_id", text_of("text").alias("text")).join(wanted, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = persist(docs.sparkSession, rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for f in features(text):
                    sums.setdefault(f, [0, 0])[1 if y else 0] += 1
        names = list(sums)
        yield pa.record_batch({"f": names, "no": [sums[f][0] for f in names], "yes": [sums[f][1] for f in names]},
                              schema=pa.schema([("f", pa.string()), ("no", pa.int64()), ("yes", pa.int64())]))

    sample = rows.select("text", "toxic")
    counts = sample.where("toxic IS NOT NULL").mapInArrow(count, "f string, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    all_ = F.col("no") + F.col("yes")
    z = (F.col("yes") - rate * all_) / F.sqrt(all_ * rate + 1)
    best = counts.where(F.col("yes") >= least_yes).withColumn("z", z).where(F.col("z") > least_z).orderBy(F.desc("z"), "f").limit(most_features)
    best = [(r["f"], r["no"], r["yes"]) for r in best.collect()]
    names = list(dict.fromkeys([f for f, _, _ in best] + fixed))
    place = {f: k for k, f in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[place[f] for f in features(t) if f in place] for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(got, pa.list_(pa.int32())), batch["toxic"].cast(pa.int32())], names=["hits", "toxic"])

    table = sample.mapInArrow(hits, "hits array<int>, toxic int").toArrow()
    found = [np.array(sorted(x), np.int64) for x in table["hits"].to_pylist()]
    if not found:  # labels of other documents only
        return plain
    y = table["toxic"].fill_null(-1).to_numpy()  # -1: no label
    order = sorted(range(len(found)), key=lambda k: (found[k].tobytes(), int(y[k])))  # the same fit in each run
    found, y = [found[k] for k in order], y[order]
    # Voters: the fixed lexicon, learned words and beginnings that are rarely seen without the label, the label itself.
    sure = [f for f, no, yes in best if yes >= 8 and yes > 4 * no][:voters]
    chosen = list(dict.fromkeys(fixed + sure))
    where_voter = {place[f]: k for k, f in enumerate(chosen)}
    votes = np.zeros((len(found), len(chosen) + 2), np.int8)
    for k, x in enumerate(found):
        mine = [where_voter[c] for c in x if c in where_voter]
        votes[k, mine] = 1
        votes[k, -2] = 0 if mine else -1  # a voter against: no pattern at all
        votes[k, -1] = 1 if y[k] > 0 else -1 if y[k] == 0 else 0  # the label, where there is one
    post = label_model(votes, rate)
    w, bias = linear(found, post, len(names))
    return Scorer({f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-4}, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.  Null and empty texts get the score of no feature."""
    scorer = scorer or train(docs, labels)
    rows = docs.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), text_of("text").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([scorer.score(t) for t in batch["text"].to_pylist()], float)
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")
