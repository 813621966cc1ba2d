"""Language identification as mixture inference.

A document is a bag of hashed byte trigrams.  Its languages' proportions come
from expectation-maximisation on the likelihoods of the trigrams; the set of
languages is the one of best penalised likelihood, found by dropping the least
language while the loss stays under the penalty.

Training counts trigrams per language over a bounded sample of labelled rows
(``sample_rows``, a documented parameter); prediction reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_bucket, text_of, unused
from .tokens import portions, released

CELLS = 1 << 16
UNDETERMINED = "und"


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the hashed byte trigrams of the lower-cased text; all that is no letter becomes a blank."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    letter = (b >= 128) | ((b >= 97) & (b <= 122))
    b = np.where(letter, b, 32)
    b = np.concatenate([[32], b[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    if len(code) > CELLS:
        counts = np.bincount(code, minlength=CELLS)
        cells = np.flatnonzero(counts)
        return cells, counts[cells].astype(float)
    cells, counts = np.unique(code.astype(np.uint16), return_counts=True)
    return cells.astype(np.int64), counts.astype(float)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        """counts: (languages, CELLS)"""
        self.langs = langs
        p = counts + smooth
        self.logp = np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32)  # (CELLS, languages)

    def infer(self, text: str, penalty: float = 12.0, rounds: int = 15) -> tuple[list[str], list[float], str, float]:
        """(languages kept, their proportions, predicted language, its proportion among all languages)."""
        cells, counts = trigrams(text)
        if not len(self.langs) or not len(cells):
            return [], [], UNDETERMINED, 0.0
        rows = self.logp[cells].astype(float)
        top = rows.max(1, keepdims=True)
        like = np.exp(rows - top)
        n = counts.sum()
        floor = float(counts @ top[:, 0])

        def fit(keep: np.ndarray) -> tuple[np.ndarray, float]:
            part = like[:, keep]
            pi = np.full(len(keep), 1 / len(keep))
            for _ in range(rounds if len(keep) > 1 else 0):
                joint = part * pi
                pi = (counts / joint.sum(1)) @ joint / n
            return pi, floor + float(counts @ np.log(np.maximum(part @ pi, 1e-300)))

        keep = np.arange(len(self.langs))
        pi, best = fit(keep)
        share = pi
        charge = penalty * math.log(n + 1)
        while len(keep) > 1:
            least = int(pi.argmin())
            fewer = np.delete(keep, least)
            new_pi, value = fit(fewer)
            if best - value > charge:
                break
            keep, pi, best = fewer, new_pi, value
        first = int(keep[pi.argmax()])
        return [self.langs[k] for k in keep], [float(x) for x in pi], self.langs[first], min(1.0, float(share[first]))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, where=None
) -> Model:
    """Trigram counts per language from rows with text and language (and ``where``).

    The counts that come to the driver are bounded by the sample: at most
    ``CELLS`` cells for each language in it.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = bounded_sample(rows, "id", sample_rows).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                cells, counts = trigrams(text)
                sums.setdefault(lang, np.zeros(CELLS))[cells] += counts
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.record_batch({"lang": [lang] * len(cells), "cell": cells, "n": total[cells].astype(np.int64)})

    parts = rows.mapInArrow(count, "lang string, cell long, n long")
    total = parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(total["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((len(langs), CELLS))
    counts[[place[x] for x in total["lang"].to_pylist()], total["cell"].to_numpy()] = total["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Adds lang_pred, score, langs and proportions to id and ``keep`` columns, one row per input row.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts where there was nothing to learn from.  ``score`` is the proportion of
    the predicted language among all languages.
    """
    text = text_of(text_col)
    some = F.when(text.rlike(r"\p{L}"), text).alias("__text")
    rows = docs.select(F.col(id_col), *keep, some)
    names = [id_col, *keep]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "__text"):
                found = [model.infer(t) if t else ([], [], UNDETERMINED, 0.0) for t in batch["__text"].to_pylist()]
                langs, shares, lang, score = map(list, zip(*found))
                arrays = [batch[c] for c in names] + [
                    pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                ]
                yield pa.record_batch(arrays, names=[*names, "lang_pred", "score", "langs", "proportions"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, langs array<string>, proportions array<double>")


def identify_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, proportions; learns from rows outside the held-out quarter."""
    held = crc_bucket("doc_id", 4) == 2
    model = train(docs, where=~held)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("held_out",))


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without documents that have no letter or no language with a proportion of ``least`` or more; columns unchanged.

    Null and empty texts go.  Rows that repeat are judged each for itself.  Where
    there was nothing to learn from, every text with a letter stays.
    """
    held = crc_bucket("doc_id", 4) == 2
    model = train(docs, where=~held)
    names = docs.columns
    # A mark goes along instead of the text once more: a batch of whole texts is held several times on its way.
    (own,) = unused(names, "__letter")
    rows = docs.withColumn(own, text_of("text").rlike(r"\p{L}"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                some = zip(batch[own].to_pylist(), batch["text"].to_pylist())
                good = [letter and (not model.langs or model.infer(t)[3] >= least) for letter, t in some]
                yield batch.select(names).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(lambda b: released(pick(b)), docs.schema)
