"""N-gram Jaccard join: all documents whose sets of word n-grams have a similarity of at least ``least``.

1. Signatures: MinHash values in bands; band and row counts follow from the
   target recall at ``least``.  Documents with the same n-gram set are one node
   from here on (the hash of the whole sorted set), however many there are.
2. Nodes that share a band hash are joined to the least node of the bucket
   (one row per node and band, never the pairs of a bucket), and the
   components of these edges hold every candidate pair.
3. Verification on full sets: within a component, exact intersections of all
   pairs are counted in memory.  Large components are cut into blocks, and a
   task takes two blocks; only counts and one edge per node leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist, small_batches, text_of, unused
from .components import components
from .tokens import portions, released

WORDS = 5
LEAST = 0.8
RECALL = 0.9995
BLOCK_ROWS = 512
BLOCK_ITEMS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def finalise(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words (runs outside blanks).

    A text of fewer words than ``words`` has one n-gram, all its words; a text
    without words has none.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    word = finalise((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    total = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        total = total * _STEP + word[j : len(word) - k + 1 + j]
    return np.unique(finalise(total))


def bands_for(least: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows) with most rows such that a pair at ``least`` is found with chance ``recall`` within ``most`` hashes."""
    choice = (math.ceil(math.log(1 - recall) / math.log(1 - least)), 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(least**rows)))
        if bands * rows <= most:
            choice = (bands, rows)
    return choice


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def bands_of(self, items: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(items), 1024):
            part = items[i : i + 1024]
            np.minimum(low, (self.a[:, None] * part + self.b[:, None]).min(1), out=low)
        total = np.arange(self.bands).astype(np.uint64)
        for row in low.reshape(self.bands, self.rows).T:
            total = finalise(total * _STEP + row)
        return total.view(np.int64)


def _set_hash(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _signatures(names: list[str], words: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(bands, rows)
    for batch in (part for whole in batches for part in portions(whole, "text")):
        hashes, found, sizes = [], [], []
        memo: dict[bytes, np.ndarray] = {}
        for text in batch["text"].to_pylist():
            items = shingles(text, words)
            sizes.append(len(items))
            if not len(items):
                hashes.append(None)
                found.append(None)
                continue
            key = _set_hash(items)
            if key not in memo:
                memo[key] = minhash.bands_of(items)
            hashes.append(key)
            found.append(memo[key])
        out = [batch[c] for c in names] + [pa.array(hashes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
        yield pa.record_batch(out, names=[*names, "set_hash", "bands", "items"])


def similar_pairs(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> np.ndarray:
    """Boolean matrix of the pairs with a similarity of ``least`` or more; with sides only pairs across count, also where one is empty."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((n, n), np.float32)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    code = np.concatenate([[0], np.cumsum(items[1:] != items[:-1])]) if len(items) else np.zeros(0, np.int64)
    shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
    owner, code = owner[shared], code[shared]
    if len(code):
        code = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        for start in range(0, int(code[-1]) + 1, 4096):
            a, b = np.searchsorted(code, [start, start + 4096])
            dense = np.zeros((n, min(4096, int(code[-1]) + 1 - start)), np.float32)
            dense[owner[a:b], code[a:b] - start] = 1
            inter += dense @ dense.T
    inter = np.rint(inter).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    # inter / union >= least, without division; 1e-9 keeps 4 of 5 at 0.8.
    good = inter >= least * union - 1e-9
    np.fill_diagonal(good, False)
    if side is not None:
        good &= side[:, None] != side[None, :]
    return good


def _roots(good: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    root = np.arange(len(good))
    while True:
        new = root.copy()
        a, b = np.nonzero(good)
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


LINKS = "node long, root long, links long"


def _verify(words: int, least: float, table: pa.Table) -> pa.Table:
    node = table["node"].to_numpy()
    order = np.argsort(node)
    node = node[order]
    copies = table["copies"].to_numpy()[order]
    mine = table["block"].to_numpy()[order]
    first, second = table["i"][0].as_py(), table["j"][0].as_py()
    raw = table["items"].take(pa.array(order)).to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in raw]
    side = (mine == second) if first != second else None
    good = similar_pairs(sets, side, least)
    links = good @ copies
    root = node[_roots(good)]
    some = links > 0
    return pa.table({"node": pa.array(node[some], pa.int64()), "root": pa.array(root[some], pa.int64()), "links": pa.array(links[some], pa.int64())})


def _text_key() -> list:
    text = F.col("text")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def jaccard_join(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = LEAST,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: doc_id, class_id, rep_id, n_links, row, class_row, h1, h2.

    ``class_id`` is the smallest id among the documents linked directly or
    through others; ``rep_id`` the smallest id with the same n-gram set;
    ``n_links`` the number of other rows with a similarity of ``least`` or more,
    rows with the same set included.  Null, empty and blank texts have no
    n-grams, link to nothing and are their own class.  Null ids count as larger
    than all others.  ``row`` numbers the rows; ``class_row`` is that of the
    class's first document.
    """
    bands, rows = bands_for(least, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    named = source.select("doc_id", F.monotonically_increasing_id().alias("row"), *_text_key(), "text")
    names = ["doc_id", "row", "h1", "h2"]
    kinds = "doc_id long, row long, h1 long, h2 long, set_hash binary, bands array<long>, items int"
    signed = named.mapInArrow(lambda b: released(_signatures(names, words, bands, rows, b)), kinds)
    with small_batches(spark):
        signed = persist(spark, signed, "jaccard-signatures")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h1", "h2")).alias("rep")
    same = signed.where("items > 0").groupBy("set_hash").agg(
        first, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("items").alias("items"))
    nodes = persist(spark, same.select("set_hash", "rep.doc_id", "rep.row", "rep.h1", "rep.h2", "copies", "bands", "items"), "jaccard-nodes")

    keyed = nodes.select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = keyed.join(buckets, "band").where("node != m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    comps = persist(spark, components(spark, edges, "jaccard-candidates"), "jaccard-members")
    size = comps.join(nodes.select(F.col("row").alias("node"), "items"), "node").groupBy("root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("items").alias("items"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    size = persist(spark, size.select("root", parts.alias("parts")), "jaccard-sizes")
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = comps.join(size, "root").select("node", "root", "parts", block.alias("block"))
    members = members.join(nodes.select(F.col("row").alias("node"), "doc_id", "h1", "h2", "copies"), "node")

    # The texts of the candidates come from the table itself, found by id and content.
    texts = source.select("doc_id", *_text_key(), "text").withColumnRenamed("doc_id", "d").withColumnRenamed("h1", "k1")
    texts = texts.withColumnRenamed("h2", "k2")
    match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    full = texts.join(members, match).select("node", "root", "parts", "block", "copies", "text")

    def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words).tobytes() for t in b["text"].to_pylist()]
            keep = [b[c] for c in ("node", "root", "parts", "block", "copies")]
            yield pa.record_batch([*keep, pa.array(sets, pa.binary())], names=["node", "root", "parts", "block", "copies", "items"])

    full = full.mapInArrow(lambda b: released(item_sets(b)), "node long, root long, parts int, block int, copies long, items binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = full.select("node", "root", "block", "copies", "items", other)
    dealt = dealt.select(
        "node", "root", "block", "copies", "items", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    ).dropDuplicates(["node", "i", "j"]) if _repeats(nodes) else dealt.select(
        "node", "root", "block", "copies", "items", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = dealt.groupBy("root", "i", "j").applyInArrow(lambda t: _verify(words, least, t), LINKS)
    with small_batches(spark):
        found = persist(spark, found, "jaccard-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    if size.where("parts > 1").isEmpty():
        roots = found.select("node", "root")
    else:
        roots = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    return _rows(spark, signed, nodes, links, roots)


def _repeats(nodes: DataFrame) -> bool:
    """Whether an id and text occur more than once (then the text join finds them more than once)."""
    return not nodes.where("copies > 1").isEmpty()


def _rows(spark: SparkSession, signed: DataFrame, nodes: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    small = nodes.select("set_hash", F.col("doc_id").alias("rep_id"), F.col("row").alias("node"), "copies")
    small = small.join(links, "node", "left").join(roots, "node", "left")
    small = small.withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    first = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "node")).alias("head")
    heads = small.groupBy("root").agg(first)
    small = small.join(heads, "root").select(
        "set_hash", "rep_id", "links", F.col("head.rep_id").alias("class_id"), F.col("head.node").alias("class_row"))
    out = signed.where("items > 0").join(small, "set_hash").select(
        "doc_id", "class_id", "rep_id", F.col("links").alias("n_links"), "row", "class_row", "h1", "h2")
    none = signed.where("items = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"),
        "row", F.col("row").alias("class_row"), "h1", "h2")
    return out.unionByName(none)


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the first by id; columns unchanged.

    Rows that repeat both id and text count once.
    """
    rows = jaccard_join(spark, docs, id_col, text_col)
    stay = persist(spark, rows.where("row = class_row").select("doc_id", "h1", "h2"), "jaccard-kept")
    twice = rows.groupBy("doc_id", "h1", "h2").count().where("count > 1")
    repeated = not twice.isEmpty()
    own, h1, h2, k1, k2 = unused(docs.columns, "__id", "__h1", "__h2", "__k1", "__k2")
    marked = docs.select("*", F.xxhash64(text_of(text_col)).alias(h1), F.xxhash64(F.lit("second"), text_of(text_col)).alias(h2))
    if repeated:
        marked = marked.dropDuplicates([id_col, h1, h2])
    stay = stay.select(F.col("doc_id").alias(own), F.col("h1").alias(k1), F.col("h2").alias(k2))
    match = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2))
    return marked.join(stay, match, "left_semi").select(docs.columns)
