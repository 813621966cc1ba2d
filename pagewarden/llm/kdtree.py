"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to cells by coarse median splits, found on a bounded sample,
and a cell with too many rows is dealt on by hash, so shards are compact and of
bounded size however many vectors are alike.  A shard is one KD-tree: median
splits on the widest side, tight bounding boxes at every node, points of a leaf
next to each other.  A query walks a tree best-first by the upper bound of its
inner product with a node's box and stops when the bound cannot beat its k-th
score so far.  The k-th score of a query's first shard, one of its own cell,
travels with the query to all the others, which then prune against it from the
start.

Queries of a cell travel in blocks, one row each.  Blocks go to the trees, some
blocks at a time, so neither all vectors nor all queries are ever in one place.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, persist

LEAF = 256
SHARD_ROWS = 20_000
BLOCK_ROWS = 1024
#: Blocks that meet a tree in one task: as many queries as a shard has vectors, about.
BLOCKS_AT_ONCE = 16
#: Rows the coarse splits are found on; they decide how even the shards are, not what is found.
SPLIT_SAMPLE = 4096
EXACT = 2.0**53
LOW, HIGH = -(2**63) + 1, 2**63 - 1


def integer_vector(column: str, scale: int = 64) -> Column:
    """floor(scale * component), component as double; null where a component is null, infinite or not a number.

    Values beyond the range of long become its ends.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col(column).isNotNull() & good, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


class Tree:
    """points: (n, d) int64; ids: (n,) int64.  Points and ids are kept in leaf order."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        nodes: list[tuple[int, int, int, int]] = []  # begin, end, left child, right child
        low, high, least = [], [], []

        def build(begin: int, end: int) -> int:
            me, mine = len(nodes), order[begin:end]
            part = points[mine]
            nodes.append((begin, end, -1, -1))
            lo, hi = part.min(0), part.max(0)
            low.append(lo.astype(np.int64))
            high.append(hi.astype(np.int64))
            least.append(int(ids[mine].min()))
            # Equal points need no further split: their box is a point.
            if end - begin > leaf and (hi > lo).any():
                axis = int((hi.astype(float) - lo).argmax())
                middle = (end - begin) // 2
                order[begin:end] = mine[np.argpartition(part[:, axis], middle)]
                left = build(begin, begin + middle)
                right = build(begin + middle, end)
                nodes[me] = (begin, end, left, right)
            return me

        d = points.shape[1]
        if len(points):
            build(0, len(points))
        self.nodes = nodes
        self.low = np.array(low, np.int64).reshape(-1, d)
        self.high = np.array(high, np.int64).reshape(-1, d)
        self.least = np.array(least, np.int64)
        self.ids = ids[order]
        self.points = compact(points[order])
        self.top = float(np.abs(points.astype(float)).max()) if points.size else 0.0

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int]]]:
        """Per query up to k (score, -id), best first; ``floor``: per query the (score, -id) to beat, or None."""
        width = max(self.points.shape[1], queries.shape[1])
        pad = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        points, q = pad(self.points), pad(queries)
        reach = self.top * (float(np.abs(q.astype(float)).max()) if q.size else 0.0) * max(1, width)
        # Doubles hold these sums exactly up to 2**53; beyond, whole numbers of any size.
        kind = np.float64 if reach < EXACT else object
        points, q = points.astype(kind), q.astype(kind)
        low, high = pad(self.low).astype(kind), pad(self.high).astype(kind)
        zero = kind(0) if kind is np.float64 else 0
        bounds = np.where(q > 0, q, zero) @ high.T + np.where(q < 0, q, zero) @ low.T
        out = []
        for i in range(len(q)):
            if floor[i] is not None and bounds[i][0] < floor[i][0]:
                out.append([])  # nothing in this shard can reach the k-th score
            else:
                out.append(self._one(points, q[i], int(query_ids[i]), bounds[i], k, floor[i]))
        return out

    def _one(self, points, q, own, bound, k, floor):
        best: list[tuple[int, int]] = []  # a heap, worst first
        frontier = [(-bound[0], 0)]
        while frontier:
            negative, node = heapq.heappop(frontier)
            worst = best[0] if len(best) == k else floor
            if worst is not None and floor is not None:
                worst = max(worst, floor)
            if worst is not None and (int(-negative), -int(self.least[node])) < worst:
                if -negative < worst[0]:
                    break  # all that is left has lower bounds still
                continue  # ties: only smaller ids could enter
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(frontier, (-bound[left], left))
                heapq.heappush(frontier, (-bound[right], right))
                continue
            score = points[begin:end] @ q
            ids = self.ids[begin:end]
            good = ids != own
            if worst is not None:
                good &= score >= worst[0]
            if not good.all():
                near = np.flatnonzero(good)
                score, ids = score[near], ids[near]
            if len(score) > k and points.dtype == np.float64:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                near = np.flatnonzero(score >= cut)
                score, ids = score[near], ids[near]
                if len(score) > k:  # ties at the cut
                    near = np.lexsort((ids, -score))[:k]
                    score, ids = score[near], ids[near]
            for s, x in zip(score.tolist(), ids.tolist()):
                item = (int(s), -x)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    return out


def compact(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them: trees and query blocks travel as rows."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


class Splits:
    """Coarse median splits of a sample into ``cells`` cells of about equal size."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # axis, cut, left, right; axis -1: left is the cell
        self.cells = 0
        self._split(points, max(1, cells))

    def _split(self, points: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0, self.cells, 0))
        if cells > 1 and len(points) > 1 and points.shape[1]:
            axis = int((points.max(0).astype(float) - points.min(0)).argmax())
            cut = int(np.partition(points[:, axis], len(points) // 2)[len(points) // 2])
            below = points[:, axis] < cut
            if below.any():
                left = self._split(points[below], cells // 2)
                self.nodes[me] = (axis, cut, left, self._split(points[~below], cells - cells // 2))
                return me
        self.cells += 1
        return me

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            axis, cut, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            else:
                below = (points[rows, axis] if axis < points.shape[1] else np.zeros(len(rows), np.int64)) < cut
                waiting += [(left, rows[below]), (right, rows[~below])]
        return out


def _dealt(spark: SparkSession, celled: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """``celled`` with a column ``name``: parts of a cell with about ``rows`` rows each, numbered through; the number of parts."""
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts")).collect()  # a row for each cell
    parts = {r["cell"]: r["parts"] for r in sizes}
    first, at = {}, 0
    for cell in sorted(parts):
        first[cell], at = at, at + parts[cell]
    table = spark.createDataFrame([(c, first[c], parts[c]) for c in parts] or [(0, 0, 1)], "cell int, first int, parts int")
    part = F.col("first") + F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
    return celled.join(F.broadcast(table), "cell").withColumn(name, part).drop("parts"), at  # a row for each cell


FOUND = "block int, at int, vec_id long, score long, reached boolean"


def _search_kernel(k: int):
    def search(blocks: pa.Table, trees: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"block": [], "at": [], "vec_id": [], "score": [], "reached": []}
        if len(trees):
            tree = pickle.loads(trees["tree"][0].as_py())
            for block, body, floor in zip(*(blocks[c].to_pylist() for c in ("block", "queries", "floor"))):
                matrix, ids = pickle.loads(body)
                worst: list = [None] * len(ids)
                for f in floor or ():
                    worst[f["at"]] = (f["score"], -f["vec_id"])
                for at, best in enumerate(tree.search(matrix, ids, k, worst)):
                    cols["block"] += [block] * len(best)
                    cols["at"] += [at] * len(best)
                    cols["vec_id"] += [-x for _, x in best]
                    cols["score"] += [min(max(s, LOW), HIGH) for s, _ in best]
                    cols["reached"] += [LOW < s < HIGH for s, _ in best]
        kinds = {"block": pa.int32(), "at": pa.int32(), "vec_id": pa.int64(), "score": pa.int64(), "reached": pa.bool_()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in cols.items()})

    return search


def exact_top_k(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score for tables (vec_id long, v array<long>); further columns are not read.

    Rows with a null id, or a vector that is null or holds null, take no part.  Vectors of different
    lengths are compared as if the shorter were filled up with zeros.  A query
    does not find rows with its own id.  Ties go to the smaller id.  An id that
    occurs more than once is a candidate as often as it occurs, and a query as
    often.  Scores beyond the range of long are given as its ends; among those
    at the same end the smaller id comes first.  Without queries, or without
    candidates, there are no rows.
    """
    whole = "vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)"
    vectors, queries = vectors.where(whole).select("vec_id", "v"), queries.where(whole).select("vec_id", "v")
    n = vectors.count()
    sample = bounded_sample(vectors, "vec_id", SPLIT_SAMPLE, "v").toArrow()  # at most SPLIT_SAMPLE rows
    # A cell needs some sampled rows for its median to mean anything.
    splits = Splits(_matrix(sample["v"]), min(-(-n // shard_rows), max(1, len(sample) // 16)))

    def cells(batches):
        for b in batches:
            cell = splits.cell(_matrix(pa.chunked_array([b["v"]])))
            yield pa.record_batch([b["vec_id"], b["v"], pa.array(cell), b["key"]], names=["vec_id", "v", "cell", "key"])

    def build(table: pa.Table) -> pa.Table:
        tree = Tree(_matrix(table["v"]), table["vec_id"].to_numpy())
        return pa.table({"shard": table["shard"].slice(0, 1), "first": table["first"].slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def block(table: pa.Table) -> pa.Table:
        body = (compact(_matrix(table["v"])), table["vec_id"].to_numpy())
        return pa.table({"block": table["block"].slice(0, 1), "cell": table["cell"].slice(0, 1), "queries": pa.array([pickle.dumps(body)], pa.binary())})

    # The key deals equal rows to different parts too; it is written with the rows before it is used.
    numbered = lambda df: df.withColumn("key", F.monotonically_increasing_id())
    celled = lambda df: numbered(df).mapInArrow(cells, "vec_id long, v array<long>, cell int, key long")
    rows = persist(spark, celled(vectors), "kd-cells")
    asked = persist(spark, celled(queries), "kd-asked")
    dealt, shards = _dealt(spark, rows, shard_rows, "shard")
    trees = persist(spark, dealt.groupBy("shard").applyInArrow(build, "shard int, first int, tree binary"), "kd-trees")
    dealt, blocks = _dealt(spark, asked, block_rows, "block")
    packs = persist(spark, dealt.groupBy("block").applyInArrow(block, "block int, cell int, queries binary"), "kd-queries")
    if not shards or not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def meet(asked: DataFrame) -> DataFrame:
        """Blocks (with their shard) at the trees; a tree goes to as many tasks as there are chunks of blocks."""
        chunk = F.floor(F.col("block") / BLOCKS_AT_ONCE).cast("int")
        left = asked.select("block", "queries", "floor", "shard", chunk.alias("chunk"))
        chunks = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_AT_ONCE)))
        right = trees.select("shard", "tree", chunks.alias("chunk"))
        both = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk"))
        return both.applyInArrow(_search_kernel(k), FOUND)

    # First a shard of the block's own cell; cells without vectors start at the first shard.
    own = trees.groupBy("first").agg(F.min("shard").alias("home"))
    cell_home = _cells_home(spark, rows, own)
    home = packs.join(cell_home, "cell", "left").withColumn("home", F.coalesce("home", F.lit(0)))
    home = persist(spark, home.select("block", "queries", "home"), "kd-homes")
    none = F.lit(None).cast("array<struct<at:int,vec_id:long,score:long>>")
    first = persist(spark, meet(home.withColumn("shard", F.col("home")).withColumn("floor", none)), "kd-first")
    found = first
    if shards > 1:
        # The k-th score of each query that has k, as one list for each block.
        last = F.max(F.struct((-F.col("score")).alias("less"), "vec_id", F.col("reached").alias("sure")))
        kth = first.groupBy("block", "at").agg(F.count(F.lit(1)).alias("n"), last.alias("last")).where(F.col("n") >= k).where("last.sure")
        one = F.struct("at", F.col("last.vec_id").alias("vec_id"), (-F.col("last.less")).alias("score"))
        floors = kth.groupBy("block").agg(F.collect_list(one).alias("floor"))
        others = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        rest = home.join(floors, "block", "left").select("block", "queries", "floor", "home", others).where("shard != home")
        found = first.unionByName(meet(rest))
    return _ranked(found, packs, k)


def _cells_home(spark: SparkSession, rows: DataFrame, own: DataFrame) -> DataFrame:
    """(cell, home): the first shard of each cell that has vectors."""
    cells = [r["cell"] for r in rows.select("cell").distinct().orderBy("cell").collect()]  # a row for each cell
    firsts = [r["home"] for r in own.orderBy("first").collect()]
    return spark.createDataFrame(list(zip(cells, firsts)), "cell int, home int")


def _ranked(found: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """At most k rows per query and shard come in; the best k of a query stay."""
    best = F.struct((-F.col("score")).alias("less"), "vec_id")
    lists = found.groupBy("block", "at").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("best"))

    def names(batches):
        for b in batches:
            for block, body in zip(b["block"].to_pylist(), b["queries"].to_pylist()):
                ids = pickle.loads(body)[1]
                yield pa.record_batch([pa.array(np.full(len(ids), block, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                      names=["block", "at", "query_id"])

    named = packs.select("block", "queries").mapInArrow(names, "block int, at int, query_id long")
    rows = lists.join(named, ["block", "at"]).select("query_id", F.posexplode("best").alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
