"""Best-fit packing of token pieces by the configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides how
lengths share sequences, so the solving is the same work at any corpus size:

1. The covering program (least number of configurations that together hold each
   length as often as it occurs) is solved by multiplicative weights: a length's
   price falls exponentially with the share of it that is covered; a knapsack
   dynamic program over the capacity finds the greatest price a sequence can hold
   and, from each length, configurations within ``tolerance`` of it.  Each table
   of prices also gives a lower bound, its dual.
2. The fractional solution is rounded, and what is left is solved anew, until a
   round places little.  The last pieces, and those of configurations that are
   not full, go best-fit into the room left, then into new sequences.
3. Pieces are dealt to the places of the configurations by their rank within
   their length.  Ranks come from counts per (task, length), joined back, so no
   length gathers in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist, small_batches, text_of
from .tokens import END_ID, encoder, gathered, portions, released

CAPACITY = 2048


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int, choices: int = 32) -> tuple[np.ndarray, list[list[int]]]:
    """For each capacity the greatest value, sizes repeating, and the best sizes to take last, the best one first."""
    best = np.zeros(capacity + 1)
    last: list[list[int]] = [[]] * (capacity + 1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(int(sizes[0]), capacity + 1):
        k = fit[c]
        gain = best[c - sizes[:k]] + values[:k]
        top = np.argpartition(gain, k - choices)[k - choices :] if k > choices else np.arange(k)
        top = top[np.argsort(-gain[top], kind="stable")]
        best[c] = max(gain[top[0]], best[c - 1])
        last[c] = top[gain[top] >= 0.995 * best[c]].tolist()
    return best, last


class Fractional(NamedTuple):
    """A fractional solution: configurations with their weights, the share of each length covered, and a lower bound."""

    sizes: np.ndarray
    weights: dict[tuple, float]
    share: np.ndarray
    bound: float


def solve(histogram: dict[int, int], capacity: int, eps: float = 0.5, tolerance: float = 0.01, most_phases: int = 60) -> Fractional:
    """Multiplicative weights for the covering program; no length is covered more than once over.

    A phase covers at most ``eps`` of a length.  Only configurations within
    ``tolerance`` of the greatest price are taken; phases end when these run out.
    """
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], float)
    left, weights, bound, limit, poor = demand.copy(), {}, 0.0, tolerance / 4, 0
    for _ in range(most_phases):
        live = np.flatnonzero(left > 1e-9 * demand)
        if not len(live) or poor > 2:
            break
        size = sizes[live]
        price = size / capacity * np.exp(left[live] / demand[live] - 1)
        best, last = knapsack(size, price, capacity)
        bound = max(bound, float(demand[live] @ price) / best[capacity])
        budget = np.minimum(left[live], eps * demand[live]).tolist()
        lengths, most, prices = size.tolist(), demand[live].tolist(), price.tolist()
        least, moved = (1 - limit) * best[capacity], 0.0
        for j in range(len(live) - 1, -1, -1):
            while budget[j] > 1e-9 * most[j]:
                config, c = {j: 1}, capacity - lengths[j]
                while c > 0:
                    i = next((i for i in last[c] if budget[i] > 1e-9 * most[i] and config.get(i, 0) < most[i]), -1)
                    if i < 0:
                        c -= 1
                        continue
                    config[i] = config.get(i, 0) + 1
                    c -= lengths[i]
                if sum(prices[i] * n for i, n in config.items()) < least:
                    break
                step = min(budget[i] / n for i, n in config.items())
                key = tuple(sorted((lengths[i], n) for i, n in config.items()))
                weights[key] = weights.get(key, 0.0) + step
                moved += step * sum(s * n for s, n in key)
                for i, n in config.items():
                    budget[i] -= n * step
                    left[live[i]] -= n * step
        if moved < 0.1 * eps * float(left @ sizes):
            poor += limit >= tolerance
            limit = min(2 * limit, tolerance)
        else:
            poor = 0
    return Fractional(sizes, weights, 1 - left / demand, bound)


def rounded(weights: dict[tuple, float], left: dict[int, int]) -> list[tuple[tuple, int]]:
    """Whole numbers of configurations, largest weights first; fractions add up to one more now and then.  Takes from ``left``."""
    out, carry = [], 0.5
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        times = int(weights[key] + 1e-9)
        carry += weights[key] - times
        if carry >= 1:
            times, carry = times + 1, carry - 1
        times = min(times, *(left[s] // n for s, n in key))
        if times > 0:
            out.append((key, times))
            for s, n in key:
                left[s] -= n * times
    return out


def best_fit(left: dict[int, int], open_: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences and equal lengths are handled together."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for config, times in open_:
        room = capacity - sum(s * n for s, n in config.items())
        bins.setdefault(room, []).append((config, times))
    rooms = sorted(bins)
    for size in sorted(left, reverse=True):
        count = left[size]
        while count > 0:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                full, rest = divmod(count, each)
                fresh = [({size: each}, full)] if full else []
                fresh += [({size: rest}, 1)] if rest else []
                count = 0
                put = [(capacity - sum(s * n for s, n in c.items()), c, t) for c, t in fresh]
            else:
                room = rooms[k]
                config, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(k)
                each = min(room // size, max(1, count // times) if count >= times else 1)
                use = min(times, count // each)
                grown = dict(config)
                grown[size] = grown.get(size, 0) + each
                put = [(room - size * each, grown, use)]
                if times > use:
                    put.append((room, config, times - use))
                count -= use * each
            for room, config, times in put:
                if room not in bins:
                    bins[room] = []
                    bisect.insort(rooms, room)
                bins[room].append((config, times))
    return [x for room in bins.values() for x in room]


class Plan(NamedTuple):
    """Configurations [({length: count}, times)], a lower bound of their number, and the pieces that the program placed."""

    configurations: list[tuple[dict[int, int], int]]
    bound: float
    placed: int

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.configurations)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 16, slack: int = 1) -> Plan:
    """How often each configuration is used; every length exactly as often as the histogram has it.

    ``rounds``: how often the rounded rest is solved anew at most.  Whatever is
    left then is placed best-fit, so no piece is lost.  Rounded configurations
    with more than ``slack`` places empty give their pieces to that rest where
    this needs fewer sequences; the full ones stay as the program has them.
    """
    left = dict(histogram)
    used: Counter = Counter()
    bound, rest = 0.0, sum(left.values())
    for k in range(rounds):
        left = {s: n for s, n in left.items() if n}
        if not left:
            break
        # The first solution is spread over more configurations; later ones take whole lengths at a step.
        found = solve(left, capacity) if k == 0 else solve(left, capacity, eps=1.0)
        bound = bound or found.bound
        for key, times in rounded(found.weights, left):
            used[key] += times
        before, rest = rest, sum(left.values())
        if before - rest < 0.1 * before:
            break
    pieces = sum(histogram.values())
    plans = []
    for most in (capacity, slack):
        whole, rest = [], Counter({s: n for s, n in left.items() if n})
        for key, times in used.items():
            if capacity - sum(s * n for s, n in key) <= most:
                whole.append((dict(key), times))
            else:
                rest.update({s: n * times for s, n in key})
        plans.append(Plan(best_fit(dict(rest), whole, capacity), bound, pieces - sum(rest.values())))
    return min(plans, key=lambda p: p.sequences)


class Places:
    """Where the k-th piece of a length goes: runs of ranks per length, from a plan."""

    def __init__(self, configs: list[tuple[dict[int, int], int]]):
        rows, sequence = [], 0
        used: Counter = Counter()
        for config, times in configs:
            offset = 0
            for size in sorted(config, reverse=True):
                for _ in range(config[size]):
                    rows.append((size, used[size], sequence, offset))
                    used[size] += times
                    offset += size
            sequence += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key = (table[:, 0].astype(np.uint64) << np.uint64(44)) | table[:, 1].astype(np.uint64)
        self.first, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.uint64) << np.uint64(44)) | rank.astype(np.uint64)
        k = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[k] + rank - self.first[k], self.offset[k]


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: the first may be shorter."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _pieces(vocabulary: str | None, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encode, cut, and number the pieces of each length within the task.

    The encoder's cache goes with the task: hundreds of MB for two waiting workers, and little use to the next task.
    """
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    seen = np.zeros(capacity + 1, np.int64)
    coder = None
    try:
        for whole in gathered(batches, "text"):
            for batch in portions(whole, "text"):
                coder = encoder(vocabulary)
                ids, bounds = coder.encode(batch["text"])
                out: list[tuple] = []
                for doc, a, b in zip(batch["doc_id"].to_pylist(), bounds[:-1], bounds[1:]):
                    body = np.append(ids[a:b], END_ID).astype("<u4")
                    start = 0
                    for piece, n in enumerate(cut(len(body), capacity)):
                        out.append((doc, piece, start, n, zlib.crc32(body[start : start + n].tobytes()), task, int(seen[n])))
                        seen[n] += 1
                        start += n
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "place")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)
    finally:
        if coder:
            coder.forget()


def pack(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id, so null and empty texts are one piece
    of one id.  Repeated rows are packed as often as they occur; other columns
    are not read.  Sequences are gapless from offset 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with small_batches(spark):
        pieces = persist(spark, rows.mapInArrow(lambda b: released(_pieces(vocabulary, capacity, b)), PIECES), "pack-pieces")
    counts = persist(spark, pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = Places(plan(histogram, capacity).configurations)
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long")).drop("n")
    # A row for each task and length: it grows with the tasks, so it is never broadcast.
    ranked = pieces.join(first.hint("merge"), ["task", "length"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["place"].to_numpy() + b["first"].to_numpy()
            sequence, offset = places.find(length, rank)
            yield pa.record_batch(
                [b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
