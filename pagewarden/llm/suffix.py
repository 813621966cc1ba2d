"""Removal of repeated byte strings with suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id.  Equal strings are brought together by content, then each shard
sorts its suffixes:

1. Blocks.  Documents travel in blocks of about a megabyte, joined end to end;
   a place is a block and a byte in it, so repeated or missing ids confuse nothing.
2. Segments.  Every 50-byte window has an anchor, the least hash of the 20-grams
   in it, so equal windows have equal anchors.  A maximal run of windows with the
   same anchor (31 at most) is a segment of at most 80 bytes.  A block lists each
   distinct segment once (anchor, digest, least id, places), so a passage that
   many documents share is one row for each block.
3. Whole segments.  In the order of anchor, digest and id, the first row of a
   digest holds the least id with that segment; all rows with larger ids lose all
   its windows.  An anchor with one digest is settled by that.
4. Shards.  The first rows of anchors with several digests may share windows with
   other segments.  They are cut into pieces by the 35 bytes next to the anchor
   that all windows of a piece hold; pieces that hold the same meet in a shard,
   which needs only a number for these bytes and the bytes on either side.  A
   shard's suffix array is built by induced sorting: suffixes are classified,
   leftmost-smaller (LMS) substrings are sorted, their names form a shorter string
   that is sorted by the same steps, recursively, and the whole array is induced
   from it in two linear passes over byte buckets.  Permuted common prefixes, capped
   at the length of a window, then part the array into groups of equal windows, and
   a window goes where its group has a smaller id.
5. Marked windows go back to their blocks.

Pieces too many for one array are cut again, by half as many places of the anchor
and as many shared bytes more; at the last step a piece is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, persist, settings, text_of
from .tokens import portions

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1  # windows that can hold one gram
#: Bytes of documents in a block, bytes of pieces in an array, pieces in a group that need no further cut.
BLOCK_BYTES = 1 << 20
ARRAY_BYTES = 1 << 20
GROUP_PIECES = 12_000
#: A null id counts as larger than all others.
LAST = 2**63 - 1
#: Alphabets up to this are induced by buckets.
NARROW = 1024

U = np.uint64


# ---------------------------------------------------------------- suffix array


def _induce(text: np.ndarray, kinds: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order: one pass up (L-type), one pass down (S-type).

    Within a bucket, suffixes are placed in rounds: those induced from other
    buckets, then those these induce in the same bucket, and so on.
    """
    n = len(text)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    seeds = np.split(lms[order], np.searchsorted(first[order], np.arange(1, sigma)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def hand_on(source: np.ndarray, want: int, own: int) -> np.ndarray:
        """Predecessors of type ``want``: those of another bucket wait there, those of ``own`` are returned."""
        p = source[source > 0] - 1
        p = p[kinds[p] == want]
        c = text[p]
        same = p[c == own]
        other = c != own
        p, c = p[other], c[other]
        if len(p):
            by = np.argsort(c, kind="stable")
            p, c = p[by], c[by]
            cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part, ch in zip(np.split(p, cuts), c[np.concatenate([[0], cuts])]):
                waiting[int(ch)].append(part)
        return same

    # Up: L-type suffixes.  The empty suffix after the end induces the last one.
    if n and kinds[n - 1] == 0:
        waiting[int(text[n - 1])].append(np.array([n - 1]))
    l_parts: list[np.ndarray] = []
    for c in range(sigma):
        done = []
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(front):
            done.append(front)
            front = hand_on(front, 0, c)
        l_parts.append(np.concatenate(done) if done else np.zeros(0, np.int64))
        if len(seeds[c]):
            hand_on(seeds[c], 0, c)
    # Down: S-type suffixes, in falling order.
    waiting = [[] for _ in range(sigma)]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
    for c in range(sigma - 1, -1, -1):
        done = []
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(front):
            done.append(front)
            front = hand_on(front, 1, c)
        falling = l_parts[c][::-1]
        if len(falling):
            hand_on(falling, 1, c)
        s_part = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
        out[c] = np.concatenate([l_parts[c], s_part])
    return np.concatenate(out)


def _types(text: np.ndarray) -> np.ndarray:
    """1 for S-type (smaller than the next suffix), 0 for L-type; the last suffix is L-type."""
    n = len(text)
    kinds = np.zeros(n, np.int8)
    if n < 2:
        return kinds
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = text[:-1] < text[1:]
    # A position takes the type of the next place where two neighbours differ.
    nxt = np.searchsorted(differs, np.arange(n - 1))
    has = nxt < len(differs)
    kinds[: n - 1][has] = smaller[differs[nxt[has]]]
    return kinds


def _sorted_ranks(text: np.ndarray, kinds: np.ndarray, lms: np.ndarray, sigma: int, at: np.ndarray, order_of_lms: np.ndarray | None) -> np.ndarray:
    """For each of the places ``at``, how many of them come before it.

    Compared are the (value, type) symbols up to and with the next LMS place, then
    the rank of that place's suffix.  Two suffixes that agree so far reach their
    LMS places together, so this is the order of the suffixes.  Without the ranks
    it is the order of the LMS substrings, equal ones alike.
    """
    n = len(text)
    bits = (2 * sigma + 2).bit_length()
    many = max(1, 62 // bits)  # symbols that are compared at once
    symbols = np.zeros(n + many + 1, np.int64)
    symbols[:n] = 2 * text.astype(np.int64) + kinds + 1  # the end is less than all
    next_lms = np.searchsorted(lms, at, "right")
    length = np.append(lms, n)[next_lms] - at
    rank = np.zeros(len(at), np.int64)
    live, by = np.arange(len(at)), 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        ended = length[live] < by
        mine = at[live]
        for k in range(by, by + many):
            word = (word << bits) | np.where(k <= length[live], symbols[np.minimum(mine + k, n)], 0)
        if order_of_lms is not None:
            word[ended] = np.append(order_of_lms, -1)[next_lms[live[ended]]]
        order = np.lexsort((word, rank[live])) if by else np.argsort(word, kind="stable")
        live, word, ended = live[order], word[order], ended[order]
        old = rank[live]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = new_group | np.concatenate([[True], word[1:] != word[:-1]])
        place = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[live] = old + head - start
        alone = fresh & np.append(fresh[1:], True)
        live = np.sort(live[~(alone | ended)])
        by += many
    return rank


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of ``text`` (values below ``sigma``).

    LMS substrings are sorted and named; where names repeat, the string of names
    is sorted in the same way.  From its order the whole array is induced, over
    value buckets where these are few, else (in strings of names) from the symbols
    up to the next LMS place and its rank.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    kinds = _types(text)
    lms = np.flatnonzero((kinds[1:] == 1) & (kinds[:-1] == 0)) + 1
    names = _sorted_ranks(text, kinds, lms, sigma, lms, None)
    distinct, names = np.unique(names, return_inverse=True)
    if len(distinct) < len(lms):
        order = suffix_array(names, len(distinct))
    else:
        order = np.argsort(names)
    if sigma <= NARROW:
        return _induce(text, kinds, lms[order], sigma)
    rank_of_lms = np.empty(len(lms), np.int64)
    rank_of_lms[order] = np.arange(len(lms))
    array = np.empty(n, np.int64)
    array[_sorted_ranks(text, kinds, lms, sigma, np.arange(n), rank_of_lms)] = np.arange(n)
    return array


def permuted_prefixes(text: np.ndarray, array: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the common prefix (at most ``cap``) of its suffix and the one before it in the array."""
    n = len(text)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    word = np.zeros(n + cap + 8, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.full(cap + 16, 511, np.uint64)])
    # Six values of up to nine bits in a word; unequal padding never hides a difference inside the text.
    step = 6
    for j in range(step):
        word |= padded[j : j + len(word)] << np.uint64(9 * j)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    a, b, at = live, before[live], 0
    while len(a) and at < cap:
        x, y = word[np.minimum(a + at, len(word) - 1)], word[np.minimum(b + at, len(word) - 1)]
        same = x == y
        rest = x[~same] ^ y[~same]
        low = (rest & (~rest + np.uint64(1))).astype(np.float64)
        out[live[~same]] = at + (np.log2(low).astype(np.int64) // 9)
        live, a, b = live[same], a[same], b[same]
        out[live] = at + step
        at += step
    # A suffix that reaches the end of the text has no more than its own length in common.
    limit = np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0))
    return np.minimum(np.minimum(out, limit), cap)


def mark_windows(pieces: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per piece and window of ``length`` bytes, the smallest id of an equal window among all pieces."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    text = np.zeros(total, np.uint16)  # 0 parts the pieces, bytes are 1 to 256
    body = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    inside = np.ones(total, bool)
    inside[start + sizes] = False
    text[inside] = body
    array = suffix_array(text, 257)
    prefix = permuted_prefixes(text, array, length)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    window = np.repeat(sizes, sizes + 1) - (np.arange(total) - start[owner]) >= length
    group = np.cumsum(prefix[array] < length)
    valid = window[array]
    least = np.full(int(group[-1]) + 1, LAST)
    np.minimum.at(least, group[valid], ids[owner[array[valid]]])
    out = np.full(total, LAST)
    out[array[valid]] = least[group[valid]]
    return [out[a : a + max(0, s - length + 1)] for a, s in zip(start, sizes)]


# ------------------------------------------------------------ blocks, segments


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(body: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of every ``gram`` bytes, by doubling: 1, 2, 4, 8, 16, then the rest."""
    n = len(body)
    base = [U(pow(0x9E3779B97F4A7C55, 1 << k, 1 << 64)) for k in range(7)]
    h, by = {1: body.astype(U) + U(1)}, 1
    while by * 2 <= gram:
        h[by * 2] = h[by][: n - 2 * by + 1] * base[by.bit_length() - 1] + h[by][by : n - by + 1]
        by *= 2
    value, have = h[by], by
    for part in sorted((p for p in h if p < by and (gram - by) & p), reverse=True):
        value = value[: n - have - part + 1] * base[part.bit_length() - 1] + h[part][have : n - part + 1]
        have += part
    return finish(value)


def least_of(value: np.ndarray) -> np.ndarray:
    """For each window the least hash of its grams."""
    low, size = value, 1
    while size * 2 <= WINDOWS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = len(value) - WINDOWS + 1
    return np.minimum(low[:m], low[WINDOWS - size : WINDOWS - size + m])


def segments(body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, first byte, windows) of the segments of documents of ``sizes`` bytes that make up ``body``."""
    none = np.zeros(0, U)
    if len(body) < LENGTH:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    value = grams(body)
    low = least_of(value)
    ends = np.cumsum(sizes)
    # Windows that begin in the last 49 bytes of a document leave it; a run also ends there.
    change = np.empty(len(low) + 1, bool)
    np.not_equal(low[1:], low[:-1], out=change[1:-1])
    change[0] = change[-1] = True
    some = sizes > 0
    change[(ends - sizes)[some & (ends - sizes <= len(low))]] = True
    last = np.maximum(ends - sizes, ends - LENGTH + 1)[some]
    change[last[last <= len(low)]] = True
    cut = np.flatnonzero(change)
    first, k = cut[:-1], np.diff(cut)
    document = np.searchsorted(ends, first, "right")
    good = first + LENGTH <= ends[document]
    first, k = first[good], k[good]
    if len(k) and int(k.max()) > WINDOWS:  # bytes that repeat at short distance: runs of one hash at many places
        parts = -(-k // WINDOWS)
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, k = np.repeat(first, parts) + within * WINDOWS, np.minimum(np.repeat(k, parts) - within * WINDOWS, WINDOWS)
    # Four grams cover the 50 to 80 bytes.
    end = first + k + LENGTH - 1 - GRAM
    digest = value[first] * U(0xD6E8FEB86659FD93) + value[first + GRAM]
    digest = finish(digest * U(0xD6E8FEB86659FD93) + value[np.minimum(first + 2 * GRAM, end)])
    digest = finish(digest * U(0xD6E8FEB86659FD93) + value[end] + k.astype(U))
    return low[first], digest, first, k


BLOCKS = "block long, ids array<long>, sizes array<int>, body binary"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 36
    for batch in batches:
        for part in portions(batch, "body", BLOCK_BYTES):
            sizes = pc.binary_length(part["body"]).cast(pa.int32())
            yield pa.record_batch([
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["doc_id"]),
                pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), sizes), pa.array([b"".join(part["body"].to_pylist())], pa.binary()),
            ], names=["block", "ids", "sizes", "body"])
            number += 1


def _block(ids: pa.Array, sizes: pa.Array, body: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, sizes, ids with null as the last) of a block."""
    own = ids[k].values.fill_null(LAST).to_numpy(zero_copy_only=False)
    return np.frombuffer(body[k].as_buffer(), np.uint8), sizes[k].values.to_numpy(zero_copy_only=False).astype(np.int64), own


#: ``place``: first byte, windows and whether several ids have the segment, in one number; a row takes 16 bytes that say nothing of each other.
LISTED = "anchor long, digest long, least long, block long, place long, more binary"


def _list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of each block: least id, whether a larger id has it too, first place, further places."""
    for batch in batches:
        for j in range(batch.num_rows):
            body, sizes, ids = _block(batch["ids"], batch["sizes"], batch["body"], j)
            anchor, digest, first, k = segments(body, sizes)
            if not len(first):
                continue
            own = ids[np.searchsorted(np.cumsum(sizes), first, "right")]
            order = np.argsort(digest, kind="stable")
            d = digest[order]
            head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            least = np.minimum.reduceat(own[order], head)
            several = np.maximum.reduceat(own[order], head) != least
            count = np.diff(head, append=len(order))
            more: list = [None] * len(head)
            for i in np.flatnonzero(count > 1).tolist():
                more[i] = first[order[head[i] + 1 : head[i] + int(count[i])]].tobytes()
            one = order[head]
            yield pa.record_batch([
                pa.array(anchor[one].view(np.int64)), pa.array(d[head].view(np.int64)), pa.array(least),
                pa.array(np.full(len(one), batch["block"][j].as_py())), pa.array((first[one] << 6) | (k[one] << 1) | several),
                pa.array(more, pa.binary()),
            ], names=["anchor", "digest", "least", "block", "place", "more"])


JUDGED = "block long, at long, windows int, more binary, least long, marked boolean, open boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order (anchor, digest, least): the least id of each digest, and which rows to compare further.

    Between batches only the last digest's first row is held.
    """
    held: dict | None = None  # its row, whether it was given out, whether ids of its group differ
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([held["row"], batch]).combine_chunks().to_batches()[0]
        a, d, least, place = (batch[c].to_numpy() for c in ("anchor", "digest", "least", "place"))
        several = (place & 1).astype(bool)
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_d = new_a | np.concatenate([[True], d[1:] != d[:-1]])
        first_d = np.flatnonzero(new_d)
        of_d = np.cumsum(new_d) - 1
        lowest = least[first_d][of_d]  # the first row of a digest has its least id
        marked = several | (least > lowest)
        first_a = np.flatnonzero(new_a)
        of_a = np.cumsum(new_a) - 1
        digests = np.add.reduceat(new_d.astype(np.int64), first_a)
        differ = np.logical_or.reduceat(several, first_a) | (np.minimum.reduceat(least, first_a) != np.maximum.reduceat(least, first_a))
        if held:
            differ[0] |= held["differ"]
        tail = len(first_a) - 1
        compare = (digests > 1) & differ
        compare[tail] = digests[tail] > 1  # what follows may differ
        if held and held["given"]:
            compare[0] = True
        # Further rows at the least id (ids that repeat) are compared in any case, so that they need not be held.
        open_ = (compare[of_a] | ~new_d) & (least == lowest)
        out = marked | open_
        if held:
            # The held row was given out as marked if it was; here only its comparison is new.
            marked[0] = marked[0] and not held["marked"]
            open_[0] = open_[0] and not held["given"]
            out[0] = marked[0] or open_[0]
        keep = pa.array(out)
        yield pa.record_batch([
            batch["block"].filter(keep), pa.array(place[out] >> 6), pa.array((place[out] >> 1 & 31).astype(np.int32)), batch["more"].filter(keep),
            pa.array(lowest[out]), pa.array(marked[out]), pa.array(open_[out]),
        ], names=["block", "at", "windows", "more", "least", "marked", "open"])
        p = int(first_d[-1])
        repeated = bool(held) and p == 0
        held = {
            "row": batch.slice(p, 1),
            "marked": bool(marked[p]) or (repeated and held["marked"]),
            "given": bool(open_[p]) or (repeated and held["given"]),
            "differ": bool(differ[tail]),
        }


# ------------------------------------------------------------ pieces, shards


#: ``piece``: the bytes before (``left`` of them) and after those that all windows of the piece hold.
PIECES = "key long, least long, block long, at long, more binary, shift int, left int, piece binary"
_PIECE_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
_PIECE_NAMES = ["key", "least", "block", "at", "more", "shift", "left", "piece"]
#: Windows of a piece at the first cut: those with the anchor in their first 16 places, or in the others.
WIDTH = 16
_STEP = U(0xD6E8FEB86659FD93)


def _pieces_table(columns: list) -> pa.Table:
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, _PIECE_KINDS)], names=_PIECE_NAMES)


def _cut_pieces(blocks: pa.Table, open_: pa.Table) -> pa.Table:
    """The pieces of a block's open segments: runs of windows with one anchor place in one half of its range.

    All windows of a piece hold the same 35 bytes, whose hash is the key.
    """
    if not len(blocks) or not len(open_):
        return _pieces_table([[] for _ in _PIECE_NAMES])
    body, _, _ = _block(*(blocks[c].combine_chunks() for c in ("ids", "sizes", "body")), 0)
    open_ = open_.combine_chunks()
    value = grams(body)
    at, k = open_["at"].to_numpy(), open_["windows"].to_numpy().astype(np.int64)
    spot = _anchor_spots(value, at, k)
    one, several = np.flatnonzero(spot >= 0), np.flatnonzero(spot < 0)
    # A segment with its anchor at one place has two runs at most.
    middle = np.clip(spot - (WIDTH - 1), 0, k)[one]
    row, first, last = np.tile(one, 2), np.append(np.zeros(len(one), np.int64), middle), np.append(middle, k[one])
    place, low = spot[row], np.repeat([WIDTH, 0], len(one))
    if len(several):
        runs = [(i, *x) for i in several.tolist() for x in _runs(value[at[i] : at[i] + k[i] + WINDOWS - 1], int(k[i]))]
        row, first, last, place, low = (np.append(u, [r[j] for r in runs]) for j, u in enumerate((row, first, last, place, low)))
    some = np.flatnonzero(last > first)
    row, first, last, place, low = row[some], first[some], last[some], place[some], low[some]
    begin, end = at[row] + first, at[row] + last - 1 + LENGTH
    shared = at[row] + place - low  # 35 bytes from here on
    size = LENGTH - (WIDTH - 1)
    key = finish(value[shared] * _STEP + value[shared + size - GRAM] + low.astype(U)).view(np.int64)
    left, right = shared - begin, end - shared - size
    starts = np.stack([begin, shared + size], 1).ravel()
    sizes = np.stack([left, right], 1).ravel()
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    flat = body[np.repeat(starts - cuts[:-1], sizes) + np.arange(int(cuts[-1]))]
    piece = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts[::2].astype(np.int32)), pa.py_buffer(flat)])
    taken = open_.take(pa.array(row))
    number = np.full(len(row), blocks["block"][0].as_py())
    return _pieces_table([key, taken["least"], number, taken["at"], taken["more"], first.astype(np.int32), left.astype(np.int32), piece])


def _runs(value: np.ndarray, windows: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last + 1, anchor's place, least distance to it): runs with one anchor place and half."""
    begin, key = 0, None
    for i in range(windows + 1):
        now = None
        if i < windows:
            p = i + int(value[i : i + WINDOWS].argmin())
            now = (p, (p - i) // WIDTH * WIDTH)
        if now != key:
            if key is not None:
                yield begin, i, *key
            begin, key = i, now


def _anchor_spots(value: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per segment the place of its anchor, -1 where the anchor's gram stands at several."""
    out = np.empty(len(at), np.int64)
    j = np.arange(2 * WINDOWS - 1)
    for b in range(0, len(at), 4096):
        a, k = at[b : b + 4096, None], windows[b : b + 4096, None]
        inside = j < k + WINDOWS - 1
        hashes = np.where(inside, value[np.minimum(a + j, len(value) - 1)], U(2**64 - 1))
        low = hashes[:, :WINDOWS].min(1)
        same = (hashes == low[:, None]) & inside
        out[b : b + 4096] = np.where(same.sum(1) == 1, same.argmax(1), -1)
    return out


def _cut_again(width: int):
    """Pieces of windows at ``width`` places into pieces at half as many, whose windows hold half as many bytes more."""
    half = width // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _PIECE_NAMES]
            for row in batch.to_pylist():
                before, after = row["piece"][: row["left"]], row["piece"][row["left"] :]
                # A window takes j bytes before and width - 1 - j after what is shared; j falls from len(before).
                most, least = len(before), width - 1 - len(after)
                new = []
                if most >= half:  # these hold the last ``half`` bytes before it
                    low = max(least, half)
                    new.append((1, before[-half:], before[:-half], after[: width - 1 - low], row["shift"]))
                if least < half:  # these hold the first ``half`` bytes after it
                    high = min(most, half - 1)
                    new.append((0, after[:half], before[most - high :], after[half:], row["shift"] + most - high))
                for side, shared, x, y, shift in new:
                    mark = hashlib.blake2b(row["key"].to_bytes(8, "little", signed=True) + bytes([side]) + shared, digest_size=8).digest()
                    one = (int.from_bytes(mark, "little", signed=True), row["least"], row["block"], row["at"], row["more"], shift, len(x), x + y)
                    for column, v in zip(columns, one):
                        column.append(v)
            yield from _pieces_table(columns).to_batches()

    return cut


MARKS = "block long, at long, more binary, begin int, end int, least long"


def _shard(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order (key, least): suffix arrays over blocks of whole groups, and the windows that smaller ids have.

    The bytes that all windows of a group hold stand as two bytes that number the
    group in its array.  A group of one row, or of one id, has nothing to lose.
    """
    texts: list[bytes] = []
    least_of_text: list[int] = []
    rows: list[tuple] = []  # block, at, more, shift, id, text
    size = number = 0
    pending: pa.Table | None = None

    def flush() -> pa.RecordBatch:
        nonlocal size, number
        found: list[list] = [[] for _ in range(6)]
        runs = [_pack_runs(m) for m in mark_windows(texts, np.array(least_of_text, np.int64), width + 1)]
        for block, at, more, shift, own, text in rows:
            for b, e, v in zip(*runs[text]):
                if v < own:
                    for column, x in zip(found, (block, at, more, shift + b, shift + e, v)):
                        column.append(x)
        texts.clear(), least_of_text.clear(), rows.clear()
        size = number = 0
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(found, kinds)], names=["block", "at", "more", "begin", "end", "least"])

    def groups(batch: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        """Take the groups of a table in; the last one waits unless ``whole``."""
        nonlocal size, number, pending
        key, least = batch["key"].to_numpy(), batch["least"].to_numpy()
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(head[1:], len(key))
        pending = None
        if not whole:
            pending = batch.slice(int(head[-1]))
            head, end = head[:-1], end[:-1]
        some = least[head] != least[end - 1]
        for a, b in zip(head[some].tolist(), end[some].tolist()):
            part = batch.slice(a, b - a)
            mine = list(zip(part["left"].to_pylist(), part["piece"].to_pylist()))
            where = {}  # equal pieces stand once, with the id of the first
            for x, i in zip(mine, least[a:b].tolist()):
                where.setdefault(x, (len(where), i))
            total = sum(len(x) + 3 for _, x in where)
            if texts and (size + total > ARRAY_BYTES or number == 1 << 16):
                yield flush()
            name = number.to_bytes(2, "little")
            number += 1
            rows.extend((*r, i, len(texts) + where[x][0]) for *r, i, x in zip(
                *(part[c].to_pylist() for c in ("block", "at", "more", "shift", "least")), mine))
            texts.extend(x[:left] + name + x[left:] for left, x in where)
            least_of_text.extend(i for _, i in where.values())
            size += total

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            if pending is not None:
                table = pa.concat_tables([pending, table])
            yield from groups(table.combine_chunks(), False)
    if pending is not None:
        yield from groups(pending.combine_chunks(), True)
    if texts:
        yield flush()


def _pack_runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Runs of equal values: first, one past the last, value."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    a = np.concatenate([[0], cut])
    return a.tolist(), np.append(cut, len(values)).tolist(), values[a].tolist()


# ------------------------------------------------------------ removal


def _remove(blocks: pa.Table, marks: pa.Table) -> pa.Table:
    """Apply the marked windows of a block to its documents."""
    body, sizes, ids = _block(*(blocks[c].combine_chunks() for c in ("ids", "sizes", "body")), 0)
    ends = np.cumsum(sizes)
    n = len(body)
    step = np.zeros(n + 1, np.int32)
    if len(marks):
        at, begin, end, least = (marks[c].to_numpy() for c in ("at", "begin", "end", "least"))
        more = marks["more"].combine_chunks()
        with_more = np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False))
        further = [np.frombuffer(more[int(i)].as_buffer(), np.int64) for i in with_more]
        which = np.concatenate([np.arange(len(at)), np.repeat(with_more, [len(f) for f in further])]).astype(np.int64)
        at = np.concatenate([at, *further])
        begin, end, least = begin[which], end[which], least[which]
        good = least < ids[np.searchsorted(ends, at, "right")]
        np.add.at(step, (at + begin)[good], 1)
        np.add.at(step, (at + end - 1 + LENGTH)[good], -1)
    gone = np.cumsum(step[:n]) > 0
    # Edges of runs; a document's begin ends the run before it.
    flag = np.concatenate([[False], gone, [False]])
    up, down = flag[1:] & ~flag[:-1], ~flag[1:] & flag[:-1]
    starts = ends - sizes
    inner = starts[(starts > 0) & (sizes > 0)]
    split = inner[flag[inner] & flag[inner + 1]]
    up[split] = down[split] = True
    up, down = np.flatnonzero(up), np.flatnonzero(down)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[ends] - before[starts]
    first, last = np.searchsorted(up, starts), np.searchsorted(up, ends)
    kept = body[~gone].tobytes()
    left = np.arange(n + 1) - before
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[starts].tolist(), left[ends].tolist())]
    spans = [pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:]).astype(np.int32)), pa.array((edge - np.repeat(starts, last - first)).astype(np.int64)))
             for edge in (up, down)]
    return pa.table([
        blocks["ids"].combine_chunks().flatten(), pa.array(sizes), pa.array(removed.astype(np.int64)), pa.array((last - first).astype(np.int64)),
        pa.array(digests, pa.string()), *spans,
    ], names=RESULT_NAMES)


RESULT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_begin", "span_end"]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_begin array<long>, span_end array<long>"


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_begin, span_end (bytes).

    Null texts are empty.  A null id counts as larger than all others.  Rows that
    repeat an id have that id's rank, whatever their texts: they are not held
    against each other, only against smaller ids.  Texts under 50 bytes lose
    nothing.  Further columns are not read.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = {"spark__sql__execution__arrow__maxRecordsPerBatch": "50000", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("body"))
    with settings(spark, **batches):
        blocks = persist(spark, base.mapInArrow(_pack_blocks, BLOCKS), "suffix-blocks")
        listed = blocks.mapInArrow(_list_segments, LISTED).repartition(parts, "anchor").sortWithinPartitions("anchor", "digest", "least")
        judged = persist(spark, listed.mapInArrow(_judge, JUDGED), "suffix-judged")

        open_ = judged.where("open").select("block", "at", "windows", "more", "least")
        cut = blocks.groupBy("block").cogroup(open_.groupBy("block")).applyInArrow(_cut_pieces, PIECES)
        pieces = persist(spark, cut, "suffix-pieces")
        found = []
        width = WIDTH
        while True:
            large = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("first")).where(F.col("n") > GROUP_PIECES)
            large = persist(spark, large.select("key", "first"), "suffix-large")
            ended = large.isEmpty()
            usual = pieces if ended else pieces.join(large, "key", "left_anti")
            usual = usual.repartition(parts, "key").sortWithinPartitions("key", "least")
            found.append(persist(spark, usual.mapInArrow(partial(_shard, width), MARKS), "suffix-marks"))
            if ended:
                break
            rest = pieces.join(large, "key")
            if width == 1:  # pieces of one window: those with one key are equal
                end = (F.col("shift") + 1).alias("end")
                equal = rest.where("first < least").select("block", "at", "more", F.col("shift").alias("begin"), end, F.col("first").alias("least"))
                found.append(persist(spark, equal, "suffix-marks"))
                break
            again = persist(spark, rest.drop("first").mapInArrow(_cut_again(width), PIECES), "suffix-pieces")
            drop(spark, pieces)
            pieces, width = again, width // 2
        drop(spark, pieces)
    marks = judged.where("marked").select("block", "at", "more", F.lit(0).alias("begin"), F.col("windows").alias("end"), "least")
    for table in found:
        marks = marks.unionByName(table)
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove, RESULT)
