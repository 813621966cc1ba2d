"""Token ids of whole texts with the ``tokenizers`` library, with a cache of pieces.

The byte-level pattern of the vocabulary looks ahead only within white space and
never behind, so a text may be cut where one of its pre-tokens must end (see
``_begins``), the distinct pieces encoded once by the library, and the ids put
back together.  The ids equal those of encoding the text in one call.  Texts in
which a blank is followed by white space or ends a run of it (where the pattern
looks ahead) go to the library whole, as do all texts where a vocabulary splits
by another pattern.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
# The vocabulary file this engine uses unless told otherwise.
VOCABULARY = "byte_bpe_50k.json"
_SPACE = r"\s\pZ\x0b\x{85}\x{1c}-\x{1f}"
_UNSAFE = rf" [{_SPACE}]|[{_SPACE}] $"
_JOINED = rf"^ ?[^{_SPACE}]+$"
#: Classes of bytes; those of longer characters and of digits are in none.
_BLANK, _LETTER, _SIGN, _WHITE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
for _first, _last, _kind in ((ord("a"), ord("z"), _LETTER), (ord("A"), ord("Z"), _LETTER), (ord("0"), ord("9"), 0), (0x09, 0x0D, _WHITE)):
    _CLASS[_first : _last + 1] = _kind
_CLASS[0x20] = _BLANK
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _begins(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text whether a piece may begin there: before a blank, between a
    letter and an ASCII sign, and on both sides of one other white space after a letter or sign.

    Letters are those of ASCII and Latin-1.  The answer for the first bytes of a
    text may come from the text before; they begin a piece in any case or follow
    one that does.
    """
    kind = _CLASS[data]
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # not the signs for times and divided by
    kind[1:][latin] = _LETTER
    letter, sign, white = kind == _LETTER, kind == _SIGN, kind == _WHITE
    out = kind == _BLANK
    out[1:] |= (letter[:-1] & sign[1:]) | ((letter[:-1] | sign[:-1]) & white[1:])
    plain = letter | sign
    plain[1:][latin] = False  # the second byte begins no character
    out[2:] |= (letter | sign)[:-2] & white[1:-1] & plain[2:]
    return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process; it serves all tasks of a Python worker."""
    return Encoder(path)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at their end memory that is free returns to the system.

    A worker keeps what its allocators hold while it waits, also while other stages run.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, TypeError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def portions(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most_bytes
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least_bytes: int = 2 << 20, most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of short texts put together up to ``least_bytes`` of text or ``most_rows``; larger batches stay as they are.

    An encoder's lookup takes time by the size of its cache, once in each call.
    """
    held, size, rows = [], 0, 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch[column])).as_py() or 0
        if held and (size + more > least_bytes or rows + batch.num_rows > most_rows):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + more, rows + batch.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class PieceTable:
    """Places of cached pieces, by their bytes (up to 16) in open addressing; longer pieces are few and looked up by Arrow.

    Arrow's own lookup builds a table of the whole cache in each call.
    """

    def __init__(self, most: int):
        self.bits = max(10, int(2.5 * most).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high, self.length = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.long, self.long_at = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    def keys(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second eight bytes of each piece, its length, and the slot where its search begins."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.append(np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(16, np.uint8))
        words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        at, length = offsets[:-1] - offsets[0], np.diff(offsets)
        low, high = words[at] & _FIRST[np.minimum(length, 8)], words[at + 8 * (length > 8)] & _FIRST[np.clip(length - 8, 0, 8)]
        h = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (high ^ (high >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return low, high, length, (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The places of the pieces, -1 for those that are not there."""
        out = np.full(len(pieces), -1, np.int64)
        if not len(pieces):
            return out
        low, high, length, slot = self.keys(pieces)
        todo = np.flatnonzero(length <= 16)
        while len(todo):
            place = self.slots[slot[todo]]
            todo, place = todo[place >= 0], place[place >= 0]
            same = (self.low[place] == low[todo]) & (self.high[place] == high[todo]) & (self.length[place] == length[todo])
            out[todo[same]] = place[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        more = np.flatnonzero(length > 16)
        if len(more) and len(self.long):
            there = pc.fill_null(pc.index_in(pieces.take(pa.array(more)), value_set=self.long), -1).to_numpy()
            out[more] = np.where(there < 0, -1, self.long_at[there])
        return out

    def add(self, pieces: pa.Array) -> None:
        """New pieces, all different, at the places that follow."""
        n = len(self.low)
        low, high, length, slot = self.keys(pieces)
        self.low, self.high, self.length = (np.append(a, b) for a, b in ((self.low, low), (self.high, high), (self.length, length)))
        todo = np.flatnonzero(length <= 16)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = n + free
            todo = todo[self.slots[slot[todo]] != n + todo]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        more = np.flatnonzero(length > 16)
        self.long, self.long_at = pa.concat_arrays([self.long, pieces.take(pa.array(more))]), np.append(self.long_at, n + more)


class Encoder:
    """``encode(texts)`` gives (ids uint32 array, offsets int64 array of len+1).

    ``cache_pieces`` bounds the number of cached pieces; once it is reached, new
    pieces are encoded anew in each call, which costs time and changes no result.
    Pieces stay Arrow strings from the cut to the lookup: a Python object for each
    distinct piece of a batch takes longer than all else but the encoding.
    """

    def __init__(self, path: str | None = None, cache_pieces: int = 400_000):
        # One thread for each task; Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path or vocabulary_path())
        self.tok.encode_special_tokens = True
        self.cache_pieces = cache_pieces
        size = self.tok.get_vocab_size()
        # In byte-level vocabularies a token that begins with a blank is spelt with U+0120, a new line U+010A.
        self.opens = np.array([(self.tok.id_to_token(i) or "")[:1] == "\u0120" for i in range(size)])
        self.line = self.tok.token_to_id("\u010a")
        splits, added = self.tok.pre_tokenizer, self.tok.get_added_tokens_decoder().values()
        usual = isinstance(splits, ByteLevel) and splits.use_regex and not splits.add_prefix_space
        self.cuts = usual and self.line is not None and self.tok.normalizer is None and all(t.special for t in added)
        self.forget()

    def forget(self) -> None:
        """Empty the cache of pieces; what is encoded later has the same ids."""
        self.at = pa.array([], pa.large_string())
        self.table = PieceTable(self.cache_pieces)
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has; none holds white space but for a blank in front of all (``blank``).

        They are encoded in joined texts, since each text takes time of its own; in
        texts of 200 pieces an id takes less time than in longer ones.
        """
        coded, sizes = [], []
        for i in range(0, len(pieces), 200):
            block = pieces.slice(i, 200).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), block), "" if blank else "\n")
            ids = np.array(self._whole([joined[0].as_py()])[0], np.uint32)
            begins = np.flatnonzero(self.opens[ids]) if blank else np.append(0, np.flatnonzero(ids == self.line) + 1)
            if len(begins) != len(block):
                raise ValueError("a piece does not begin where it should: not a byte-level vocabulary")
            sizes.append(np.diff(begins, append=len(ids)))
            if not blank:
                sizes[-1][:-1] -= 1
                ids = ids[ids != self.line]
            coded.append(ids)
        return np.concatenate([*coded, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def _learn(self, pieces: pa.Array) -> None:
        """Encode new pieces; those that hold white space one by one."""
        n = len(self.at)
        joins = pc.match_substring_regex(pieces, _JOINED)
        blank = pc.and_(joins, pc.starts_with(pieces, " "))
        rest = pieces.filter(pc.invert(joins))
        single = self._whole(rest.to_pylist())
        parts = [pieces.filter(blank), pieces.filter(pc.and_not(joins, blank)), rest]
        coded = [self._joined(parts[0], True), self._joined(parts[1], False)]
        coded.append((np.fromiter(chain.from_iterable(single), np.uint32), np.fromiter(map(len, single), np.int64, len(single))))
        flat, size = (np.concatenate(c) for c in zip(*coded))
        # Back to the order in which the pieces came.
        order = np.concatenate([np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (blank, pc.and_not(joins, blank), pc.invert(joins))])
        if n + len(pieces) > len(self.start):
            more = max(len(self.start), len(pieces))
            self.start, self.size = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.start, self.size))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.start[n + order] = self.used + np.cumsum(size) - size
        self.size[n + order] = size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at = pa.concat_arrays([self.at, pieces])

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where those of each text begin."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        ends = offsets - offsets[0]
        if not ends[-1]:
            return pa.array([], pa.large_string()), np.zeros(n + 1, np.int64)
        data = texts.buffers()[2].slice(int(offsets[0]), int(ends[-1]))
        begin = _begins(np.frombuffer(data, np.uint8))
        whole = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False) if self.cuts else np.ones(n, bool)
        for k in np.flatnonzero(whole).tolist():
            begin[ends[k] : ends[k + 1]] = False
        begin[ends[:-1][ends[1:] > ends[:-1]]] = True
        at = np.append(np.flatnonzero(begin), ends[-1])
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data), np.searchsorted(at, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: an Arrow array of strings; null and empty texts have no ids."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        pieces, bounds = self._cut(texts)
        # The first piece of a text is not kept: it may be a whole text.
        first = np.zeros(len(pieces), bool)
        first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        coded = self._whole(pieces.filter(pa.array(first)).to_pylist())
        head_sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        head_ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(head_sizes.sum()))

        words = pieces.filter(pa.array(~first)).dictionary_encode()
        kept, used = self.at, self.used
        where = self.table.find(words.dictionary)
        new = where < 0
        if new.any():
            where[new] = len(kept) + np.arange(int(new.sum()))
            self._learn(words.dictionary.filter(pa.array(new)))
        slot = where[words.indices.to_numpy()]
        # Sources of all runs of ids, in order: per text its head, then its words.
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[~first], size[~first] = self.start[slot], self.size[slot]
        start[first], size[first] = self.used + np.cumsum(head_sizes) - head_sizes, head_sizes
        ends = np.cumsum(size)
        source = np.concatenate([self.flat[: self.used], head_ids])
        ids = source[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]
        offsets = np.concatenate([[0], ends])[bounds]
        if len(self.at) > self.cache_pieces:  # full: forget what this call added
            self.at, self.used = kept, used
        elif new.any():
            self.table.add(words.dictionary.filter(pa.array(new)))
        return ids, offsets
