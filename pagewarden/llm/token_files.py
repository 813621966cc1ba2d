"""Token-id files with a minimal perfect hash index.

Texts are encoded where they are read, so only ids are shuffled.  Shards are
ranges of document ids of about ``shard_bytes`` of text; each becomes three files
in a folder of a shared store, written through ``pyarrow.fs`` (local, HDFS or
object store URIs) under a temporary name and then renamed, so that a task that
runs twice leaves the same file:

* ``<shard>.ids``  raw little-endian ids, 2 bytes each where the vocabulary
  allows, else 4;
* ``<shard>.mph``  the index: header, displacements, and per slot a 4-byte
  fingerprint, an 8-byte offset and an 8-byte length (in ids), then where each row ends;
* ``<shard>.keys`` the distinct keys in order, only for listing a shard.

A slot holds the run of all rows with its key; the list of ends parts the rows.
Rows without an id come last; their run has no slot and begins where the header
says.

The index is a minimal perfect hash by "hash and displace": keys fall into
buckets of about four, each bucket has the smallest displacement that sends its
keys to free slots.  A lookup reads one displacement and one slot; the
fingerprint tells foreign keys.  Shards hold key ranges, listed in a small
manifest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist, scratch_path, settings, text_of
from .tokens import END_ID, encoder, gathered, portions

MAGIC = b"PWTOKMPH"
#: Bytes of text in a shard, and of ids read at a time.
SHARD_BYTES = 64 << 20
READ_BYTES = 4 << 20
LAST = 2**63 - 1
BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}
HEADER = struct.Struct("<8sIIIQQQQ")  # magic, version, bytes per id, buckets, keys, ids, ids before the run without key, rows
SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of integer keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    a, b = mix(keys, 1), mix(keys, 2) | np.uint64(1)
    return ((a + displacement.astype(np.uint64) * b) >> np.uint64(11)) % np.uint64(n)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements of the buckets, slot of each key).  Keys must be distinct."""
    n = len(keys)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, np.int64)
    if len(np.unique(keys)) != n:
        raise ValueError("keys repeat")
    buckets = max(1, n // 4)
    home = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    a, b = mix(keys, 1), mix(keys, 2) | np.uint64(1)
    order = np.argsort(home, kind="stable")
    first = np.searchsorted(home[order], np.arange(buckets + 1))
    size = np.diff(first)
    taken = np.zeros(n, bool)
    displacement, slot = np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    m, tries = np.uint64(n), np.arange(256, dtype=np.uint64)
    for bucket in np.argsort(-size, kind="stable"):
        if not size[bucket]:
            break
        mine = order[first[bucket] : first[bucket + 1]]
        start = 0
        while True:
            d = tries + np.uint64(start)
            at = (((a[mine][:, None] + d * b[mine][:, None]) >> np.uint64(11)) % m).astype(np.int64)
            good = ~taken[at].any(0)
            if len(mine) > 1 and good.any():
                s = np.sort(at, 0)
                good &= (s[1:] != s[:-1]).all(0)
            if good.any():
                k = int(good.argmax())
                displacement[bucket] = start + k
                slot[mine] = at[:, k]
                taken[at[:, k]] = True
                break
            start += len(tries)
    return displacement, slot


class Shard:
    """Keyed access to one shard: the index, and the ids held in memory (or a memory map); without ids, places only."""

    def __init__(self, ids: bytes | memoryview, index: bytes | memoryview):
        magic, version, self.width, buckets, n, self.total, self.keyed, n_rows = HEADER.unpack_from(index)
        if magic != MAGIC or version != 2:
            raise ValueError("not an index of token ids")
        at = HEADER.size
        self.n = n
        self.displacement = np.frombuffer(index, "<u4", buckets, at)
        self.slots = np.frombuffer(index, SLOT, n, at + 4 * buckets)
        self.ends = np.frombuffer(index, "<u8", n_rows, at + 4 * buckets + SLOT.itemsize * n).astype(np.int64)
        self.ids = np.frombuffer(ids, f"<u{self.width}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys, -1 where the fingerprint says the key is foreign."""
        keys = np.asarray(keys, np.int64).astype(np.uint64)
        if not self.n:
            return np.full(len(keys), -1)
        home = mix(keys, 0) % np.uint64(len(self.displacement))
        slot = _slots(keys, self.displacement[home], self.n).astype(np.int64)
        same = self.slots["fingerprint"][slot] == (mix(keys, 3) >> np.uint64(32)).astype(np.uint32)
        return np.where(same, slot, -1)

    def get(self, key: int | None) -> np.ndarray | None:
        """The run of a key; None stands for the rows without id."""
        if key is None:
            return self.ids[self.keyed :] if self.keyed < self.total else None
        k = int(self.find(np.array([key]))[0])
        if k < 0:
            return None
        s = self.slots[k]
        return self.ids[int(s["offset"]) : int(s["offset"]) + int(s["length"])]

    def rows(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of the rows in the run of ``n`` ids at ``at``."""
        first, last = np.searchsorted(self.ends, [at, at + n], "right")
        size = np.diff(self.ends[first:last], prepend=at)
        return self.ends[first:last] - size, size


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _finish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    try:
        fs.move(temporary, final)
    except OSError:  # another attempt of the task was first; the contents are the same
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)


ENCODED = "shard int, key long, body binary"


def _encode(vocabulary: str | None, bounds: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each text with the end id, and the shard of its key (null: the last)."""
    for batch in gathered(batches, "text"):
        for part in portions(batch, "text"):
            coder = encoder(vocabulary)
            ids, cuts = coder.encode(part["text"])
            body = np.insert(ids, cuts[1:], END_ID).astype(f"<u{_width(coder)}")
            offsets = (cuts + np.arange(len(cuts))) * body.itemsize
            shard = np.searchsorted(bounds, part["key"].fill_null(LAST).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            shard[part["key"].is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
            yield pa.record_batch([pa.array(shard), part["key"], coded], names=["shard", "key", "body"])


def _width(coder) -> int:
    return 2 if coder.tok.get_vocab_size() <= 1 << 16 else 4


class _Writer:
    """One shard's files; rows come in the order of keys, those without key last."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, attempt: int, width: int):
        self.fs, self.shard, self.width = fs, shard, width
        self.name, self.tag = f"{folder}/{shard:06d}", f".{attempt}.tmp"
        self.keys, self.lengths, self.without = [], [], 0
        self.out = fs.open_output_stream(f"{self.name}.ids{self.tag}")

    def add(self, keys: pa.Array, bodies: pa.Array) -> None:
        for body in bodies:
            self.out.write(body.as_buffer())
        self.without += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False))
        self.lengths.append(pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64) // self.width)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        key, length = np.concatenate(self.keys).astype(np.int64), np.concatenate(self.lengths)
        n_docs, total, keyed = len(length), int(length.sum()), int(length[: len(length) - self.without].sum())
        ends = np.cumsum(length)
        offset = ends - length
        key, first = np.unique(key, return_index=True)  # sorted as they are
        offset = offset[first]
        length = np.diff(offset, append=keyed)
        displacement, slot = build_index(key.astype(np.uint64))
        slots = np.zeros(len(key), SLOT)
        slots["fingerprint"][slot] = (mix(key.astype(np.uint64), 3) >> np.uint64(32)).astype(np.uint32)
        slots["offset"][slot], slots["length"][slot] = offset, length
        with self.fs.open_output_stream(f"{self.name}.mph{self.tag}") as f:
            f.write(HEADER.pack(MAGIC, 2, self.width, len(displacement), len(key), total, keyed, n_docs))
            f.write(displacement.astype("<u4").tobytes())
            f.write(slots.tobytes())
            f.write(ends.astype("<u8").tobytes())
        with self.fs.open_output_stream(f"{self.name}.keys{self.tag}") as f:
            f.write(key.astype("<i8").tobytes())
        for kind in ("ids", "mph", "keys"):
            _finish(self.fs, f"{self.name}.{kind}{self.tag}", f"{self.name}.{kind}")
        return pa.record_batch({
            "shard": pa.array([self.shard], pa.int64()), "first_key": pa.array([int(k) for k in key[:1]] or [None], pa.int64()),
            "last_key": pa.array([int(k) for k in key[-1:]] or [None], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()),
            "n_ids": pa.array([total], pa.int64()),
        })


def _write_shards(uri: str, vocabulary: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (shard, key): the files of each shard; gives the manifest rows."""
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    fs, folder = _store(uri)
    writer = None
    for batch in batches:
        shard = batch["shard"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                if writer is None or writer.shard != int(shard[a]):
                    if writer is not None:
                        yield writer.close()
                    fs.create_dir(folder, recursive=True)
                    writer = _Writer(fs, folder, int(shard[a]), attempt, _width(encoder(vocabulary)))
                writer.add(batch["key"].slice(a, b - a), batch["body"].slice(a, b - a))
    if writer is not None:
        yield writer.close()


MANIFEST = "shard long, first_key long, last_key long, n_docs long, n_ids long"


def write_token_files(
    spark: SparkSession, docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write ``docs`` as token files in ascending id order; return the manifest with each shard's first position.

    Null texts count as empty: their ids are the end id alone.  Rows with a null
    id come last, in the files' run without key.  Rows with one id are one run, in
    the order of their ids' bytes.  Other columns are not read.  Shards end at
    quantiles of the ids, one for each ``shard_bytes`` of text, so a few very long
    texts do not change the number of rows of a shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    # One bound for each shard comes to the driver.
    bounds = rows.approxQuantile("key", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = sorted({int(b) for b in bounds or []})
    coded = rows.mapInArrow(partial(_encode, vocabulary, bounds), ENCODED)
    coded = coded.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_last("key"), "body")
    manifest = coded.mapInArrow(partial(_write_shards, uri, vocabulary), MANIFEST)
    with settings(spark, **BATCHES):
        manifest = persist(spark, manifest, "token-manifest")
    # One row per shard; ids in shards follow the order of shard numbers.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _listed(raw: pa.NativeFile, store: Shard, base: int, key: pa.Array, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in file order, their ids read by range: some megabytes, or one row, at a time."""
    part = np.cumsum(n * store.width) // READ_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(n)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            first, last = int(at[a]), int(at[b - 1] + n[b - 1])
            ids = np.frombuffer(raw.read_at((last - first) * store.width, first * store.width), f"<u{store.width}").astype("<u4")
            crc = [zlib.crc32(ids[i : i + k].tobytes()) for i, k in zip((at[a:b] - first).tolist(), n[a:b].tolist())]
            yield pa.record_batch({"doc_id": key.slice(a, b - a), "start": at[a:b] + base, "n_tokens": n[a:b], "ids_crc32": np.array(crc, np.int64)})


def read_token_files(manifest: DataFrame, uri: str, null_ids: bool = False) -> DataFrame:
    """Every document through the index: doc_id, start, n_tokens, ids_crc32.

    With ``null_ids`` the rows without id are listed too, so that every row
    written is read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(uri)
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                index, listing = (fs.open_input_file(f"{folder}/{shard:06d}.{kind}").readall() for kind in ("mph", "keys"))
                store, keys = Shard(b"", index), np.frombuffer(listing, "<i8")
                with fs.open_input_file(f"{folder}/{shard:06d}.ids") as raw:
                    for i in range(0, len(keys), 4096):
                        some = keys[i : i + 4096]
                        slot = store.find(some)
                        if (slot < 0).any():
                            raise ValueError(f"shard {shard}: a key is not in its index")
                        at = store.slots["offset"][slot].astype(np.int64)
                        n = store.slots["length"][slot].astype(np.int64)
                        parts = [store.rows(a, k) for a, k in zip(at.tolist(), n.tolist())]
                        at, n = map(np.concatenate, zip(*parts))
                        yield from _listed(raw, store, base, pa.array(np.repeat(some, [len(p[0]) for p in parts])), at, n)
                    if null_ids and store.keyed < store.total:
                        at, n = store.rows(store.keyed, store.total - store.keyed)
                        yield from _listed(raw, store, base, pa.nulls(len(at), pa.int64()), at, n)

    n = manifest.count()
    rows = manifest.select("shard", "base")
    rows = rows.repartition(max(1, n), "shard") if n > 1 else rows
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    uri = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(spark, docs, uri), uri, null_ids=True)
