import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewarden.llm import packing as K
from pagewarden.llm import token_files as T
from pagewarden.llm.common import scratch_path
from pagewarden.llm.tokens import Encoder, PieceTable, vocabulary_path

ODD = ["a  b", "a   b\n c \n d", " lead", "trail ", "\n \n", "don't  stop", "<|endoftext|> a <|endoftext|>", "é  b", "x  y", "\x1c \x1d", "日本 語 テスト", "  ", "a" * 5000]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [10, 100_000])
def test_encoder(plain, cache):
    coder = Encoder(cache_pieces=cache)
    texts = [*ODD, None, "", *ODD, "one two three one two"]
    ids, bounds = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(t), repr(t)


def test_cached_pieces_are_no_python_objects(plain):
    """For op3_best_fit_packing: making an object for each piece took over a quarter of the encoder's CPU time."""
    coder = Encoder()
    text = " ".join(f"{k}th wörd{k}" for k in range(10_000))
    coder.encode(pa.array(["first call"]))
    before = sys.getallocatedblocks()
    ids, _ = coder.encode(pa.array([text]))
    assert len(coder.at) > 19_000 and sys.getallocatedblocks() - before < 2_000
    assert ids.tolist() == plain(text) == coder.encode(pa.array([text]))[0].tolist()


def test_encoder_over_calls(plain):
    """A call beyond the bound leaves the cache as it was; known pieces still serve."""
    coder = Encoder(cache_pieces=3)
    for text, known in [("- a b", 2), ("- b c", 3), ("- d b e", 3), ("- e a c b", 3), ("- c", 3)]:
        assert coder.encode(pa.array([text, None]))[0].tolist() == plain(text)
        assert len(coder.at) == known


def test_signs_and_lines_part_pieces(plain, monkeypatch):
    """For op4_token_files: a word before any sign or line end is one piece, and no long text goes to the library for new pieces."""
    given, real = [], Encoder._whole
    monkeypatch.setattr(Encoder, "_whole", lambda self, texts: given.extend(texts) or real(self, texts))
    words = ["".join(chr(97 + (k // 26**i + 7 * i) % 26) for i in range(5)) + "\u00e9" * (k % 2) for k in range(1000)]
    text = "- " + " ".join(f"{w}{end}" for w in words for end in ("", ".", ",", "!\nThe", "\nThe", "'s"))
    ids, _ = Encoder().encode(pa.array([text]))
    assert ids.tolist() == plain(text)
    assert max(map(len, given)) < 3_000 and sum(map(len, given)) < 1.5 * sum(len(w) + 1 for w in words)


def test_piece_table():
    """For op4_token_files: known pieces are found by their bytes, whatever their length, without a pass over the cache."""
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice([*"ab\0", "\u00e9"], n)) for n in rng.integers(1, 14, 4000)] + ["x" * n for n in range(1, 40)] + ["a", "a\0", "\0a"]
    made = list(dict.fromkeys(made))
    table = PieceTable(len(made) // 2)  # fuller than an encoder lets it be
    array = pa.array(made, pa.large_string())
    for a, b in ((0, 1), (1, 50), (50, 1200)):
        table.add(array.slice(a, b - a))
    assert table.find(array).tolist() == [k if k < 1200 else -1 for k in range(len(made))]
    table.add(array.slice(1200))
    assert table.find(array.take(pa.array(range(len(made))[::-1]))).tolist() == list(range(len(made)))[::-1]
    assert table.find(array.slice(0, 0)).tolist() == []


def test_encoder_against_library(plain):
    """Random texts of characters that the pattern treats apart."""
    rng = np.random.default_rng(4)
    parts = [*"abZ09 \n\t\r\x0b\x0c.,'\"-_/", "\u00e9", "\u00f7", "\u00d7", "\u00df", "\u0301", "\xa0", "\u2003", "\x85", "\x1c", "\u200b", "\u65e5", "\u00b2", "\u00aa",
             "  ", "\n\n", "\r\n", "'s", "'ll", "don't", "<|endoftext|>", "\u0120", "\u010a", "Wort"]
    solid = [p for p in parts if p.strip()]
    coder = Encoder()
    for _ in range(30):
        texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(50)] + [None] + [" ".join(rng.choice(solid, 20)) for _ in range(50)]
        ids, bounds = coder.encode(pa.array(texts).slice(3))
        for k, t in enumerate(texts[3:]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(t), repr(t)


def test_other_vocabularies_get_whole_texts(tmp_path):
    """A vocabulary whose tokens run across blanks cannot be fed pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    vocabulary |= {"a\u0120": 256, "a\u0120b": 257}
    tok = Tokenizer(models.BPE(vocabulary, [("a", "\u0120"), ("a\u0120", "b")]))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.save(str(tmp_path / "other.json"))
    ids, bounds = Encoder(str(tmp_path / "other.json")).encode(pa.array(["a b", None, "ba b a"]))
    assert ids.tolist() == [257, *tok.encode("ba b a").ids] and bounds.tolist() == [0, 1, 1, len(ids)]


def test_short_texts_are_gathered(monkeypatch):
    """A call looks through the whole cache, so batches of short texts share one."""
    calls, real = [], Encoder.encode
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: calls.append(len(texts)) or real(self, texts))
    sizes = [10] * 30 + [0, 3_000_000, 10, 10] + [0] * 3
    batches = [pa.record_batch({"doc_id": [2 * k, 2 * k + 1], "text": ["a " * (n // 2) if n else None, "b"]}) for k, n in enumerate(sizes)]
    rows = [r for b in K._pieces(None, 2048, iter(batches)) for r in b.to_pylist()]
    assert calls == [62, 2, 10]
    assert [r["doc_id"] for r in rows if not r["piece"]] == list(range(2 * len(sizes)))
    assert list(K._pieces(None, 2048, iter([b.slice(0, 0) for b in batches]))) == []


def test_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 3000):
        keys = np.unique(rng.integers(0, 2**62, n)).astype(np.uint64)
        _, slot = T.build_index(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        T.build_index(np.array([3, 3], np.uint64))


ROWS = [(5, "five words are in here"), (1, None), (9, ""), (3, "x " * 5000), (2, "<|endoftext|>"), (None, "no key"), (7, "same"), (8, "same")]


def test_files(spark, docs_of, plain):
    uri = scratch_path(spark, "t")
    manifest = T.write_token_files(spark, docs_of(ROWS), uri)
    got = sorted(map(tuple, T.read_token_files(manifest, uri).collect()))
    at, want = 0, []
    for k, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        ids = np.array(plain(t) + [0], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    fs, folder = T._store(uri)
    shard = next(r["shard"] for r in manifest.collect() if r["first_key"] <= 5 <= r["last_key"])
    read = lambda kind: fs.open_input_file(f"{folder}/{shard:06d}.{kind}").readall()
    store = T.Shard(read("ids"), read("mph"))
    assert store.get(5).tolist() == plain(ROWS[0][1]) + [0] and store.get(4711) is None
    assert T.token_files(spark, docs_of(ROWS).limit(0)).count() == 0


def test_every_row_has_a_result(spark, docs_of, plain):
    """Repeated and missing ids: one row out for each row in."""
    rows = ROWS + [(5, "five again"), (5, "five again"), (5, None), (None, None), (None, "no key"), (-4, "below"), (-4, "zero")]
    got = T.token_files(spark, docs_of(rows)).collect()
    at, want = 0, []
    coded = [(k, np.array(plain(t) + [0], "<u2")) for k, t in rows]
    for k, ids in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, r[1].tobytes())):
        ids = ids.astype("<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    only = [(None, "a"), (None, "b c")]
    assert sorted(r["n_tokens"] for r in T.token_files(spark, docs_of(only)).collect()) == sorted(len(plain(t)) + 1 for _, t in only)
    uri = scratch_path(spark, "t")
    T.write_token_files(spark, docs_of([(5, "b"), (5, "a"), (None, "n")]).coalesce(1), uri).collect()
    fs, folder = T._store(uri)
    runs = {}
    for f in fs.get_file_info(T.pafs.FileSelector(folder)):
        if f.path.endswith(".mph"):
            read = lambda p: fs.open_input_file(p).readall()
            store = T.Shard(read(f.path.replace(".mph", ".ids")), read(f.path))
            runs |= {k: store.get(k).tolist() for k in (5, None) if store.get(k) is not None}
    assert runs == {5: plain("a") + [0] + plain("b") + [0], None: plain("n") + [0]}


def test_small_shards(spark, docs_of, plain, monkeypatch):
    """Many shards of few rows, read in small ranges; ids of one document need not fit in a range."""
    monkeypatch.setattr(T, "READ_BYTES", 64)
    rows = [(k, "word " * (k * 7 % 50)) for k in range(-20, 60)] + [(None, "none")] * 3 + [(30, "same")] * 20 + [(2**63 - 1, "last")]
    uri = scratch_path(spark, "t")
    manifest = T.write_token_files(spark, docs_of(rows), uri, shard_bytes=900)
    assert manifest.count() > 5
    got = sorted(map(tuple, T.read_token_files(manifest, uri, null_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((k for k, _ in rows if k is not None)) + [None] * 3
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    crc = Counter((k, zlib.crc32(np.array(plain(t) + [0], "<u4").tobytes())) for k, t in rows)
    assert Counter((r[0], r[3]) for r in got) == crc


def check_plan(histogram, plan, capacity=2048):
    total = Counter()
    for config, times in plan:
        assert sum(s * n for s, n in config.items()) <= capacity
        for s, n in config.items():
            total[s] += n * times
    assert {s: n for s, n in total.items() if n} == histogram


def test_plans():
    """The program places nearly all pieces by itself, near its own lower bound."""
    rng = np.random.default_rng(2)
    for sizes, gap, share in ((rng.integers(1, 2049, 3000), 1.02, 0.2), (rng.integers(600, 1025, 3000), 1.15, 0.3), (np.full(50, 700), 1.07, 1),
                              (np.clip(np.exp(rng.normal(6, 1, 4000)).astype(int), 1, 2048), 1.003, 0.5)):
        h = dict(Counter(sizes.tolist()))
        plan = K.plan(h)
        check_plan(h, plan.configurations)
        check_plan(h, K.best_fit(dict(h), [], 2048))
        assert plan.bound - 1e-6 <= plan.sequences <= gap * plan.bound + 1 and plan.placed >= share * len(sizes)
        assert plan.bound >= sizes.sum() / 2048 - 1e-6
    assert K.plan({}) == K.Plan([], 0.0, 0)
    h = {1024: 100, 512: 200, 256: 400}
    assert K.plan(h).sequences == 150 == round(K.plan(h).bound)
    assert K.cut(2049, 2048) == [1, 2048] and K.cut(2048, 2048) == [2048] and K.cut(5, 2048) == [5]


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                less = list(rooms)
                less.remove(room)
                put(i + 1, [*less, room - sizes[i]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_plans_against_all_packings():
    """At most one sequence more than the best of all packings, and the bound is never above it."""
    rng, more = np.random.default_rng(3), 0
    for _ in range(40):
        sizes = rng.integers(1, 21, int(rng.integers(1, 10))).tolist()
        plan, best = K.plan(dict(Counter(sizes)), 20), fewest(sizes, 20)
        check_plan(dict(Counter(sizes)), plan.configurations, 20)
        assert plan.bound - 1e-6 <= best <= plan.sequences <= best + 1
        more += plan.sequences - best
    assert more <= 4


def test_pack(spark, docs_of, plain):
    rows = [(i, "w " * (i * 37 % 900)) for i in range(60)] + [(100, "long text " * 4000), (101, None), (101, None), (None, "n")]
    got = K.pack(spark, docs_of(rows)).toPandas()
    ids = Counter()
    for k, t in rows:
        ids[k] += len(plain(t)) + 1
    lengths = got.groupby(got.doc_id.fillna(-1))["length"].sum()
    assert all(lengths[-1 if k is None else k] == n for k, n in ids.items())
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length).tolist()[:-1]] and s.length.sum() <= 2048
    long = got[got.doc_id == 100].sort_values("piece")
    body = np.array(plain("long text " * 4000) + [0], "<u4")
    assert long.start.tolist() == [0, *np.cumsum(long.length).tolist()[:-1]] and (long.length[1:] == 2048).all()
    assert all(zlib.crc32(body[s : s + n].tobytes()) == c for s, n, c in zip(long.start, long.length, long.ids_crc32))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert K.pack(spark, docs_of(rows).limit(0)).count() == 0
