import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pagewarden.llm import exact_dedup as X
from pagewarden.llm.components import components
from pagewarden.llm.jaccard import bands_for, drop_near_copies, jaccard_join, shingles
from pagewarden.llm.suffix import mark_windows, permuted_prefixes, remove_repeats, segments, suffix_array

LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))


def test_exact_dedup(spark, docs_of):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, "c"), (7, LONG), (8, LONG), (None, "c"), (6, "c"), (9, "a b")]
    got = X.exact_dedup(spark, docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["keep_id"] == by[2][0]["keep_id"] == 3 and by[3][0]["kept"] and by[3][0]["group_size"] == 3  # most code points
    assert by[5][0]["keep_id"] == 4 and by[4][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[6][0]["group_size"] == 3 and sum(r["kept"] for r in by[6]) == 1 and not by[None][0]["kept"]
    assert by[8][0]["keep_id"] == 7 and by[9][0]["group_size"] == 1
    assert X.exact_dedup(spark, docs_of([(1, "x")]).limit(0)).count() == 0
    left = X.drop_copies(spark, docs_of(rows))
    assert left.columns == docs_of(rows).columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6, 7, 9]


def test_kept_rows_of_one_id(spark, docs_of):
    """Where id and digest repeat, the longest text stays; helper columns give way to columns of the same names."""
    rows = [(1, "a b"), (1, "a  b "), (1, "ab"), (None, "c"), (None, "c "), (2, "ab"), (2, "z")]
    left = X.drop_copies(spark, docs_of(rows).withColumnsRenamed({"size": "__digest", "row": "__ID", "kept": "__best"}))
    assert left.columns[5:] == ["__digest", "__ID", "taken", "__best"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "c "), (1, "a  b "), (2, "z")]


def test_state_over_many_batches(spark, docs_of):
    rows = [(i, f"t{i % 5}") for i in range(60)]
    got = X.exact_dedup(spark, docs_of(rows, 6), files_per_batch=1).collect()
    assert all(r["keep_id"] == r["doc_id"] % 5 and r["group_size"] == 12 for r in got)


def test_collision_is_split_by_bytes(spark, docs_of, monkeypatch):
    """With a digest that collides, the byte check forms the groups anew."""
    from pyspark.sql import functions as F

    real = F.sha2
    monkeypatch.setattr(X.F, "sha2", lambda c, n: real(F.substring(c.cast("string"), 1, 1), n))
    got = {r["doc_id"]: r for r in X.exact_dedup(spark, docs_of([(1, "ab"), (2, "ac"), (3, "a b"), (4, "z")])).collect()}
    assert got[1]["keep_id"] == 3 and got[2]["keep_id"] == 2 and got[1]["group_size"] == 2 and got[4]["group_size"] == 1


def brute_jaccard(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root, links = {k: k for k in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in sets}


def near(seed, n, change):
    rng = np.random.default_rng(seed)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, n)]
    out = []
    for _ in range(12):
        w = list(base)
        for i in rng.integers(0, n, change):
            w[int(i)] = f"v{int(rng.integers(0, 10**6))}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, docs_of):
    texts = near(1, 200, 2) + near(2, 60, 1) + ["one two", "one  two", "", None, " ", LONG, LONG, "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    want = brute_jaccard(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(spark, docs_of(rows)).collect()}
    assert got == want
    left = drop_near_copies(spark, docs_of(rows + [(0, texts[0])]))
    assert left.columns == docs_of(rows).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for c, _ in want.values()})
    assert jaccard_join(spark, docs_of(rows).limit(0)).count() == 0


def test_jaccard_in_blocks(spark, docs_of, monkeypatch):
    """A large component is verified in pairs of blocks, with the same links."""
    from pagewarden.llm import jaccard as J

    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    rows = list(enumerate(near(3, 150, 1) + near(4, 150, 1)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(spark, docs_of(rows)).collect()}
    assert got == brute_jaccard(rows)


def test_bands_and_shingles():
    bands, rows = bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 160
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a")) == 1 and len(shingles(" ")) == 0
    assert (shingles("a  b\nc d e") == shingles("a b c d e")).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


@pytest.mark.parametrize("narrow", [0, 1000])
def test_suffix_array_and_prefixes(monkeypatch, narrow):
    from pagewarden.llm import suffix as S

    monkeypatch.setattr(S, "NARROW", narrow)  # both ways to induce
    rng = np.random.default_rng(5)
    for _ in range(150):
        t = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(0, 60)).astype(np.uint16)
        a = suffix_array(t, 8)
        assert a.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        p = permuted_prefixes(t, a, 7)
        for r in range(1, len(t)):
            i, j, n = a[r], a[r - 1], 0
            while n < 7 and i + n < len(t) and j + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert p[i] == n
    t = np.frombuffer(b"abcabcabd" * 300 + b"x" * 500, np.uint8)
    assert suffix_array(t, 257).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def test_segments_hold_each_window_once():
    """Equal windows have equal anchors; segments of a block never leave a document."""
    rng = np.random.default_rng(6)
    b = np.concatenate([rng.integers(97, 100, 300), np.full(120, 97), rng.integers(97, 100, 300), np.zeros(30), rng.integers(97, 100, 60)]).astype(np.uint8)
    sizes = np.array([0, 400, 0, 49, 271, 0, 90])
    ends = np.cumsum(sizes)
    anchor, digest, first, windows = segments(b, sizes)
    seen, at = {}, []
    for h, a, k in zip(anchor.tolist(), first.tolist(), windows.tolist()):
        assert 1 <= k <= 31 and a + k + 49 <= ends[np.searchsorted(ends, a, "right")]
        for i in range(a, a + k):
            assert seen.setdefault(b[i : i + 50].tobytes(), h) == h
        at += range(a, a + k)
    assert at == [i for e, n in zip(ends.tolist(), sizes.tolist()) for i in range(e - n, e - 49)]
    texts = [b[a : a + k + 49].tobytes() for a, k in zip(first.tolist(), windows.tolist())]
    assert len(set(texts)) == len(set(digest.tolist())) == len(set(zip(texts, digest.tolist())))


def brute_repeats(rows):
    """(id, bytes, removed, spans, digest) of each row; null ids come after all."""
    first, out = {}, []
    data = [(2**63 if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, k), k)
    for (k, b), (own, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((own, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize(("group", "block"), [(12_000, 1 << 20), (2, 300)])
def test_remove_repeats(spark, docs_of, monkeypatch, group, block):
    """Against brute force; with small limits, groups are cut down to single windows and blocks hold few documents."""
    from pagewarden.llm import suffix as S

    monkeypatch.setattr(S, "GROUP_PIECES", group)
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rng = np.random.default_rng(7)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    shared, other = word(120), word(70) + "é" * 30
    rows = [(0, word(80) + shared), (1, shared), (2, shared[10:80] + word(30) + shared[:60]), (3, None), (4, ""), (5, "x" * 400), (6, "x" * 200 + word(9)),
            (7, other), (8, word(5) + other + shared), (9, shared[:49]), (10, shared[:50]), (12, other[:60] + shared[60:] + other[:60])]
    rows += [(20 + i, word(20) + shared + word(20)) for i in range(6)] + [(40, "z" * 120)]
    # Ids that repeat, with the same, other and shorter texts; rows without id.
    rows += [(5, word(300)), (5, shared), (5, shared), (5, word(3)), (None, shared + word(60)), (None, other), (None, None), (-3, shared[20:90])]
    assert removed(remove_repeats(spark, docs_of(rows))) == brute_repeats(rows)
    assert remove_repeats(spark, docs_of(rows).limit(0)).count() == 0


def test_remove_repeats_of_long_texts(spark, docs_of):
    rows = [(1, LONG), (2, LONG[1000:] + "tail"), (3, LONG[:90_000])]
    assert removed(remove_repeats(spark, docs_of(rows))) == brute_repeats(rows)


@pytest.mark.parametrize("seed", range(3))
def test_judge_in_small_batches(seed):
    """What is given out does not depend on where batches end."""
    import pyarrow as pa
    from pagewarden.llm import suffix as S

    rng = np.random.default_rng(seed)
    n = 300
    rows = sorted(zip(rng.integers(0, 40, n).tolist(), rng.integers(0, 4, n).tolist(), rng.integers(0, 9, n).tolist(), (rng.random(n) < 0.2).tolist()))
    table = pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(("anchor", "digest", "least"))})
    places = [j << 6 | 31 << 1 | int(r[3]) for j, r in enumerate(rows)]
    for c, x in (("block", pa.array([1] * n)), ("place", pa.array(places)), ("more", pa.nulls(n, pa.binary()))):
        table = table.append_column(c, x)
    marked, compared = set(), set()
    first = {}
    for a, d, i, _ in rows:
        first[a, d] = min(first.get((a, d), i), i)
    for j, (a, d, i, several) in enumerate(rows):
        if several or i > first[a, d]:
            marked.add((j, first[a, d]))
        ids = {x[2] for x in rows if x[0] == a}
        more = any(x[3] for x in rows if x[0] == a) or len(ids) > 1
        if i == first[a, d] and more and len({x[1] for x in rows if x[0] == a}) > 1:
            compared.add(j)
    for size in (1, 2, 7, 1000):
        got = [r for b in S._judge(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["at"], r["least"]) for r in got if r["marked"]} == marked and sum(r["marked"] for r in got) == len(marked)
        assert all(r["windows"] == 31 for r in got) and compared <= {r["at"] for r in got if r["open"]}  # more may be compared, to no effect


def test_mark_windows():
    a, b = b"q" * 10 + bytes(range(60, 120)), bytes(range(60, 120)) + b"r"
    one, two = mark_windows([a, b], np.array([5, 3]))
    assert one.tolist() == [5] * 10 + [3] * 11 and two.tolist() == [3] * 12


def test_jaccard_with_an_empty_block(spark, docs_of, monkeypatch):
    """Two near copies a component, in two blocks: about half the pairs leave a block empty."""
    from pagewarden.llm import jaccard as J

    monkeypatch.setattr(J, "BLOCK_ITEMS", 300)
    rows = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + ["other"]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(spark, docs_of(rows)).collect()}
    assert got == {i: (i // 2 * 2, 1) for i in range(24)}
