import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from pagewarden.llm import common
from pagewarden.llm import queries as corpus
from pagewarden.llm.language import trigrams
from pagewarden.llm.tokens import vocabulary_path

from test_dedup import brute_jaccard  # noqa: E402  (same folder)
from test_models import brute_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.persist(spark, stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages(spark, stages):
    docs, lang, exact, near, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert len(ids(lang)) >= 0.99 * docs.count()
    norm = {r["doc_id"]: "".join(r["text"].split()) for r in lang.collect()}
    assert len(ids(exact)) == len(set(norm.values()))
    classes = brute_jaccard([(r["doc_id"], r["text"]) for r in exact.orderBy("doc_id").collect()])
    assert ids(near) == sorted({c for c, _ in classes.values()})
    assert set(ids(mixed)) <= set(ids(near)) and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert set(ids(packed)) == set(ids(mixed))


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(key).collect()))
    assert rows(got) == rows(stages[-1])
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def brute_language(docs):
    """Ids that language ID keeps: trigram counts by hand, all languages' proportions by plain expectation-maximisation."""
    counts, letters = {}, re.compile(r"[^\W\d_]")

    def cells(text):
        return trigrams(text)

    for r in docs:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            c, n = cells(r["text"])
            total = counts.setdefault(r["lang"], np.zeros(1 << 16))
            for cell, k in zip(c.tolist(), n.tolist()):
                total[cell] += k
    langs = sorted(counts)
    chance = np.array([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in langs])
    keep = []
    for r in docs:
        if not letters.search(r["text"] or ""):
            continue
        c, n = cells(r["text"])
        share = [1 / len(langs)] * len(langs)
        for _ in range(15):
            new = [0.0] * len(langs)
            for cell, k in zip(c.tolist(), n.tolist()):
                part = [s * chance[j, cell] for j, s in enumerate(share)]
                total = sum(part)
                for j, x in enumerate(part):
                    new[j] += k * x / total
            share = [x / n.sum() for x in new]
        keep.append((r["doc_id"], max(share)))
    return keep


def brute_mixing(rows, targets):
    """(id, turns) as the queue takes them: all queued documents sorted by finish time at once."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sums, order = Counter(), sorted(rows, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
    for r in rows:
        sums[r["source"]] += size[r["doc_id"]]
    target = targets(dict(sums))
    names = sorted(s for s in sums if s is not None) + ([None] if None in sums else [])
    queue, at = [], Counter()
    for r in order:
        at[r["source"]] += size[r["doc_id"]]
        for turn in (0, 1):
            if target[r["source"]] > 0:
                queue.append(((at[r["source"]] + turn * sums[r["source"]]) / target[r["source"]], names.index(r["source"]), turn, r["doc_id"]))
    left, turns = math.floor(sum(target.values())), Counter()
    for _, _, _, doc in sorted(queue, key=lambda q: (*q[:3], hashlib.md5(str(q[3]).encode()).hexdigest(), q[3])):
        if left > 0 and size[doc]:
            turns[doc] += 1
            left -= size[doc]
    return turns


def test_run_against_brute_force(spark, stages):
    """Each stage worked out independently on the stage before; the last against run()."""
    docs, lang, exact, near, mixed, _ = [s.collect() for s in stages]
    shares = brute_language(docs)
    sure = {d for d, s in shares if s >= 0.51}
    assert sure <= {r["doc_id"] for r in lang} <= {d for d, s in shares if s >= 0.49}
    groups = {}
    for r in lang:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in exact) == sorted(min(g)[1] for g in groups.values())
    classes = brute_jaccard([(r["doc_id"], r["text"]) for r in sorted(exact, key=lambda r: r["doc_id"])])
    assert sorted(r["doc_id"] for r in near) == sorted({c for c, _ in classes.values()})
    assert Counter(r["doc_id"] for r in mixed) == brute_mixing(near, brute_targets)
    tok = Tokenizer.from_file(vocabulary_path())
    tok.encode_special_tokens = True
    want = Counter()
    for r in mixed:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048
        cuts = [0, *range(first or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()[:-1]] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


@pytest.mark.parametrize("name", list(corpus.ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = corpus.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(plain, r)) for r in df.select(names).collect())
    want = con.sql(f"SELECT {', '.join(names)} FROM ({corpus.ORACLES[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
