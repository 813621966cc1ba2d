"""Counts of texts by signature list: the same as SQL where engines differ, and linear in the text."""

import time

import duckdb
from pyspark.sql import functions as F

from pagewarden.functions import text as X
from pagewarden.plans import catalog

ODD = ["sikiş", "a sikis b", "écasino", "casinoé", "judié x", "éjudi", "_judi_", "judi1", "poker٣", "ſlot gacor", "Kasino", "KASİNO", "NỔ HŨ", "КАЗИНО",
       "BAHİS GİRİŞ", "ПОКЕР", "पजुआ", "owned by a\nb team", "owned by " + "é" * 20 + "team", "owned by " + "é" * 21 + "team", "owned by \U0001f3b0 team", "mr.é team",
       "\U0001f3b0judi\U0001f3b0", "judi\x00", "jso.abc.id", "plain", "", None]


def counts(spark, path):
    return {r["list"]: r["docs"] for r in catalog.QUERIES["signature_documents"](spark, str(path)).collect()}


def test_counts_equal_sql(spark, tmp_path):
    for name, texts in {"odd": ODD, "turkish": ["sikiş"], "accents": ["écasino", "judié x", "mr.é team"], "folds": ["ſlot gacor", "KASİNO"]}.items():
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        rows.repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path / name}/documents.parquet/*.parquet')")
        want = dict(con.sql(catalog.ORACLES["signature_documents"]).fetchall())
        assert counts(spark, tmp_path / name) == want, texts
        assert name != "odd" or min(want.values()) > 0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert set(counts(spark, tmp_path / "none").values()) == {0}  # DuckDB's count_if of no rows is null


def test_time_is_that_of_a_few_scans(spark, tmp_path):
    """Not that of some hundred alternatives tried at every place (before: 18.3 s beside a scan of 0.5 s)."""
    words = "the quick vaccine portal slowly became known before judges opened private garden slopes "
    spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(words), 200).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))

    def took(run):
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = min(took(lambda: whole.agg(F.count_if(F.col("text").rlike(X.FLAGS + "[k-q]asino"))).collect()) for _ in range(3))
    found = min(took(lambda: counts(spark, tmp_path)) for _ in range(3))
    print(f"scan {plain:.2f} s, five lists {found:.2f} s")
    assert found < 8 * plain + 1
