"""From raw documents to packed sequences, in five stages.

language ID -> exact deduplication -> near-copy removal -> mixing of sources -> packing.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from pagewarden.llm import common
from pagewarden.llm.exact_dedup import drop_copies
from pagewarden.llm.jaccard import drop_near_copies
from pagewarden.llm.language import keep_identified
from pagewarden.llm.mixing import mix_documents
from pagewarden.llm.packing import pack

#: Scratch folders of the stages that ran, by thread and input, so that pipelines side by side keep theirs.
_previous: dict[tuple[int, str, str], str] = {}


def _stage(name: str, before: str | None, work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = threading.get_ident(), sf_dir
        # The stage before has been written and read again: its scratch tables have served.
        if folder := _previous.pop((*mine, before or ""), None):
            common.sweep(spark, folder)
        with common.scratch_folder() as folder:
            _previous[(*mine, name)] = folder
            return work(spark, docs)

    stage.__name__ = name
    return stage


STAGES = [
    ("language", _stage("language", None, keep_identified)),
    ("exact_dedup", _stage("exact_dedup", "language", drop_copies)),
    ("near_dedup", _stage("near_dedup", "exact_dedup", drop_near_copies)),
    ("mixing", _stage("mixing", "near_dedup", mix_documents)),
    ("packing", _stage("packing", "mixing", pack)),
]

#: Language inference and MinHash are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.persist(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
