"""What the corpus operators share: scratch tables in the shared folder and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in the corpus contracts: blank, tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
FOLDER = "pagewarden-scratch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary one serves a local master (tests); a cluster,
    whose executors would not see it, is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        folder = f"file://{tempfile.mkdtemp(prefix='pagewarden-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_inside: ContextVar[str] = ContextVar("scratch folder", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    inside = _inside.get()
    return "/".join([shared_folder(spark), FOLDER, *([inside] if inside else []), f"{name}-{uuid.uuid4().hex[:12]}"])


@contextmanager
def scratch_folder() -> Iterator[str]:
    """Scratch tables made inside go to one folder, whose name is given, so that they can be swept together."""
    name = f"job-{uuid.uuid4().hex[:12]}"
    before = _inside.set(name)
    try:
        yield name
    finally:
        _inside.reset(before)


def persist(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors.

    The shuffle files of the run go when it ends.
    """
    path = scratch_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the time of an action."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows, for whole texts: a batch is held twice on its way to Python."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def sweep(spark: SparkSession, folder: str = "") -> None:
    """Delete scratch tables, all or those of a folder.  Call it only when no unread result depends on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join([shared_folder(spark), FOLDER, *([folder] if folder else [])]))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that :func:`persist` wrote, once nothing unread depends on it."""
    files = table.inputFiles()
    if files and f"/{FOLDER}/" in files[0]:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The number of maximal runs of characters outside ``BLANKS``."""
    flat = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.regexp_count(flat, F.lit(r"[^ ]+")).cast("long")


def crc_bucket(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def inputs(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int, *more: str) -> DataFrame:
    """Fewer than ``rows`` rows with the smallest hashes of ``key`` and ``more``: the same rows in each run, at any partitioning.

    A table of fewer rows is taken whole.  Two numbers come to the driver, and only
    hashes are sorted.  Rows that tie on the last hash stay out, so rows that
    repeat do not pass the bound; where all tie, one stands for them.
    """
    h = F.xxhash64(F.col(key), *[F.col(c) for c in more])
    n, least, top = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.count(F.lit(1)), F.min("h"), F.max("h")).first()
    if n < rows:
        return df
    return df.where(h < F.lit(top)) if least < top else df.where(h == F.lit(top)).limit(1)


def unused(columns: list[str], *names: str) -> tuple[str, ...]:
    """Names for helper columns that ``columns`` does not have, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return tuple(out)
