"""Keep an intermediate table that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; where that is unset, a cached table on a local master only.

    Cuts the plan as well: what follows is planned and run once on the result.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = df.sparkSession.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        return df.persist()
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()
