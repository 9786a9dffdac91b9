"""Cutting lineage, so that later steps neither plan nor compute earlier ones again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint, in the folder of ``spark.checkpoint.dir``; a local one where that is unset."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="prosemill-"))
    return df.checkpoint(eager=True)
