"""Cutting lineage between the rounds of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir (or the session) names; as it is where none is named, which is right but does earlier rounds again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
