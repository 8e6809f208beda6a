"""Small pieces shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def without_spaces(text: Column) -> Column:
    return F.translate(whole(text), _SPACES, "")


def shuffled(df: DataFrame) -> DataFrame:
    """The table for a join that sends neither side whole to the driver and all executors. Spark sizes what an explode makes by what goes in, an array as one entry, so it may take many rows for few."""
    return df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. A cluster names it in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while plans are made and run."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def batches_of(batch: int | None) -> dict[str, str]:
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {}


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Eager checkpoint in the shared folder: later steps reread it and survive the loss of executors. batch: rows that Python functions of the plan get at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with settings(spark, batches_of(batch)):
        # A plan keeps the settings under which it is made.
        return (df.select("*") if batch else df).checkpoint(eager=True)


def store(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write a table in the shared folder, reread it, and let the shuffle files of its making go. For tables too large for a checkpoint's plain rows. batch: as for ``cut``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **batches_of(batch)}):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
