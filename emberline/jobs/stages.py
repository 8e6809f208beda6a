"""Stages of a workload: tables that are written once under a name that says what they were made from, and read by all that comes after.

A stage's name ends in the digest of its own parameters and of the digests of the stages before it. So a table is found again by whoever asks for
the same thing, in this run or a later one, and a changed parameter gives new names to its stage and to all stages that depend on it, and
to no other. A table counts as made by the mark of success of the note that is
written after it; one left half-written by a lost driver is made anew.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Stage:
    """A written table. Its digest is what later stages are named after."""

    name: str
    digest: str
    path: str
    table: DataFrame = field(compare=False, repr=False)


class Stages:
    """The stages under one folder, which driver and executors share. ``source`` names the inputs (an archive, a catalog and its date): another source, other tables.

    made lists the stages that this object had to write, in order; used those that it wrote or found."""

    def __init__(self, spark: SparkSession, folder: str, **source):
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source
        self.made: list[str] = []
        self.used: dict[str, Stage] = {}

    @classmethod
    def of_session(cls, spark: SparkSession) -> Stages:
        """Stages of this run alone, in the folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if shared is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or name a folder for the stages")
            shared = tempfile.mkdtemp(prefix="spark-stages-")
        return cls(spark, f"{shared.rstrip('/')}/stages-{uuid.uuid4().hex}")

    def stage(self, name: str, make: Callable[[], DataFrame], after: tuple[Stage, ...] = (), partition_by: tuple[str, ...] = (), **parameters) -> Stage:
        """The table of ``make``, written by the columns partition_by unless it is there. parameters: all that the table depends on besides the stages before."""
        what = {"name": name, "source": self.source, "parameters": parameters, "after": [s.digest for s in after]}
        digest = hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:24]
        path = f"{self.folder}/{name}-{digest}"
        if not self._there(f"{path}/_stage/_SUCCESS"):
            table = make()
            # What the name stands for and the columns' types lie beside the data, where readers of the data don't look.
            note = json.dumps(what | {"schema": table.schema.jsonValue()}, sort_keys=True, default=str)
            writer = table.write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
            self.spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}/_stage")
            self.made.append(name)
        # Types of columns in folder names would be guessed otherwise: a member 001 is no number.
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{path}/_stage").first()[0])["schema"])
        out = self.used[name] = Stage(name, digest, path, self.spark.read.schema(schema).parquet(path))
        return out

    def sweep(self) -> list[str]:
        """Delete tables of the stages used here that were made from other parameters, and return their names: after a change that makes them worthless."""
        fs, root = self._fs(self.folder)
        keep, gone = {s.path.rsplit("/", 1)[-1] for s in self.used.values()}, []
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name not in keep and name.rpartition("-")[0] in self.used:
                fs.delete(entry.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)
