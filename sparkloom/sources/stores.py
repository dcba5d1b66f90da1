"""Sinks: versioned stores with a pointer, partition overwrites, feeds. Paths lie in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. A local folder stands in only where none is set and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loom-store-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back; `drop` deletes them. Shuffle files behind them are let go, as nothing needs them any more."""
    path, conf = new_path(rows.sparkSession, name), rows.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._loom_path = path
    return out


def drop(rows: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    where = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(rows._loom_path)
    where.getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def overwrite_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that `rows` holds; a second call with the same rows changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


class Versions:
    """Whole versions beside each other, and pointers written last: readers see a complete version or none.

    Every version has a folder and a pointer of its own. Two writers who take the same number at once both keep their rows, and readers agree on
    the one whose name sorts last.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _last(self) -> tuple[int, str] | None:
        try:
            log = self.spark.read.schema("version int, name string").parquet(f"{self.path}/pointers/*")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        newest = log.agg(F.max(F.struct("version", "name"))).first()[0]
        return None if newest is None else (newest["version"], newest["name"])

    def put(self, rows: DataFrame) -> int:
        last = self._last()
        version, name = (last[0] + 1 if last else 1), uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        pointer = self.spark.createDataFrame([(version, name)], "version int, name string")
        pointer.coalesce(1).write.parquet(f"{self.path}/pointers/{name}")
        return version

    def get(self) -> DataFrame | None:
        last = self._last()
        return None if last is None else self.spark.read.parquet(f"{self.path}/{last[1]}")
