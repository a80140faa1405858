"""Tables written to the folder all executors share, to cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder of this machine only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='contactgrid-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written by materialize, by application, until clear removes them.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> int:
    """Removes the tables that plans of this application were cut by; how many.  For when their results are
    written: frames made before can't be read afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


class Rolling:
    """Tables of an iteration: of each name only the last one written stays."""

    def __init__(self):
        self.paths: dict[str, str] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            _delete(spark, old)
        return spark.read.schema(df.schema).parquet(path)
