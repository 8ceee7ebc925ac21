"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else, where driver and executors are one process, a folder of our own. A cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _own[0]


#: Files of a query's exchanges go as soon as the query has ended.
_CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, by: str | None = None, clear: bool = False) -> DataFrame:
    """df as Parquet in the shared folder, read back: the plan ends here, and a lost executor costs nothing. With by, a
    folder for each value of that column; with clear, the files of the exchanges before are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEARED, None)
    if clear:
        spark.conf.set(_CLEARED, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        if clear and before is not None:
            spark.conf.set(_CLEARED, before)
        elif clear:
            spark.conf.unset(_CLEARED)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def opened(path: str, columns: list[str]) -> pa.Table:
    """A written table, or one folder of it, as a task reads it by itself. pyarrow must know the shared folder's kind."""
    files, where = fs.FileSystem.from_uri(path)
    return dataset.dataset(where, filesystem=files, format="parquet").to_table(columns=columns)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._quarry_path)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
