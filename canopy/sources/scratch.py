"""Tables that a program writes in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a local session gets a temporary folder; a cluster is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/canopy-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    It cuts lineage and fixes what a task made, so that a lost executor can't make a later read differ.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        _delete(df.sparkSession, (f for f in folders if f.rsplit("/", 1)[1].startswith("canopy-")))


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that was written this way in this application.

    Results are lazy and read their scratch tables: call it when they have been written or collected.
    """
    _delete(spark, _folders.pop(spark.sparkContext.applicationId, []))
