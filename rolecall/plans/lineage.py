"""Cutting lineage where a result is read many times or a loop would grow it."""

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written since each open `scratch` began.
_scratch: list[list[str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a session on one machine may go without.

    On a cluster executors share no local folder, so a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or f"/tmp/checkpoints/{os.getuid()}")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; it goes with the innermost open `scratch`."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end: what leaves it must be read by then, or `kept`."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """`df` written outside the innermost open `scratch`."""
    inner = _scratch.pop()
    try:
        return cut(df)
    finally:
        _scratch.append(inner)


def cut(df: DataFrame) -> DataFrame:
    """Write the result once as Parquet in the shared folder and read it from then on.

    Unlike a checkpoint it keeps column pruning, pushed filters and statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Growing:
    """A table that grows by whole parts: nothing written is ever rewritten."""

    def __init__(self, spark: SparkSession, ddl: str):
        from ..schemas import empty_table
        self.spark, self.none = spark, empty_table(spark, ddl)
        self.schema = self.none.schema
        self.path, self.parts = new_path(spark, "growing"), 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write `df` as one more part, and read that part."""
        part = f"{self.path}/part-{self.parts:06d}"
        df.select(self.schema.names).write.parquet(part)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def all(self) -> DataFrame:
        """What was appended so far; later parts are not in it."""
        if not self.parts:
            return self.none
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part-*")
