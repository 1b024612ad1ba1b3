"""Stage tables in the shared folder, connected components, and small column helpers."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the stage tables written since each open `finished` began.
_written: list[list[str]] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"/tmp/checkpoints/{os.getuid()}"


@contextmanager
def _shuffle_files_end_with_the_job(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: lineage ends there, and so do the shuffle
    files of the job. A lost executor later costs a reread, not the stage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    with _shuffle_files_end_with_the_job(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(work, name: str) -> DataFrame:
    """The stage table of what `work()` returns; all other stage tables it wrote are deleted when that one stands."""
    _written.append([])
    try:
        df = work()
    finally:
        others = _written.pop()
    out = stage(df, name)
    for path in others:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return out


def text_batches(spark: SparkSession, limit: str = "4m") -> None:
    """From now on Arrow batches of the session end at `limit` bytes, so that long texts do not travel by thousands.

    A text longer than that is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, also where `body` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long); a component is named by its smallest node.

    Each round gives every node the smallest label around it, then the label of that label, so chains halve.
    Sums and minima are combined before each shuffle, and a node with very many links is only ever a join key,
    which adaptive execution splits. Null ends are no links.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b")
    both = stage(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), f"{name}-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                   .select("node", F.least("node", "least").alias("label")), f"{name}-labels")
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around")))
        nearer = (labels.join(around, "node").select("node", "label", F.least("label", "around").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = stage(nearer.join(jump, "next", "left")
                      .select("node", F.col("label").alias("before"),
                              F.least("next", F.coalesce("beyond", "next")).alias("label")), f"{name}-labels")
        labels = moved.select("node", "label")
        if moved.filter("before <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def small(staged: DataFrame, rows: int) -> DataFrame:
    """A staged table, marked for broadcast if it has at most `rows` rows; beyond that Spark joins by shuffling."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged
