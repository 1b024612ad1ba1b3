"""Folding newly crawled rosters into the reverse index, and runs into the log.

Both are merged tables: a batch reads nothing of them, and a batch repeated after a failure
changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_index, fold_log
from ..schemas import empty_table
from .merged import MergedTable

INDEX_DDL = "login STRING, repo STRING, batch BIGINT"
LOG_DDL = ("forge STRING, kind STRING, target STRING, repos BIGINT, contributors BIGINT, "
           "created TIMESTAMP, updated TIMESTAMP")


def index_table(spark: SparkSession, path: str, **options) -> MergedTable:
    """(login, repo, batch): a project of a login is as old as the first batch that has it."""
    first = lambda rows: rows.groupBy("login", "repo").agg(F.min("batch").alias("batch"))
    return MergedTable(spark, path, INDEX_DDL, ("login", "repo"), first, **options)


def log_table(spark: SparkSession, path: str, **options) -> MergedTable:
    """The refresh log: its measures are minima and maxima, so coverage never shrinks."""
    return MergedTable(spark, path, LOG_DDL, ("forge", "kind", "target"),
                       lambda rows: fold_log(empty_table(spark, LOG_DDL), rows), **options)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index: (login, repo, batch), a login's projects ordered by batch, then name."""
    return index_table(spark, path).read()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, one row a target."""
    return log_table(spark, path).read()


def fold_rosters(rosters: DataFrame, path: str, checkpoint: str,
                 min_commits: int = 15) -> StreamingQuery:
    """Stream of roster rows -> index under `path`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = build_index(batch, min_commits).withColumn("batch", F.lit(batch_id).cast("bigint"))
        index_table(batch.sparkSession, path).add(rows, batch_id)

    return (rosters.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def fold_runs(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream of refresh runs -> log under `path`."""
    columns = [c.split()[0] for c in LOG_DDL.split(", ")]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(columns).withColumns({c: F.lower(c) for c in ("forge", "kind", "target")})
        log_table(batch.sparkSession, path).add(rows, batch_id)

    return (runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
