"""Usage counters over a stream of scans."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import SKETCH_BITS, usage_sketches, user_key
from .merged import MergedTable


def _folded(rows: DataFrame, table: MergedTable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(batch, batch_id)

    return (rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- without state: late rows count, increments are merged on read ------------
def latest_table(spark: SparkSession, path: str) -> MergedTable:
    """(user_key, ts): the newest scan of each user."""
    return MergedTable(spark, path, "user_key STRING, ts TIMESTAMP", ("user_key",),
                       lambda rows: rows.groupBy("user_key").agg(F.max("ts").alias("ts")))


def fold_latest(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream of scans -> the newest scan of each user under `path`.

    Late scans only lose against newer ones, so order and repetition change nothing.
    """
    return _folded(scans.select(user_key().alias("user_key"), "ts"), latest_table(scans.sparkSession, path), checkpoint)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_table(spark, path).read()


def counts_table(spark: SparkSession, path: str) -> MergedTable:
    """(start, scans, users): scans and a mergeable sketch of users of each window."""
    fold = lambda rows: rows.groupBy("start").agg(F.sum("scans").alias("scans"), F.hll_union_agg("users").alias("users"))
    return MergedTable(spark, path, "start TIMESTAMP, scans BIGINT, users BINARY", ("start",), fold, buckets=2)


def fold_counts(scans: DataFrame, width: str, path: str, checkpoint: str) -> StreamingQuery:
    """Stream of scans -> the windows ('1 day' or '1 hour') they fall into, under `path`.

    What a batch adds to a window is a count and a sketch; late scans still count.
    """
    table = counts_table(scans.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(batch.groupBy(F.window("ts", width).alias("w"))
                  .agg(F.count(F.lit(1)).alias("scans"), F.hll_sketch_agg(user_key(), SKETCH_BITS).alias("users"))
                  .select(F.col("w.start").alias("start"), "scans", "users"), batch_id)

    return (scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_counts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(start, scans, users) of each window; with `since`, of those that begin no earlier.

    The retention of the counters is the caller's: 120 days of days, 3 hours of hours.
    """
    found = counts_table(spark, path).read()
    if since is not None:
        found = found.where(F.col("start") >= F.lit(since).cast("timestamp"))
    return found.select("start", "scans", F.hll_sketch_estimate("users").alias("users"))


def sketch_table(spark: SparkSession, path: str) -> MergedTable:
    """(day, people, repos, orgs): mergeable sketches of each day."""
    union = lambda rows: rows.groupBy("day").agg(*[F.hll_union_agg(c).alias(c) for c in ("people", "repos", "orgs")])
    return MergedTable(spark, path, "day DATE, people BINARY, repos BINARY, orgs BINARY", ("day",), union, buckets=2)


def fold_sketches(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream of scans -> sketches of each day under `path`; all-time counts are their union."""
    table = sketch_table(scans.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(usage_sketches(batch), batch_id)

    return (scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- with state that expires: late rows are dropped ----------------------------
def windowed_scans(scans: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Scans and approximate distinct users per tumbling window ('1 day' or '1 hour').

    Rows later than the watermark are dropped, and closed windows leave the state.
    """
    return (scans.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("scans"),
                 F.approx_count_distinct(user_key(), 0.008).alias("users"))
            .select(F.col("w.start").alias("start"), "scans", "users"))


def recent_users(scans: DataFrame, live: str, late: str = "1 hour") -> DataFrame:
    """(user_key, since, ts): the newest scan of each user in each period of `live`.

    The state holds the users of the periods that the watermark has not passed: a user who
    has not been seen since leaves it.
    """
    return (scans.withWatermark("ts", late)
            .groupBy(user_key().alias("user_key"), F.window("ts", live).alias("w"))
            .agg(F.max("ts").alias("ts")).select("user_key", F.col("w.start").alias("since"), "ts"))


def _newest(columns: list[str], keys: list[str]):
    """Of the states that updates report of a key, the last: they only grow."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def window_table(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, "start TIMESTAMP, scans BIGINT, users BIGINT", ("start",), _newest(["scans", "users"], ["start"]), buckets=2)


def user_table(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, "user_key STRING, ts TIMESTAMP", ("user_key",), _newest(["ts"], ["user_key"]))


def count_windows(scans: DataFrame, width: str, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Stream of scans -> windows under `path`, each batch reporting the windows it changed."""
    return _folded(windowed_scans(scans, width, late), window_table(scans.sparkSession, path), checkpoint, "update")


def track_users(scans: DataFrame, live: str, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Stream of scans -> the newest scan of each user under `path`, from state that expires."""
    return _folded(recent_users(scans, live, late).drop("since"), user_table(scans.sparkSession, path), checkpoint, "update")


# --- retention ---------------------------------------------------------------
def write_days(rows: DataFrame, ts: str, path: str) -> None:
    """Rows with a namespace, partitioned by it and by the day of `ts`."""
    rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("namespace", "day").parquet(path)


def expire_days(spark: SparkSession, path: str, as_of: str, days: int | None, protected: str | None = None) -> list[str]:
    """Drop the days that end before `as_of` less `days` (all of them if None), but not those of the
    protected namespace. Folders are listed and deleted, no data file is read; returns the dropped ones."""
    from datetime import datetime, timedelta
    since = None if days is None else (datetime.fromisoformat(as_of) - timedelta(days=days)).strftime("%Y-%m-%d")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda at: [s.getPath().getName() for s in fs.listStatus(Path(at)) if s.isDirectory()] if fs.exists(Path(at)) else []
    gone = []
    for space in names(path):
        if not space.startswith("namespace=") or space == f"namespace={protected}":
            continue
        for day in names(f"{path}/{space}"):
            if day.startswith("day=") and (since is None or day[4:] < since):
                fs.delete(Path(f"{path}/{space}/{day}"), True)
                gone.append(f"{space}/{day}")
    return sorted(gone)
