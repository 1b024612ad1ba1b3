"""Streams over several batches: late data, growing state, repeated batches."""

import pytest
from pyspark.sql import functions as F

from rolecall.streaming import index as sx, usage as su
from rolecall.streaming.merged import MergedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_grows_by_batches_and_keeps_order(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    ddl = "forge string, repo string, login string, commits bigint"

    def add(*data):
        spark.createDataFrame([("github", *d) for d in data], ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        q = sx.fold_rosters(stream, out, ckpt)
        q.awaitTermination()

    add(("o/b", "Ann", 20), ("o/low", "ann", 14))
    add(("o/a", "ann", 15), ("o/b", "ann", 99), ("o/b", "bob", 15))
    add(("o/b", "bob", 16))
    index = sx.read_index(spark, out)
    assert rows(index.select("login", "repo", "batch")) == [("ann", "o/a", 1), ("ann", "o/b", 0), ("bob", "o/b", 1)]


def test_late_scans_are_dropped_once_their_window_is_closed(spark, tmp_path):
    src = str(tmp_path / "src")
    ddl = "ts timestamp, forge string, username string, repos array<string>"
    table, ckpt = str(tmp_path / "t"), str(tmp_path / "c")

    def add(*times):
        spark.createDataFrame([(x, "github", "u", []) for x in times], "ts string, forge string, username string, "
                              "repos array<string>").selectExpr("CAST(ts AS timestamp) AS ts", "forge", "username", "repos") \
            .coalesce(1).write.mode("append").parquet(src)
        q = (su.windowed_scans(spark.readStream.schema(ddl).parquet(src), "1 hour").writeStream
             .outputMode("append").format("parquet").option("path", table).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    add("2024-01-01 00:10:00", "2024-01-01 00:20:00")
    add("2024-01-01 05:00:00")
    add("2024-01-01 00:30:00", "2024-01-01 09:00:00")      # the first hour is closed by now
    got = spark.read.parquet(table).selectExpr("date_format(start, 'HH') AS h", "scans")
    assert rows(got) == [("00", 2), ("05", 1)]


def scan_stream(spark, src, *rows_):
    ddl = "ts timestamp, forge string, username string, repos array<string>"
    (spark.createDataFrame([(x, "github", u, []) for x, u in rows_], "ts string, forge string, username string, repos array<string>")
     .selectExpr("CAST(ts AS timestamp) AS ts", "forge", "username", "repos").coalesce(1).write.mode("append").parquet(src))
    return spark.readStream.schema(ddl).parquet(src)


def test_counts_add_up_over_batches_late_rows_and_retention(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("s", "t", "c"))
    for batch in ([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "b")], [("2024-01-01 05:00:00", "a")],
                  [("2024-01-01 00:30:00", "a"), ("2024-01-01 09:00:00", "c")]):
        su.fold_counts(scan_stream(spark, src, *batch), "1 hour", table, ckpt).awaitTermination()
    hours = lambda df: rows(df.selectExpr("date_format(start, 'HH') AS h", "scans", "users"))
    assert hours(su.read_counts(spark, table)) == [("00", 3, 2), ("05", 1, 1), ("09", 1, 1)]
    assert hours(su.read_counts(spark, table, "2024-01-01 05:00:00")) == [("05", 1, 1), ("09", 1, 1)]


def test_latest_scan_of_each_user_whatever_the_order(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("s", "t", "c"))
    for batch in ([("2024-01-02 00:00:00", "a"), ("2024-01-01 00:00:00", "A")], [("2024-01-01 12:00:00", "a"), ("2024-01-05 00:00:00", "b")]):
        su.fold_latest(scan_stream(spark, src, *batch), table, ckpt).awaitTermination()
    got = su.read_latest(spark, table).selectExpr("user_key", "date_format(ts, 'dd') AS day")
    assert rows(got) == [("github:a", "02"), ("github:b", "05")]


# --- merged tables -----------------------------------------------------------
def log(spark, path, **options):
    fold = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    return MergedTable(spark, path, "k STRING, n BIGINT", ("k",), fold, **options)


def batch(spark, *keys):
    return spark.createDataFrame([(k, 1) for k in keys], "k string, n bigint")


def test_batches_read_nothing_and_levels_stay_few(spark, tmp_path):
    table = log(spark, str(tmp_path / "t"), buckets=3, fanout=3)
    merged = []
    for i in range(20):
        table.add(batch(spark, "a", "b", f"new{i}", "a"), i)
        merged.append(len(table.state()["runs"]))
    # Two runs a level and bucket at most: 3 * 2 * log3(20), whatever the number of batches.
    assert max(merged) <= 3 * 2 * 3
    assert rows(table.read()) == sorted([("a", 40), ("b", 20), *((f"new{i}", 1) for i in range(20))])
    on_disk = {p.parent.parent.name for p in (tmp_path / "t" / "data").glob("run-*/bucket=*/*.parquet")}
    listed = {r[2] for r in table.state()["runs"] + table.state()["dead"]}
    assert on_disk == listed


def test_a_batch_that_dies_before_its_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    table = log(spark, str(tmp_path / "t"))
    table.add(batch(spark, "a"), 0)
    before = table.state()
    with monkeypatch.context() as m:
        m.setattr(MergedTable, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.add(batch(spark, "a", "b"), 1)
    assert table.state() == before and rows(table.read()) == [("a", 1)]
    for _ in range(2):      # run again, and once more after its commit
        table.add(batch(spark, "a", "b"), 1)
    assert rows(table.read()) == [("a", 2), ("b", 1)]
    table.add(batch(spark).limit(0), 2)
    assert rows(table.read()) == [("a", 2), ("b", 1)]
    assert rows(log(spark, str(tmp_path / "none")).read()) == []


# --- state that expires ------------------------------------------------------
def test_old_users_leave_the_state_and_late_rows_do_not_count(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("s", "t", "c"))
    windows = str(tmp_path / "w")
    held = []
    for rows_ in ([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "b")], [("2024-01-09 10:00:00", "c")],
                  [("2024-01-01 12:00:00", "ghost"), ("2024-01-01 12:30:00", "a"), ("2024-01-09 11:00:00", "c")]):
        scans = scan_stream(spark, src, *rows_)
        q = su.track_users(scans, "1 day", table, ckpt)
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        su.count_windows(scans, "1 day", windows, ckpt + "w").awaitTermination()
    assert held[-1] == 1                                    # a and b have left
    got = su.user_table(spark, table).read().selectExpr("user_key", "date_format(ts, 'dd HH') AS at")
    assert rows(got) == [("github:a", "01 10"), ("github:b", "01 11"), ("github:c", "09 11")]
    days = su.window_table(spark, windows).read().selectExpr("date_format(start, 'dd') AS day", "scans")
    assert rows(days) == [("01", 2), ("09", 2)]


def test_expiry_drops_whole_days(spark, tmp_path):
    path = str(tmp_path / "r")
    data = spark.createDataFrame([("2024-01-01 10:00:00", "scan", 1), ("2024-01-05 10:00:00", "scan", 2), ("2024-01-01 10:00:00", "result", 3)],
                                 "ts string, namespace string, n int").selectExpr("CAST(ts AS timestamp) AS ts", "namespace", "n")
    su.write_days(data, "ts", path)
    for part in (tmp_path / "r").glob("*/*/*.parquet"):
        part.write_bytes(b"")                               # expiry reads no data file
    assert su.expire_days(spark, path, "2024-01-06 00:00:00", 3, "result") == ["namespace=scan/day=2024-01-01"]
    assert su.expire_days(spark, path, "2024-01-06 00:00:00", None, "result") == ["namespace=scan/day=2024-01-05"]
    assert [p.parent.name for p in (tmp_path / "r").glob("namespace=*/day=*")] == ["namespace=result"]
    assert su.expire_days(spark, str(tmp_path / "nothing"), "2024-01-06 00:00:00", 3) == []


def test_a_table_is_one_batch_however_many_tasks_write_it(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace
    from rolecall.checks import state
    monkeypatch.setattr(state, "scratch", lambda t: str(tmp_path / "parts"))
    seen, t = [], SimpleNamespace(spark=spark)
    for rows in state.batches(t, spark.range(0, 100, 1, 4), spark.range(100, 250, 1, 6)):
        (rows.writeStream.foreachBatch(lambda df, i: seen.append((i, df.count(), df.select(F.input_file_name()).distinct().count())))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [(0, 100, 4), (1, 150, 6)]
