"""Ranks, totals, caps and releases, with hot projects."""

from rolecall.operators import roster


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def make(spark, data):
    return spark.createDataFrame([("github", r, u, c) for r, u, c in data],
                                 "forge string, repo string, login string, commits bigint")


HANDLES = [(1, "ann"), (1, "ann2"), (2, "bob")]


def test_rank_is_competition_rank_and_takes_the_largest_login(spark):
    r = make(spark, [("o/r", "ANN", 5), ("o/r", "ann2", 60), ("o/r", "bob", 60), ("o/r", "top", 70)])
    h = spark.createDataFrame(HANDLES, "person_id bigint, login string")
    want = [(1, 60, 2, 4), (2, 60, 2, 4)]
    for pages in (None, 2):
        assert rows(roster.standings(r, h, pages), "person_id", "commits", "rank", "n_fetched") == want


def test_hot_project_same_answer_with_and_without_window(spark):
    data = [("hot/r", f"u{i}", i % 37 + 1) for i in range(5000)] + [("o/r", f"u{i}", i) for i in range(1, 50)]
    r = make(spark, data)
    h = spark.createDataFrame([(i, f"u{i}") for i in range(0, 5000, 7)], "person_id bigint, login string")
    got = rows(roster.standings(r, h, None), "person_id", "repo", "commits", "rank", "n_fetched")
    sizes = {"hot/r": 5000, "o/r": 49}
    by = {}
    for repo, u, c in data:
        by.setdefault(repo, []).append(c)
    want = sorted((int(u[1:]), repo, c, 1 + sum(x > c for x in by[repo]), sizes[repo])
                  for repo, u, c in data if int(u[1:]) % 7 == 0)
    assert got == want


def test_cap_keeps_the_top_pages(spark):
    r = make(spark, [("o/r", f"u{i:03}", 1000 - i) for i in range(250)])
    kept = roster.ranked_roster(r, 1)
    assert kept.count() == 100 and kept.where("n_fetched = 100").count() == 100
    assert kept.agg({"commits": "min"}).first()[0] == 901


def test_contributor_total_priority(spark):
    df = spark.createDataFrame([
        ("snap", 200, 637, 900), ("whole", 150, None, 900), ("true", 200, None, 6835), ("low", 200, None, 100),
        ("none", 200, None, None)], "repo string, n_fetched bigint, snapshot bigint, true_total bigint")
    assert rows(roster.contributor_total(df, 2), "repo", "n_contributors", "capped", "approx") == [
        ("low", 200, True, False), ("none", 200, True, False), ("snap", 637, False, True),
        ("true", 6835, False, True), ("whole", 150, False, False)]


def test_release_standing_skips_bots(spark):
    rel = [("ann", i) for i in range(8)] + [("ci[bot]", i) for i in range(5)] + [("bob", 9), ("Bob", 10)]
    df = spark.createDataFrame([("github", "o/r", a, i) for a, i in rel],
                               "forge string, repo string, author_login string, seq bigint")
    df = df.selectExpr("*", "timestamp_seconds(seq) AS published_at")
    h = spark.createDataFrame(HANDLES, "person_id bigint, login string")
    assert rows(roster.release_standings(df, h, 100), "person_id", "mine", "total") == [(1, 8, 10), (2, 2, 10)]
    assert rows(roster.release_standings(df, h, 2), "person_id", "mine", "total") == [(2, 2, 2)]


def test_path_commits_count_distinct_commits_below_a_path(spark):
    c = spark.createDataFrame([
        ("github", "o/r", "ann", "s1", "numpy/f2py/a.py"), ("github", "o/r", "ann", "s1", "numpy/f2py/b.py"),
        ("github", "o/r", "ann", "s2", "numpy/f2pyx/a.py"), ("github", "o/r", "Ann", "s3", "numpy/f2py")],
        "forge string, repo string, login string, sha string, path string")
    t = spark.createDataFrame([("o/r", "numpy/f2py")], "repo string, path string")
    assert rows(roster.path_commits(c, t), "path", "login", "n") == [("numpy/f2py", "ann", 2)]


def test_path_commits_at_the_depths_of_targets_only(spark):
    c = spark.createDataFrame([("github", "o/r", "ann", "s1", "a/b/c/d.py"), ("github", "o/r", "ann", "s2", "a/b"), ("github", "o/r", "ann", "s3", "a//b"),
                               ("github", "o/r", "bob", "s4", "a"), ("github", "o/q", "bob", "s5", "a/b")],
                              "forge string, repo string, login string, sha string, path string")
    t = spark.createDataFrame([("o/r", "a"), ("o/r", "a/b"), ("o/r", "a/"), ("o/r", "a/b/c/d.py")], "repo string, path string")
    n = roster.path_commits(c, t)
    assert rows(n, "path", "login", "n") == [("a", "ann", 3), ("a", "bob", 1), ("a/", "ann", 1), ("a/b", "ann", 2), ("a/b/c/d.py", "ann", 1)]
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan and "slice(" not in plan


def test_a_registry_is_parsed_on_all_cores(spark, tmp_path, monkeypatch):
    from rolecall.checks import decisions
    from rolecall.checks.bindings import Tables
    spark.createDataFrame([(k, f"Brand#{k % 5}") for k in range(100)], "p_partkey bigint, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen, save = [], decisions.reg.save_registry
    monkeypatch.setattr(decisions.reg, "save_registry", lambda df, path: seen.append(df.rdd.getNumPartitions()) or save(df, path))
    decisions.registry_tables(Tables(spark, str(tmp_path)))
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_a_large_roster_is_grouped_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from rolecall.checks import bindings
    spark.range(3000).selectExpr("id % 50 AS l_partkey", "id AS l_suppkey", "1.0D AS l_quantity").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(50).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(3000).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    want = bindings.Tables(spark, str(tmp_path)).roster
    monkeypatch.setattr(bindings, "_TASK_ROWS", 100)
    t = bindings.Tables(spark, str(tmp_path))
    assert t.dealt("lineitem", "l_partkey", "l_suppkey").rdd.getNumPartitions() == 30
    assert t.roster.exceptAll(want).isEmpty() and t.roster.count() == want.count() == 3000
