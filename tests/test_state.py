"""Two runs in a row on two hosts: the second sees what the first learnt."""

from pyspark.sql import functions as F

from rolecall import Config, Inputs
from rolecall.plans.state import State, scan
from rolecall.schemas import INPUT_DDL
from rolecall.sources import hosts


def snapshot(spark, **rows):
    return Inputs.of(spark, forges=hosts.forges(spark),
                     **{name: spark.createDataFrame(data, INPUT_DDL[name]) for name, data in rows.items()})


CFG = Config(as_of="2024-01-01 00:00:00")
META = [("github", "big/tool", "big", 5000, 300, False, False, None, None), ("gitlab", "team/lib", "team", None, 40, False, False, None, None),
        ("github", "late/found", "late", 4000, 200, False, False, None, None)]


def test_the_second_run_sees_what_the_first_learnt(spark, tmp_path):
    path = str(tmp_path / "state")
    first = snapshot(
        spark, people=[(1, "ann")], accounts=[(1, "github", "ann", "Ann Lee", None, None, None)],
        repos=META[:2], files=[("gitlab", "team/lib", "CODEOWNERS", "* @annl\n"), ("github", "big/tool", "OWNERS", "approvers:\n- ann\n")],
        discovery_hits=[(1, "github", "big/tool", "search:OWNERS"), (1, "gitlab", "team/lib", "search:CODEOWNERS")],
        profile_links=[("github", "ann", "https://gitlab.com/annl"), ("gitlab", "annl", "https://github.com/ann")],
        roster=[("github", "late/found", "ann", 120), ("github", "late/found", "x", 10), ("github", "big/tool", "ann", 30)],
        known=[("big/tool", "critical", None, None, None, False, None)],
        discovered_sources=[("big/tool", 0, "https://p/team", "maintainer", "Team")], manual=[(1, "team/lib", None)])
    out = scan(first, CFG, path)
    state = State(spark, path)
    assert sorted(tuple(r) for r in state.accounts.read().collect()) == [(1, "github", "ann"), (1, "gitlab", "annl")]
    assert {r.repo for r in state.index.read().collect()} == {"late/found", "big/tool"}
    assert [tuple(r) for r in state.popularity.read().where("repo = 'big/tool'").select("stars", "forks", "run").collect()] == [(5000, 300, 0)]
    assert {(r.forge, r.repo) for r in out.records.collect()} >= {("github", "big/tool")}
    assert state.next_run() == 1

    # The second snapshot has neither links, nor the index, nor the role page in its tables.
    second = snapshot(
        spark, people=[(1, "ann")], accounts=[(1, "github", "ann", "Ann Lee", None, None, None)], repos=META,
        roster=[("github", "late/found", "ann", 120), ("github", "late/found", "x", 10)],
        pages=[("https://p/team", "<li>Ann Lee</li>")], known=[("big/tool", "critical", None, None, None, False, None)],
        files=[("gitlab", "team/lib", "CODEOWNERS", "* @annl\n")], discovery_hits=[(1, "gitlab", "team/lib", "search:CODEOWNERS")])
    again = scan(second, CFG, path)
    found = {(r.repo, r.source) for r in again.evidence.collect()}
    assert ("late/found", "contributors") in found          # by the index of the first run
    assert ("big/tool", "web_roles") in found               # by the page the first run discovered
    assert state.next_run() == 2
    assert {r.batch for r in state.index.read().collect()} == {0}
    assert state.role_sources.read().count() == 1 and state.accounts.read().count() == 2


def test_a_repeated_run_adds_nothing_twice(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    seen = lambda stars, run: spark.createDataFrame([("a/b", stars, None, run)], "repo string, stars long, contributors long, run long").withColumn("forks", F.lit(None).cast("long"))
    state.popularity.add(seen(10, 0), 0)
    state.popularity.add(seen(11, 0), 0)
    state.popularity.add(seen(None, 1), 1)
    assert [tuple(r) for r in state.popularity.read().select("stars", "run").collect()] == [(10, 1)]
    assert state.next_run() == 0
