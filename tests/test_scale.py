"""Work that grows with the result, not with members times projects or with every word of every text."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from rolecall.checks.bindings import Tables
from rolecall.operators import containment, discovery, postings, scoring
from rolecall.operators.evidence import documents
from rolecall.operators.mentions import Teams

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
def test_members_of_teams_are_looked_up(spark):
    """The candidates among a team's members are those among all pairs of members and projects."""
    t = Tables(spark, SF)
    places = t.part_names.where("partkey % 3 = 0").select(
        F.lower("repo").alias("key"), F.when(F.col("partkey") % 2 == 0, "a").otherwise("b").alias("team"))
    members = t.people.select("person_id", F.when(F.col("person_id") % 3 == 0, "a").otherwise("b").alias("team"))
    every = places.join(members, "team").select("person_id", "key")
    none = every.where("false")
    got, want = t.candidates_among(none, Teams(places, members)), t.candidates_among(every)
    assert 0 < got.count() == want.count() < every.count()
    assert got.exceptAll(want).isEmpty()


def test_team_pairs_are_said_or_owned(spark):
    members = spark.createDataFrame([(p, "t") for p in range(50)], "person_id bigint, team string")
    places = spark.createDataFrame([(f"o{r % 2}/r{r}", "t") for r in range(40)], "key string, team string")
    said = spark.createDataFrame([(1, "github", "O1/r1"), (2, "github", "o0/r2"), (99, "github", "o1/r3"), (3, "github", "x/y")],
                                 "person_id bigint, forge string, repo string")
    orgs = spark.createDataFrame([(7, "o1"), (98, "o1")], "person_id bigint, org string")
    top = spark.createDataFrame([(f"o{r % 2}", "github", f"o{r % 2}/r{r}") for r in range(40)], "org string, forge string, repo string")
    got = {(r.person_id, r.key) for r in discovery.team_pairs(Teams(places, members), said, orgs, top).collect()}
    assert got == {(1, "o1/r1"), (2, "o0/r2")} | {(7, f"o1/r{r}") for r in range(1, 40, 2)}


def test_a_rule_meets_only_the_candidates_of_its_team(spark):
    """No row of the join stands for a member who is no candidate."""
    owners = spark.createDataFrame([("github", "o/r", "CODEOWNERS", "docs", "team", "@org/team", 5), ("github", "o/r", "CODEOWNERS", "src", "handle", "@s1", 7)],
                                   "forge string, repo string, path string, scope string, kind string, owner string, at bigint")
    teams = spark.createDataFrame([("Org", "team", f"S{i}") for i in range(1000)], "org string, team string, login string")
    keys = spark.createDataFrame([(1, "github", "o/r", "u", "handle", "s1"), (2, "github", "o/r", "u", "handle", "s2"),
                                  (3, "github", "o/r", "u", "name", "s3"), (4, "github", "o/other", "u", "handle", "s4")],
                                 "person_id bigint, forge string, repo string, project_url string, kind string, key string")
    found = documents.codeowner_matches(owners, teams, keys)
    assert sorted((r.person_id, r.scope, r.detail, r.at) for r in found.collect()) == [
        (1, "docs", "member of @org/team (CODEOWNERS in CODEOWNERS)", 5), (1, "src", "listed as @s1 in CODEOWNERS", 7),
        (2, "docs", "member of @org/team (CODEOWNERS in CODEOWNERS)", 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*repo#\d+ = repo#\d+.*team#\d+ = team#\d+", plan)


def test_names_of_one_gram_are_not_counted(spark, monkeypatch):
    calls = []
    made = containment.postings
    monkeypatch.setattr(containment, "postings", lambda *a, **k: calls.append(k.get("kinds")) or made(*a, **k))
    lines = ["by ada lovelace", "ada  lovelace", "xada lovelacey", "grace brewster hopper", "grace brewster", "ada\tlovelace", "émile zola", "o'neil é"]
    texts = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    for names, passes in ((["ada lovelace", "émile zola", "no body"], 1), (["ada lovelace", "grace brewster hopper", "émile zola"], 2), (["lovelace", "émile zola"], 2)):
        calls.clear()
        df = spark.createDataFrame([(n,) for n in names], "name string")
        got = {(r.id, r.name) for r in containment.contains_join(texts, df, ["id"], min_len=4).collect()}
        assert got == {(i, n) for i, x in enumerate(lines) for n in names if n in x}
        assert len(calls) == passes


def test_other_blanks_make_no_rows(spark):
    """Only blanks between characters that some name has around one are cut out."""
    assert containment._edge_class(["r", "]", "^", "é"]) == r"[\x{5d}\x{5e}\x{72}\x{e9}]"
    assert containment._edge_class([]) == containment._edge_class(["a", ""]) == "."
    texts = spark.createDataFrame([(0, "]a ^b, r] ^x é] ]é")], "id int, text string")
    names = spark.createDataFrame([("r] ^x",), ("é] ]é",), ("a ^bc",)], "name string")
    assert {r.name for r in containment.contains_join(texts, names, ["id"], min_len=4).collect()} == {"r] ^x", "é] ]é"}


@needs_tables
def test_evidence_does_not_parse_words(spark):
    from rolecall.checks.documents import owners_files
    from rolecall.checks.rosters import context
    t = Tables(spark, SF)
    ctx = context(t, files=owners_files(t))
    assert {r.parser for r in ctx.postings.posts.select("parser").distinct().collect()} == {"owners"}
    assert "words" not in postings.EVIDENCE_PARSERS and len(postings.EVIDENCE_PARSERS) == len(postings.PARSERS) - 1


def test_owners_are_read_from_files_that_have_a_key(spark):
    files = spark.createDataFrame([("owners", 1, 1, "OWNERS", "approvers:\n  - A\nreviewers:\n- b\n"), ("owners", 2, 2, "CODEOWNERS", "* @c\n"),
                                   ("owners", 3, 3, "x/OWNERS", "reviewers:\n- d")], "parser string, h1 bigint, h2 bigint, path string, text string")
    found = postings.PARSERS["owners"](files)
    assert {(r.h1, r.role, r.key) for r in found.collect()} == {(1, "maintainer", "a"), (1, "code_owner", "b"), (3, "code_owner", "d")}
    assert "contains(text" in found._jdf.queryExecution().optimizedPlan().toString().lower()


@needs_tables
def test_queries_that_read_candidates_once_do_not_store_them(spark, monkeypatch):
    from rolecall.checks import decisions, discovery as dc, rosters
    monkeypatch.setattr(Tables, "candidates", property(lambda self: pytest.fail("all candidates are written")))
    t = Tables(spark, SF)
    for query in (dc.keep_candidate, dc.trust_and_notable, dc.speculative_split, decisions.user_operator, rosters.rank_rescue):
        assert query(t).columns


def test_logarithms_are_those_of_the_c_library_without_python(spark):
    n = 1 << 16
    df = spark.range(-2, n).select("id", scoring.log10(F.col("id")).alias("l"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(r.l == (math.log10(r.id) if r.id > 0 else None) for r in df.collect())
