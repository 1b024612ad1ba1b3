"""Members of organisations times their projects: every pair once, and none of them shuffled."""

import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolecall.checks.bindings import CFG, Tables
from rolecall.operators import discovery
from rolecall.operators.postings import Postings

SF = "/root/testdata/sf0.001"
REPO = discovery.REPO


def above_members(df):
    """What stands above the join that makes the members' pairs."""
    # A literal may break a line.
    lines = re.findall(r"(?m)^(?:[ :]*[:+]- )?[A-Z]\w+.*", df._jdf.queryExecution().optimizedPlan().toString())
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Join" in line and "_cell" in line)
    found, d = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < d:
            found, d = [*found, line.strip(" :+-").split(" ")[0]], depth(line)
    return found


@pytest.mark.parametrize("cell, held", [(1 << 20, 1 << 10), (3, 2)])
def test_lone_members_are_all_pairs_but_the_held_ones(spark, monkeypatch, cell, held):
    monkeypatch.setattr(discovery, "_CELL", cell)
    monkeypatch.setattr(discovery, "_LIST", held)
    orgs = spark.createDataFrame([(p, o) for p in range(12) for o in ("a", "b") if (p + len(o)) % 5 or o == "a"] + [(99, "none")], "person_id bigint, org string")
    top = spark.createDataFrame([(o, "github", f"{o}/{i}") for o in ("a", "b", "empty") for i in range(4)], "org string, forge string, repo string")
    left_out = spark.createDataFrame([(p, "github", r) for p, r in [(i, "a/0") for i in range(11)] + [(1, "a/1"), (1, "b/3")]], "person_id bigint, forge string, repo string")
    want = orgs.join(top, "org").join(left_out, ["person_id", *REPO], "left_anti").select("person_id", *REPO)
    got = discovery.lone_members(orgs, top, left_out).select("person_id", *REPO)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_merged_sources_are_those_of_the_union(spark):
    t = Tables(spark, SF)
    none = spark.createDataFrame([], "person_id bigint, registry string, repo string")
    hits = t.known.select("repo").join(t.roster, "repo").join(t.handles, "login").select("person_id", "forge", "repo").distinct()
    args = t.inputs, t.keys, none, hits, CFG, Postings.empty(spark)
    want = discovery.merge_hits(discovery.discovery_union(*args)).select("person_id", *REPO, "mask")
    got = discovery.merge_sources(*args).select("person_id", *REPO, "mask")
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["candidate_merge", "candidate_duplicates"])
def test_members_pairs_are_not_shuffled(spark, name):
    above = above_members(entry.queries()[name](spark, SF))
    assert above[-1] == "Union" and not {"Aggregate", "Join", "RepartitionByExpression"} & set(above)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_a_project_hosted_under_another_name_than_its_owner(spark):
    """Members are those of the host's owner, ties those to the owner of the name."""
    t = Tables(spark, SF)
    owner = F.when(F.col("repo").endswith("1"), F.lit("brand3")).otherwise(F.col("owner"))
    inputs = replace(t.inputs, repos=t.repos.withColumn("owner", owner))
    none = spark.createDataFrame([], "person_id bigint, registry string, repo string")
    args = inputs, t.keys, none, none.select("person_id", F.lit("github").alias("forge"), "repo"), CFG, Postings.empty(spark)
    every = discovery.merge_hits(discovery.discovery_union(*args)).select("person_id", F.lower("repo").alias("key"))
    want, got = discovery.discover(*args, within=every), discovery.discover(*args)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).isEmpty()
