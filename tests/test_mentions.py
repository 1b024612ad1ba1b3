"""Candidates looked up by the persons that the tables name, against all candidates."""

import os

import pytest
from pyspark.sql import functions as F

from rolecall.checks.bindings import Tables
from rolecall.operators.containment import contains_join, name_grams
from rolecall.operators.mentions import mentions
from rolecall.operators.postings import Postings
from rolecall.schemas import Inputs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_candidates_among_pairs_are_those_of_all(spark):
    t = Tables(spark, SF)
    pairs = mentions(Inputs.of(spark, roster=t.roster.limit(200)), t.keys, Postings.empty(spark))
    some = t.candidates_among(pairs)
    want = t.candidates.withColumn("key", F.lower("repo")).join(pairs, ["person_id", "key"], "left_semi").drop("key")
    assert 0 < some.count() == want.count() < t.candidates.count()
    assert some.exceptAll(want.select(some.columns)).isEmpty()


def test_names_that_differ_late_have_grams_of_their_own(spark):
    names = spark.createDataFrame([(f"supplier no{i}",) for i in range(12_340, 12_350)], "name string")
    keys = names.select(F.explode(name_grams(F.col("name"), 6, [])).alias("g")).select("g.key")
    assert keys.distinct().count() == 10
    texts = spark.createDataFrame([(0, "by supplier no12345 and supplier no123456")], "id int, text string")
    assert {r.name for r in contains_join(texts, names, ["id"]).collect()} == {"supplier no12345"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_only_rosters_of_named_projects_are_ranked(spark, monkeypatch):
    """What projects that no pair names have is dropped before it is ranked."""
    from rolecall.operators import discovery
    t = Tables(spark, SF)
    seen = []
    ranked = discovery.roster.standings
    monkeypatch.setattr(discovery.roster, "standings", lambda roster, *a: seen.append(roster) or ranked(roster, *a))
    named = t.part_names.where("partkey % 50 = 0").select(F.lower("repo").alias("key"))
    t.candidates_among(named.crossJoin(t.people.select("person_id")))
    got = seen[0].select(F.lower("repo").alias("key")).distinct()
    assert named.join(t.roster.select(F.lower("repo").alias("key")), "key", "left_semi").distinct().exceptAll(got).isEmpty()
    assert got.count() <= named.count() + 2
