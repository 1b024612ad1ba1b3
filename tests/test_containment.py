"""The containment join against brute force."""

import random

from pyspark.sql import functions as F

from rolecall.operators.containment import contains_join, name_grams, postings

WORDS = ["ann", "lee", "li", "x", "o", "jean", "paul", "marie", "de", "la", "smith", "smithson", "ronja",
         "weberson", "annabel", "joann", "é", ""]


def brute(texts, names, min_len):
    return {(k, i, n) for k, i, t in texts for k2, n in names if k == k2 and len(n) >= min_len and n in t}


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    phrase = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    texts = [(rnd.randrange(3), i, phrase(rnd.randrange(0, 25))) for i in range(150)]
    names = {(rnd.randrange(3), phrase(rnd.randrange(1, 7)).strip()) for _ in range(300)}
    # Names cut out of texts at arbitrary places, so that every kind of key has hits.
    for k, _, t in texts:
        for _ in range(4):
            a = rnd.randrange(len(t) + 1)
            names.add((k, t[a:a + rnd.randrange(1, 30)].strip()))
    names = sorted(n for n in names if n[1])
    tdf = spark.createDataFrame(texts, "k bigint, id bigint, text string")
    ndf = spark.createDataFrame(names, "k bigint, name string")
    for min_len in (4, 6):
        got = contains_join(tdf, ndf, ["k", "id"], on=["k"], min_len=min_len).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == brute(texts, names, min_len)


def test_only_one_kind_of_name(spark):
    tdf = spark.createDataFrame([(1, "by joann leeson and ronjaweberson")], "id bigint, text string")
    run = lambda *ns: {r.name for r in contains_join(
        tdf, spark.createDataFrame([(n,) for n in ns], "name string"), ["id"]).collect()}
    assert run("ann lee", "ann leo") == {"ann lee"}
    assert run("awebers", "awebars") == {"awebers"}
    assert run("leeson and ronjaweber") == {"leeson and ronjaweber"}
    assert run("short") == set()


def test_short_words_and_a_key_that_a_third_of_the_texts_hold(spark):
    """Two-letter words everywhere, and one name whose grams are frequent."""
    rnd = random.Random(3)
    two = ["al", "bo", "li", "wu", "xi", "o", "a b"]
    phrase = lambda n: " ".join(rnd.choice(two + WORDS) for _ in range(n))
    texts = [(0, i, phrase(12) + (" wu xi al" if i % 3 == 0 else "")) for i in range(240)]
    names = sorted({(0, phrase(rnd.randrange(2, 4)).strip()) for _ in range(250)} | {(0, "wu xi"), (0, "wu xi al"), (0, "u x")})
    tdf = spark.createDataFrame(texts, "k bigint, id bigint, text string")
    ndf = spark.createDataFrame(names, "k bigint, name string")
    joined = contains_join(tdf, ndf, ["id"], min_len=3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs and "Cartesian" not in plan
    got = joined.collect()
    assert len(got) == len(set(got)) and {(0, r.id, r.name) for r in got} == brute(texts, names, 3)


def test_postings_are_only_those_of_wanted_grams(spark):
    tdf = spark.createDataFrame([(i, "lorem ipsum dolor sit amet consectetur " * 20) for i in range(50)] + [(50, "by ann lee")], "id bigint, text string")
    wanted = spark.createDataFrame([("ann lee",)], "name string").select(F.explode(name_grams(F.col("name"), 6, [])).alias("g")).select("g.key")
    assert postings(tdf, wanted, ["id"], "text", 6, []).select("id").collect() == [(50,)]


def test_extra_columns_are_kept(spark):
    tdf = spark.createDataFrame([(1, "ann lee", "Ann Lee")], "id bigint, text string, raw string")
    ndf = spark.createDataFrame([("ann lee",)], "name string")
    assert [tuple(r) for r in contains_join(tdf, ndf, ["id"], keep=["raw"]).collect()] == [(1, "ann lee", "Ann Lee")]


def test_long_texts_are_read_in_windows(spark):
    """Names of any length, wherever windows meet, across lines and beside wide characters; no posting holds a whole text."""
    rnd = random.Random(11)
    texts = [(0, i, "".join(rnd.choice(["ab", "cde", "f", "ghijklmno", "é", "\U0001f600", " ", " ", "\n"]) for _ in range(2000))) for i in range(6)]
    names = {(0, t[at:at + rnd.randrange(6, 300)].strip(" ")) for _, _, t in texts for at in range(0, len(t), 37)}
    names |= {(0, n[:-1] + "#") for _, n in list(names)[:40]}
    tdf = spark.createDataFrame(texts, "k bigint, id bigint, text string")
    got = contains_join(tdf, spark.createDataFrame(sorted(names), "k bigint, name string"), ["id"]).collect()
    assert len(got) == len(set(got)) and {(0, r.id, r.name) for r in got} == brute(texts, names, 6)
    wanted = spark.createDataFrame([("cde ab",)], "name string").select(F.explode(name_grams(F.col("name"), 6, [])).alias("g")).select("g.key")
    around = postings(tdf, wanted, ["id"], "text", 6, [], 20).collect()
    assert around and all("cde ab" in r._window and len(r._window) < 600 for r in around)
