"""The whole run on a hand-made snapshot with one case per kind of evidence."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rolecall import Config, Inputs, fixed
from rolecall.operators import evidence as ev, report, scoring
from rolecall.plans import run as plan
from rolecall.schemas import INPUT_DDL
from rolecall.sources import hosts

FILES = {
    ("me/own", "README.md"): "hi",
    ("big/owners", "docs/CODEOWNERS"): "# Sparse Tensors\n/a @ann\n/b @ann\n\n* a@x.org\n.github/CODEOWNERS @ann\n",
    ("small/owners", "CODEOWNERS"): "* @ann\n",                    # untrusted copy
    ("big/first", ".github/CODEOWNERS"): "* @other\n",             # the first file decides
    ("big/first", "CODEOWNERS"): "* @ann\n",
    ("big/team", "CODEOWNERS"): "/c @org/core @ann\n",
    ("big/k8s", "OWNERS"): "approvers:\n- bob\nreviewers:\n- ann\n",
    ("big/k8s", "MAINTAINERS"): "Ann Lee\n",                       # not read: OWNERS named the person
    ("big/maint", "MAINTAINERS"): "# people\n- Joe <j@x>\n- Ann Lee\n",
    ("big/gov", "GOVERNANCE.md"): "# Steering Council\n\n- @ann\n",
    ("big/prop", "peps/pep-0001.rst"): "PEP: 1\nAuthor: Ann Lee <a@x.org>,\n  Bob\n\nText\n",
    ("big/prop", "peps/pep-0002.rst"): "PEP: 2\nAuthor: Ann Lee\n",
    ("big/prop", "peps/pep-0003.rst"): "PEP: 3\nAuthor: Someone Else\n",
    ("big/credit", "THANKS.txt"): "Thanks\nAnn Lee for f2py and more\n",
    ("big/pkg", "pyproject.toml"): '[project]\nauthors = [{name = "Ann Lee"}, {email = "q@q"}]\n',
    ("big/commits", "setup.py"): 'setup(author="Ann Lee", maintainer_email="a@x.org")',
}


@pytest.fixture(scope="module")
def out(spark):
    def table(name, rows):
        return spark.createDataFrame(rows, INPUT_DDL[name])
    repos = ["big/owners", "big/first", "big/team", "big/k8s", "big/maint", "big/gov", "big/prop", "big/credit",
             "big/pkg", "big/commits", "big/page", "big/claims", "big/wiki", "big/rel", "big/curated", "big/found",
             "big/index"]
    meta = [("github", r, r.split("/")[0], 5000, 300, False, False, None, None) for r in repos]
    meta += [("github", "me/own", "me", 60, 3, False, False, None, None),
             ("github", "ann/proj", "ann", 60, 3, False, False, None, None),
             ("github", "ann/copy", "ann", 0, 0, True, False, None, "up/stream"),
             ("github", "small/owners", "small", 60, 3, False, False, None, None),
             ("github", "small/drive", "small", 60, 3, False, False, None, None),
             ("github", "up/stream", "up", 60, 40, False, False, None, None)]
    hit = lambda r, s="search:CODEOWNERS": (1, "github", r, s)
    inputs = Inputs.of(
        spark,
        people=table("people", [(1, "ann"), (2, "bob"), (3, "carol")]),
        accounts=table("accounts", [(1, "github", "Ann", " Ann Lee ", "A@x.org", None, None)]),
        forges=hosts.forges(spark), repos=table("repos", meta),
        discovery_hits=table("discovery_hits", [hit(r) for r in repos if r not in ("big/index", "big/curated")] + [
            hit("small/owners"), hit("ann/proj", "owned"), hit("ann/copy", "owned"), hit("gone/gone"),
            hit("small/drive", "history"), hit("small/rank", "history")]),
        teams=table("teams", [("org", "core", "ann")]),
        files=table("files", [("github", r, p, t) for (r, p), t in FILES.items()]),
        dir_entries=table("dir_entries", [("github", "big/prop", "peps", f"pep-000{i}.rst", False) for i in (1, 2, 3)]),
        roster=table("roster", [
            ("github", "big/commits", "ann", 40), ("github", "big/commits", "bob", 90),
            ("github", "ann/proj", "ann", 500), ("github", "up/stream", "ann", 30), ("github", "up/stream", "x", 10),
            ("github", "small/drive", "ann", 2), ("github", "small/drive", "x", 10),
            ("github", "big/index", "ann", 120), ("github", "big/index", "x", 10)]),
        reverse_index=table("reverse_index", [("ann", "big/index", 0)]),
        releases=table("releases", []).unionByName(spark.range(5).select(
            F.lit("github").alias("forge"), F.lit("big/rel").alias("repo"), F.lit("Ann").alias("author_login"),
            F.timestamp_seconds("id").alias("published_at"), F.col("id").alias("seq"))),
        pages=table("pages", [("https://p/team", "<li>Ann&nbsp;Lee</li>"), ("https://p/council", "ann lee"),
                              ("https://p/links", '<a href="https://github.com/ANN">')]),
        known=table("known", [("big/page", "critical", None, None, None, False, None),
                              ("big/curated", "high", None, None, None, True, None),
                              ("big/credit", None, None, None, 637, False, None)]),
        known_aliases=table("known_aliases", [("big/page", "Old/Page")]),
        role_sources=table("role_sources", [
            ("big/page", 0, "https://p/team", "maintainer", "Team"), ("big/page", 1, "https://p/council", "steering_council", None),
            ("big/page", 2, "https://p/links", "steering_council", "Council")]),
        curated_roles=table("curated_roles", [("big/curated", 0, "@Ann", "author", None, "founder")]),
        subcomponents=table("subcomponents", [("big/credit", 0, "numpy/f2py", "author", "f2py")]),
        claims=table("claims", [("big/claims", "P170", "ann", "http://q/1"), ("big/claims", "P178", "bob", "http://q/2")]),
        founder_claims=table("founder_claims", [("big/found", None, "Ann Lee", None, 0)]),
        articles=table("articles", [("big/wiki", "Wiki (x)", "| author = [[Ann Lee]] and Team Project\n")]),
    )
    return plan.run(inputs, Config(as_of="2024-01-01 00:00:00")), inputs


def test_evidence(out):
    got = {(r.repo, r.source, r.role, round(r.confidence, 2), r.qualifier)
           for r in out[0].evidence.where("person_id = 1").collect()}
    assert got == {
        ("ann/proj", "ownership", "author", .9, None),
        ("big/owners", "codeowners", "code_owner", .9, "Sparse Tensors"), ("big/owners", "codeowners", "code_owner", .9, None),
        ("big/team", "codeowners", "code_owner", .9, "/c"),
        ("big/k8s", "maintainers", "code_owner", .8, None), ("big/maint", "maintainers", "maintainer", .5, None),
        ("big/gov", "governance", "steering_council", .7, None),
        ("big/prop", "enhancement_proposals", "standards_author", .85, None),
        ("big/credit", "authors", "author", .65, "f2py"),
        ("big/pkg", "manifests", "author", .45, None), ("big/commits", "manifests", "author", .8, None),
        ("big/commits", "manifests", "maintainer", .8, None),
        ("big/commits", "contributors", "core_contributor", .6, None),
        ("up/stream", "contributors", "core_contributor", .6, None),
        ("big/index", "contributors", "core_contributor", .8, None),
        ("big/page", "web_roles", "maintainer", .75, None), ("big/page", "web_roles", "steering_council", .9, None),
        ("big/curated", "curated", "author", .95, None), ("big/claims", "wikidata", "author", .9, None),
        ("big/wiki", "wikipedia_authors", "author", .6, None), ("big/found", "founders", "author", .6, None),
        ("big/rel", "release_manager", "release_manager", .9, None)}


def test_candidates(out):
    repos = {r.repo for r in out[0].candidates.where("person_id = 1").collect()}
    assert "up/stream" in repos                    # upstream of an owned fork
    assert "ann/copy" not in repos                 # the fork itself
    assert "gone/gone" not in repos                # nothing known about it: treated as a fork
    assert {"big/curated", "big/page"} <= repos    # curated projects that name the person


def test_below_bar(out):
    assert [tuple(r) for r in out[0].below_bar.collect()] == [(1, 1)]


def test_records(out):
    r = {x.repo: x for x in out[0].records.where("person_id = 1").collect()}
    assert r["big/commits"].roles == ["author", "core_contributor", "maintainer"]
    assert r["big/commits"].role == "author" and r["big/commits"].contributions == 40
    assert r["ann/proj"].tier == "primary" and all(0 <= x.confidence <= .99 for x in r.values())
    assert r["up/stream"].tier == "primary" and r["up/stream"].rank == 1
    assert {x.tier for x in r.values()} <= {"primary", "secondary", "dropped"}


def written(lines):
    """The report of each person as text."""
    text = {}
    for r in report.in_report_order(lines).collect():
        text.setdefault(r.person_id, []).append(r.line)
    return {k: "\n".join(v) for k, v in text.items()}


def test_reports(out):
    o, inputs = out
    docs = {k: json.loads(v) for k, v in written(report.report_json(o.records, o.evidence, inputs.people)).items()}
    mine = docs[1]
    assert list(mine) == ["user", "count", "projects", "secondary_count", "secondary"]
    assert (mine["user"], mine["count"], mine["secondary_count"]) == ("ann", len(mine["projects"]), len(mine["secondary"]))
    scores = [p["score"] for p in mine["projects"]]
    assert scores == sorted(scores, reverse=True) and {p["project"] for p in mine["projects"]} >= {"big/commits", "up/stream"}
    commits = next(p for p in mine["projects"] if p["project"] == "big/commits")
    assert [e["source"] for e in commits["evidence"]] == ["manifests", "manifests", "contributors"]
    assert docs[3] == {"user": "carol", "count": 0, "projects": [], "secondary_count": 0, "secondary": []}
    md = written(report.report_markdown(o.records, o.evidence, inputs.people))
    assert "_No elevated roles found._" in md[3] and "### [big/commits](" in md[1] and "- **Author** (0.80, via `manifests`): author name in setup.py" in md[1]
    top = {x.line for x in report.highlights(o.records, o.evidence, 30).collect()}
    assert "- big/rel (5k★) — Release manager (5/5)" in top
    assert "- up/stream (60★) — Core contributor (#1/2)" in top
    assert "- big/credit (5k★) — Author (f2py)" in top


def test_a_long_record_is_many_lines(spark, out):
    o, inputs = out
    one = o.evidence.where("person_id = 1 AND repo = 'big/commits'").limit(1)
    many = o.evidence.unionByName(one.drop("ord").join(spark.range(5000).withColumnRenamed("id", "ord")).select(o.evidence.columns)).unionByName(one)
    lines = report.numbered(report.report_json(o.records, many, inputs.people)).collect()
    assert sorted(x.position for x in lines) == list(range(1, len(lines) + 1))
    text = "".join(x.line for x in sorted(lines, key=lambda x: x.position) if x.person_id == 1)
    assert sum(len(p["evidence"]) for p in json.loads(text)["projects"] if p["project"] == "big/commits") == 5004


def test_registered_operators():
    from rolecall.fixed import EVIDENCE_ORDER
    assert list(ev.operators()) == EVIDENCE_ORDER


def test_user_operator_and_schema_check(spark):
    df = spark.createDataFrame([(1, "github", "o/r")], "person_id bigint, forge string, repo string")
    good = ev.emit(df, "mine", role="author", url=F.lit("u"), confidence=0.5, detail=F.lit("d"))
    assert ev.check_schema(good, "mine") is good
    with pytest.raises(ValueError):
        ev.check_schema(df, "mine")


def scored(spark, rows):
    df = spark.createDataFrame([(1, "github", "o/r", i, s, r, c) for i, (s, r, c) in enumerate(rows)],
                               "person_id bigint, forge string, repo string, ord bigint, source string, role string, "
                               "confidence double")
    e = ev.emit(df, "mine", role=F.col("role"), url=F.lit("u"), confidence=F.col("confidence"), detail=F.lit(""),
                seq=F.col("ord"), source=F.col("source"))
    return scoring.score_evidence(e).collect()


def test_scores_equal_on_paper_order_as_in_sql(spark):
    """log10(1414) x .80 x .7 and x .70 x .8: the last bit decides the order, so it has to be the C library's."""
    rows = [(n, r, c) for n in range(2100) for r, c in (("code_owner", .7), ("core_contributor", .8), ("author", None))]
    df = spark.createDataFrame(rows, "pop bigint, role string, confidence double")
    got = df.withColumn("score", scoring.record_score(F.col("pop"), F.col("role"), F.col("confidence"))).collect()
    assert [x.score for x in got] == [None if x.confidence is None else math.log10(x.pop + 10) * fixed.ROLE_WEIGHT[x.role] * x.confidence
                                      for x in got]


def test_scoring_rules(spark):
    assert scored(spark, [("a", "contributor", .9), ("b", "org_member", .9)]) == []
    r = scored(spark, [("setup", "maintainer", .45), ("ownership", "author", .9)])[0]
    assert r.role == "author" and r.roles == ["author", "maintainer"]
    # .85 x .70 equals .70 x .85 as products: the weightier role wins.
    r = scored(spark, [("c", "core_contributor", .85), ("m", "maintainer", .70)])[0]
    assert r.role == "maintainer"
    r = scored(spark, [("a", "author", .9), ("b", "author", .5), ("b", "author", .4)])[0]
    assert round(r.confidence, 2) == .95
    r = scored(spark, [(s, "author", .95) for s in "abcd"])[0]
    assert r.confidence == .99
