"""Registry files, package documents, host payloads and file readers."""

import json

from rolecall.operators import registry as rg
from rolecall.sources import files, hosts, packages, registry as reg


def test_registry_round_trip_and_overlay(spark, tmp_path):
    seed = {"_schema": "x", "projects": {
        "o/a": {"importance": "critical", "aliases": ["old/A"], "wikipedia": "A",
                "role_conventions": [{"extractor": "enhancement_proposals", "role": "standards_author", "path": "peps"}],
                "role_sources": [{"url": "https://a", "role": "maintainer", "label": "Team"}],
                "popularity": {"min_stars_override": True, "contributors": 637}},
        "o/b": {"importance": "high"}}}
    user = {"projects": {"o/a": {"popularity": {"stars": 5, "forks": 1}, "aliases": []},
                         "o/c": {"popularity": {"stars": 7, "forks": 2}}}}
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=2))
    (tmp_path / "user.json").write_text(json.dumps(user, indent=2))
    base, over = (reg.read_registry(spark, str(tmp_path / f)) for f in ("seed.json", "user.json"))
    merged = reg.overlay(base, over)
    tables = reg.tables(merged)
    known = {r.repo: r for r in tables["known"].collect()}
    # The popularity map is replaced whole, everything the overlay leaves out stays.
    assert (known["o/a"].stars, known["o/a"].contributors, known["o/a"].min_stars_override) == (5, None, False)
    assert known["o/a"].importance == "critical" and known["o/c"].stars == 7 and known["o/b"].stars is None
    assert tables["role_sources"].first().label == "Team"
    keys = {r.key: r.known_repo for r in rg.known_keys(tables["known"], tables["known_aliases"]).collect()}
    assert keys["old/a"] == "o/a"

    reg.save_registry(merged, str(tmp_path / "out"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["repo"] for r in rows) == ["o/a", "o/b", "o/c"]
    assert next(r for r in rows if r["repo"] == "o/b") == {"repo": "o/b", "importance": "high"}
    back = reg.read_saved(spark, str(tmp_path / "out"))
    whole = lambda df: sorted((r.json for r in reg.registry_lines(df).collect()))
    assert whole(back) == whole(merged) and set(back.columns) == set(merged.columns)


def test_read_text_files(spark, tmp_path):
    f = tmp_path / "github" / "o" / "r" / "docs" / "CODEOWNERS"
    f.parent.mkdir(parents=True)
    f.write_text("* @ann\n")
    r = files.read_text_files(spark, str(tmp_path), str(tmp_path)).first()
    assert (r.forge, r.repo, r.path, r.text) == ("github", "o/r", "docs/CODEOWNERS", "* @ann\n")


def test_package_documents(spark):
    npm = {"objects": [{"package": {"name": "p", "repository": {"type": "git", "url": "git@github.com:o/r.git"},
                                    "author": {"email": "A@x.org"}}}, {"package": {}}]}
    crates = {"crates": [{"name": "c", "repository": "https://github.com/o/c"}, {"name": "d", "repository": None}]}
    pypi = {"info": {"name": "q", "author": "Ann Lee", "home_page": None,
                     "project_urls": {"Funding": "https://github.com/sponsors/x", "Source": "https://github.com/o/q"}}}
    docs = spark.createDataFrame(
        [("npm", "ann", json.dumps(npm)), ("crates", "Ann", json.dumps(crates)), ("pypi", None, json.dumps(pypi)),
         ("npm", "ann", "not json")], "registry string, login string, payload string")
    people = spark.createDataFrame([(1, "ANN")], "person_id bigint, primary_login string")
    keys = spark.createDataFrame([(1, "email", "a@x.org"), (1, "handle", "ann")],
                                 "person_id bigint, kind string, key string")
    got = {(r.registry, r.name, r.repo, r.author_match) for r in packages.person_packages(docs, people, keys).collect()}
    assert got == {("npm", "p", "o/r", True), ("crates", "c", "o/c", False), ("crates", "d", None, False)}
    assert [tuple(r) for r in packages.pypi_authors(docs).collect()] == [
        ("q", "https://pypi.org/project/q/", "o/q", "name", "ann lee")]


def test_unknown_counts_are_not_zero(spark):
    raw = spark.createDataFrame([
        ('{"nameWithOwner": "o/r", "stargazerCount": null, "forkCount": 3}',), ('{"nameWithOwner": ""}',), ("x",)],
        "payload string")
    r = hosts.normalise(raw, "github_graphql").collect()
    assert [(x.repo, x.stars, x.forks, x.is_fork) for x in r] == [("o/r", None, None, False)]
