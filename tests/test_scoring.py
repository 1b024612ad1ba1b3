"""Records and highlights from evidence and project standing."""

from rolecall.operators import report, scoring

EVIDENCE = ("person_id bigint, forge string, repo string, ord bigint, source string, role string, url string, confidence double, detail string, "
            "qualifier string, rank bigint, n_contributors bigint, capped boolean, approx boolean, contributions bigint, releases_authored bigint, releases_total bigint")
STANDING = "forge string, repo string, project_url string, stars bigint, forks bigint, pushed_at timestamp, has_stars boolean, importance string, override boolean, manual boolean"


def made(spark):
    none = (None,) * 9
    ev = spark.createDataFrame([(p, "github", f"o/r{r}", 10 * p + r, "s", "maintainer", "u", 0.5, "d", *none[:8])
                                for p in (1, 2) for r in (1, 2, 3)], EVIDENCE)
    standing = spark.createDataFrame([("github", f"o/r{r}", f"https://x/o/r{r}", 90 * r, 1, None, True, None, False, False)
                                      for r in (1, 2, 3)], STANDING)
    return ev, scoring.split_tiers(scoring.to_records(scoring.score_evidence(ev), standing), 50, "2024-01-01 00:00:00")


def test_the_standing_of_a_project_serves_all_persons(spark):
    _, records = made(spark)
    assert sorted((r.person_id, r.repo, r.popularity) for r in records.collect()) == [
        (p, f"o/r{r}", 90 * r) for p in (1, 2) for r in (1, 2, 3)]


def test_highlights_drop_other_evidence_where_it_is_read(spark):
    ev, records = made(spark)
    top = report.highlights(records, ev, 2)
    assert sorted((r.person_id, r.position, r.line) for r in top.collect()) == [
        (p, i, f"- o/r{r} ({90 * r}★) — Maintainer") for p in (1, 2) for i, r in ((1, 3), (2, 2))]
    assert "getbit" in top._jdf.queryExecution().optimizedPlan().toString().lower()
