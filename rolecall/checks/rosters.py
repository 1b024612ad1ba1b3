"""Checks of roster, release and path operators."""

from pyspark.sql import functions as F

from ..functions import roles
from ..operators import roster
from ..operators.discovery import candidate_keys
from ..operators.evidence import base, rosters as ev
from ..operators.mentions import mentions, team_mentions
from ..operators.postings import EVIDENCE_PARSERS, Postings, index_files
from ..schemas import Inputs
from .base import check, view
from .bindings import CFG


def context(t, packages=None, **tables):
    """What an operator over these tables may read, or one over the rosters: the candidates that they name."""
    inputs = t.inputs.with_tables(**tables)
    posted = index_files(inputs, CFG.proposals_per_series, only=EVIDENCE_PARSERS) if "files" in tables else Postings.empty(t.spark)
    said = Inputs.of(t.spark, known=t.known, **({"repos": t.repos, "manual": t.manual} | (tables or {"roster": t.roster})))
    teams = team_mentions(said, t.keys, posted) if "teams" in tables else None
    candidates = t.candidates_among(mentions(said, t.keys, posted, packages, teams=False), teams)
    return base.Context(inputs, CFG, candidates, candidate_keys(candidates, t.keys), packages, posted)


@check("contributor_rank", """
SELECT a.person_id, r.repo, max(r.commits) AS commits, min(r.rank) AS rank, max(r.n) AS n_fetched
FROM (SELECT repo, login, commits, rank() OVER (PARTITION BY repo ORDER BY commits DESC) AS rank,
             count(*) OVER (PARTITION BY repo) AS n FROM b_roster) r
JOIN b_acc a USING (login) GROUP BY a.person_id, r.repo""")
def contributor_rank(t):
    return roster.standings(t.roster, t.handles, None).drop("forge")


@check("classify_contributor", """
SELECT * FROM (SELECT person_id, repo, commits, rank, CAST(
  CASE WHEN commits >= 100 THEN 0.8 WHEN commits >= 25 THEN 0.6
       WHEN commits >= 10 AND rank <= 10 THEN 0.8 END AS DOUBLE) AS confidence FROM b_standing)
WHERE confidence IS NOT NULL""")
def classify_contributor(t):
    return roster.standings(t.roster, t.handles, CFG.contributor_pages).select(
        "person_id", "repo", "commits", "rank",
        roles.contributor_confidence(F.col("commits"), F.col("rank")).alias("confidence")).where(
        "confidence IS NOT NULL")


# Rosters of whole brands: customers as contributors, long enough to reach the page cap.
view("b_brand_commits", """
SELECT lower(replace(p.p_brand, '#', '')) || '/all' AS repo, 'c' || o.o_custkey AS login,
       'c' || o.o_custkey || '-' || (l.l_linenumber % 2) AS identity,
       CAST(substr(p.p_brand, 7) AS BIGINT) AS brand
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""")
view("b_brand_roster", """
SELECT repo, login, count(*) AS commits FROM b_brand_commits GROUP BY 1, 2""")


def brand_commits(t):
    brand = F.regexp_replace("p_brand", "[^0-9]", "").cast("bigint")
    login = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
            .select(F.lit("github").alias("forge"),
                    F.concat(F.lit("brand"), brand.cast("string"), F.lit("/all")).alias("repo"),
                    login.alias("login"), F.concat(login, F.lit("-"), (F.col("l_linenumber") % 2)
                                                   .cast("string")).alias("author_identity"),
                    brand.alias("brand")))


def brand_roster(t):
    return brand_commits(t).groupBy("forge", "repo", "login").agg(
        F.count(F.lit(1)).alias("commits"))


@check("capped_roster", """
SELECT repo, login, commits, rank() OVER (PARTITION BY repo ORDER BY commits DESC) AS rank,
       count(*) OVER (PARTITION BY repo) AS n_fetched
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, login) AS i
      FROM b_brand_roster) WHERE i <= 200""")
def capped_roster(t):
    return roster.ranked_roster(brand_roster(t), 2).drop("forge")


@check("true_contributor_total", """
SELECT repo, count(DISTINCT identity) AS true_total FROM b_brand_commits GROUP BY repo""")
def true_contributor_total(t):
    return roster.true_totals(brand_commits(t)).drop("forge")


@check("contributor_total", """
SELECT repo, CASE WHEN snap > 0 THEN snap WHEN n < 200 THEN n WHEN total >= n THEN total ELSE n END
         AS n_contributors,
       NOT coalesce(snap > 0, FALSE) AND n >= 200 AND NOT coalesce(total >= n, FALSE) AS capped,
       coalesce(snap > 0, FALSE) OR (n >= 200 AND coalesce(total >= n, FALSE)) AS approx
FROM (SELECT f.repo, f.n, CASE WHEN f.brand % 5 = 0 THEN f.brand + 400 END AS snap,
             CASE WHEN f.brand % 3 <> 0 THEN d.total END AS total
      FROM (SELECT repo, least(count(*), 200) AS n,
                   CAST(regexp_extract(repo, '[0-9]+') AS BIGINT) AS brand
            FROM b_brand_roster GROUP BY repo) f
      JOIN (SELECT repo, count(DISTINCT identity) AS total FROM b_brand_commits GROUP BY repo) d
      USING (repo))""")
def contributor_total(t):
    brand = F.regexp_extract("repo", "[0-9]+", 0).cast("bigint")
    fetched = roster.ranked_roster(brand_roster(t), 2).groupBy("forge", "repo").agg(
        F.max("n_fetched").alias("n_fetched"))
    total = roster.true_totals(brand_commits(t)).withColumn("true_total", F.when(brand % 3 != 0, F.col("true_total")))
    df = fetched.join(total, ["forge", "repo"], "left").withColumn(
        "snapshot", F.when(brand % 5 == 0, brand + 400))
    return roster.contributor_total(df, 2).select("repo", "n_contributors", "capped", "approx")


_EARNED = """
SELECT person_id, repo, commits, rank, n_fetched AS n_contributors, CAST(conf AS DOUBLE) AS confidence,
       CASE WHEN base IS NULL AND by_pr IS NOT NULL
            THEN prs || ' merged PRs (' || commits || ' commits, ~#' || rank || ')'
            ELSE commits || ' commits (~#' || rank || ' contributor)' END AS detail
FROM (SELECT *, coalesce(base, by_pr, CASE WHEN manual THEN 0.4 END) AS conf FROM (
  SELECT c.*, coalesce(p.prs, 0) AS prs,
         CASE WHEN commits >= 100 THEN 0.8 WHEN commits >= 25 THEN 0.6
              WHEN commits >= 10 AND rank <= 10 THEN 0.8 END AS base,
         CASE WHEN manual THEN CASE WHEN p.prs >= 100 THEN 0.8 WHEN p.prs >= 25 THEN 0.6
              WHEN p.prs >= 10 AND rank <= 10 THEN 0.8 WHEN p.prs >= 5 THEN 0.65 END END AS by_pr
  FROM b_cand c LEFT JOIN b_prs p USING (person_id, repo)
  WHERE (manual OR stars >= 50 OR forks >= 25) AND commits > 0 AND n_fetched > 1
    AND (trusted OR genuine OR (NOT is_fork AND forks >= 25 AND rank = 1))))
WHERE conf IS NOT NULL"""
view("b_earned", _EARNED)


@check("contributor_evidence", """
SELECT person_id, repo, commits AS contributions, rank, n_contributors, confidence, detail,
       'https://github.com/' || repo || '/graphs/contributors' AS url FROM (
  SELECT e.* EXCLUDE (n_contributors), coalesce(k.snapshot, e.n_contributors) AS n_contributors
  FROM b_earned e LEFT JOIN b_known k USING (repo))""")
def contributor_evidence(t):
    return ev.contributors(context(t)).select(
        "person_id", "repo", "contributions", "rank", "n_contributors", "confidence", "detail", "url")


@check("rank_rescue", """
SELECT person_id, repo, commits, rank, n_fetched FROM b_cand
WHERE NOT trusted AND NOT genuine AND NOT is_fork AND forks >= 25 AND rank = 1
  AND commits > 0 AND n_fetched > 1 AND (commits >= 25 OR (commits >= 10 AND rank <= 10))""")
def rank_rescue(t):
    # Whoever has a rank is named by a roster.
    untrusted = context(t).candidates.where("NOT trusted AND NOT genuine")
    return ev.contributor_roles(untrusted, None, CFG).select(
        "person_id", "repo", "commits", "rank", "n_fetched")


@check("ownership_evidence", """
SELECT person_id, repo, 'author' AS role, CAST(0.9 AS DOUBLE) AS confidence,
       'https://github.com/' || repo AS url
FROM b_cand WHERE owns AND NOT is_fork AND commits IS NOT NULL""")
def ownership_evidence(t):
    return ev.ownership(context(t)).select("person_id", "repo", "role", "confidence", "url")


# Commits that touch files below a type directory.
view("b_touched", """
SELECT lower(replace(p.p_brand, '#', '')) || '/mono' AS repo, 's' || l.l_suppkey AS login,
       l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_suppkey AS sha,
       lower(p.p_type) AS dir, lower(p.p_type) || '/' || replace(p.p_name, ' ', '/') || '/' || p.p_size
         AS path FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""")


def touched(t):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    text = lambda c: F.col(c).cast("string")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("github").alias("forge"), F.concat(brand, F.lit("/mono")).alias("repo"),
        t.login(F.col("l_suppkey")).alias("login"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_suppkey")).alias("sha"),
        F.concat_ws("/", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("/")),
                    text("p_size")).alias("path"))


@check("path_commits", """
SELECT person_id, repo, path, n, CAST(
  CASE WHEN n >= 50 THEN 0.85 WHEN n >= 15 THEN 0.7 WHEN n >= 5 THEN 0.55 END AS DOUBLE) AS confidence
FROM (SELECT a.person_id, repo, path, max(n) AS n FROM (
        SELECT repo, dir AS path, login, count(DISTINCT sha) AS n FROM b_touched GROUP BY 1, 2, 3
        UNION ALL
        SELECT repo, dir || '/red', login, count(DISTINCT sha) FROM b_touched
        WHERE path LIKE dir || '/red/%' GROUP BY 1, 2, 3) JOIN b_acc a USING (login)
      GROUP BY a.person_id, repo, path)""")
def path_commits(t):
    commits = touched(t)
    targets = t.part.select(
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/mono")).alias("repo"),
        F.explode(F.array(F.lower("p_type"), F.concat(F.lower("p_type"), F.lit("/red")))).alias("path"))
    n = roster.path_standings(roster.path_commits(commits, targets), t.handles, CFG.path_commit_cap)
    return n.select("person_id", "repo", "path", "n",
                    roles.path_confidence(F.col("n")).alias("confidence"))


view("b_releases", """
SELECT lower(replace(p.p_brand, '#', '')) || '/all' AS repo,
       's' || l.l_suppkey || CASE WHEN l.l_suppkey % 10 = 0 THEN '[bot]' ELSE '' END AS author,
       o.o_orderdate AS published, (o.o_orderkey * 10 + l.l_linenumber) * 100000 + l.l_suppkey AS seq
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN part p ON p.p_partkey = l.l_partkey""")


def releases(t):
    login = t.login(F.col("l_suppkey"))
    return (t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("github").alias("forge"),
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/all")).alias("repo"),
        F.when(F.col("l_suppkey") % 10 == 0, F.concat(login, F.lit("[bot]"))).otherwise(login)
         .alias("author_login"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        ((F.col("o_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey"))
        .alias("seq")))


@check("release_standing", """
SELECT a.person_id, h.repo, CAST(sum(h.n) AS BIGINT) AS mine, CAST(max(h.total) AS BIGINT) AS total,
       CASE WHEN sum(h.n) >= 2 THEN round(least(CAST(0.9 AS DOUBLE), CAST(0.55 AS DOUBLE)
         + CAST(0.35 AS DOUBLE) * (CAST(sum(h.n) AS DOUBLE) / max(h.total))), 2) END AS confidence
FROM (SELECT repo, author AS login, count(*) AS n, sum(count(*)) OVER (PARTITION BY repo) AS total
      FROM b_releases WHERE NOT regexp_matches(author, '(?i)\\[bot\\]$')
      GROUP BY repo, author) h JOIN b_acc a USING (login) GROUP BY a.person_id, h.repo""")
def release_standing(t):
    s = roster.release_standings(releases(t), t.handles, CFG.last_releases)
    return s.select("person_id", "repo", "mine", "total",
                    roles.release_confidence(F.col("mine"), F.col("total")).alias("confidence"))


@check("merged_pull_requests", """
SELECT repo, login, count(*) AS prs FROM b_items WHERE l_linestatus = 'F' GROUP BY repo, login""")
def merged_pull_requests(t):
    return roster.merged_pull_requests(t.pull_requests).drop("forge")
