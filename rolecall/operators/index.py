"""Reverse index login -> projects, and the crawl frontier that feeds it.

The index is kept long, one row per (login, project): a bot with a third of all
rows stays many small rows instead of one huge array.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

REPO = ["forge", "repo"]


def build_index(roster: DataFrame, min_commits: int = 15) -> DataFrame:
    """(login, repo) of substantial contributors."""
    return (roster.where(F.col("commits") >= min_commits)
            .select(F.lower("login").alias("login"), "repo").where("login <> ''").distinct())


def merge_index(old: DataFrame, fresh: DataFrame, batch: int) -> DataFrame:
    """The old index with unseen entries appended as one more batch.

    A login's projects in order are: by batch, then by name.
    """
    new = fresh.join(old.select("login", "repo"), ["login", "repo"], "left_anti")
    return old.select("login", "repo", "batch").unionByName(
        new.select("login", "repo", F.lit(batch).cast("bigint").alias("batch")))


def lookup(index: DataFrame, handles: DataFrame) -> DataFrame:
    """(person_id, repo) the index knows for a person's logins."""
    return index.join(handles, "login").select("person_id", "repo").distinct()


# --- crawl frontier --------------------------------------------------------
def due_repos(repos: DataFrame, runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Repositories without a refresh within the last `days`."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    fresh = runs.where(F.col("seeded_at") > since).select("repo").distinct()
    return repos.join(fresh, "repo", "left_anti")


def crawl_frontier(repos: DataFrame, runs: DataFrame, as_of: str, *, days: int = 30,
                   budget: int | None = None, considered: int | None = None) -> DataFrame:
    """Per organisation, its due repositories, the most-starred first.

    `considered` looks only at that many of an organisation, `budget` takes only so many.
    """
    stars_first = W.partitionBy("org").orderBy(F.desc_nulls_last("stars"), "repo")
    top = repos.select(F.lower("owner").alias("org"), "repo", "stars")
    if considered is not None:
        top = (top.withColumn("_n", F.row_number().over(stars_first))
               .where(F.col("_n") <= considered).drop("_n"))
    due = due_repos(top, runs, as_of, days).withColumn("position", F.row_number().over(stars_first))
    return due if budget is None else due.where(F.col("position") <= budget)


def coverage(runs: DataFrame, roster: DataFrame, min_commits: int = 15) -> DataFrame:
    """(org, repos_distinct, contributors_distinct) over all refresh runs."""
    seen = runs.select("org", "repo").distinct()
    logins = (seen.join(build_index(roster, min_commits), "repo").select("org", "login").distinct()
              .groupBy("org").agg(F.count(F.lit(1)).alias("contributors_distinct")))
    return (seen.groupBy("org").agg(F.count(F.lit(1)).alias("repos_distinct"))
            .join(logins, "org", "left")
            .withColumn("contributors_distinct", F.coalesce("contributors_distinct", F.lit(0))))


def targets_status(targets: DataFrame, log: DataFrame) -> DataFrame:
    """Refresh targets in list order with what the log knows about them."""
    known = log.select(F.col("target").alias("org"), "repos", "contributors", "updated",
                       F.lit(True).alias("seeded"))
    return targets.join(known, "org", "left").select(
        "pos", "org", F.coalesce("seeded", F.lit(False)).alias("seeded"),
        F.coalesce("repos", F.lit(0)).alias("repos"),
        F.coalesce("contributors", F.lit(0)).alias("contributors"), "updated")


def next_targets(status: DataFrame, n: int = 1) -> DataFrame:
    """Never-refreshed targets first, in list order; then the longest ago."""
    return status.orderBy(F.asc("seeded"), F.asc_nulls_first("updated"), "pos").limit(n)


def fold_log(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The refresh log after more runs: first seen, last run, coverage that never shrinks."""
    cols = ["forge", "kind", "target", "repos", "contributors", "created", "updated"]
    return log.select(cols).unionByName(runs.select(cols)).groupBy(
        F.lower("forge").alias("forge"), F.lower("kind").alias("kind"),
        F.lower("target").alias("target")).agg(
        F.max("repos").alias("repos"), F.max("contributors").alias("contributors"),
        F.min("created").alias("created"), F.max("updated").alias("updated"))
