"""Contributor rosters: caps, competition ranks, totals and path commits."""

from pyspark.sql import DataFrame, Window as W, functions as F

REPO = ["forge", "repo"]


def cap_roster(roster: DataFrame, pages: int | None) -> DataFrame:
    """The contributors a host lists: the top pages x 100 by commits.

    The rank filter is pushed below the shuffle, so a project with a third of all
    rows still sends at most pages x 100 rows from each task.
    """
    low = roster.select(*REPO, F.lower("login").alias("login"), "commits").where("login <> ''")
    if pages is None:
        return low
    w = W.partitionBy(*REPO).orderBy(F.desc("commits"), "login")
    return low.withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= pages * 100).drop("_n")


def commit_ranks(roster: DataFrame) -> DataFrame:
    """(forge, repo, commits, rank, n): competition rank of each commit count.

    Rows are first counted per distinct commit count.  d distinct counts need at
    least d*(d+1)/2 commits, so even a project with 10^9 commits leaves fewer than
    45,000 rows for the ordered window, however many contributors it has.
    """
    counts = roster.groupBy(*REPO, "commits").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*REPO).orderBy(F.desc("commits"))
    above = F.sum("m").over(w.rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("m").over(W.partitionBy(*REPO).orderBy(F.desc("commits"))
                            .rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.select(*REPO, "commits", (F.coalesce(above, F.lit(0)) + 1).alias("rank"),
                         total.alias("n_fetched"))


def ranked_roster(roster: DataFrame, pages: int | None) -> DataFrame:
    """Roster rows with competition rank and number of contributors listed."""
    if pages is None:
        low = cap_roster(roster, None)
        return low.join(commit_ranks(low), [*REPO, "commits"])
    capped = cap_roster(roster, pages)      # at most pages x 100 rows per project
    return capped.select(
        "*", F.rank().over(W.partitionBy(*REPO).orderBy(F.desc("commits")))
              .cast("bigint").alias("rank"),
        F.count(F.lit(1)).over(W.partitionBy(*REPO)).alias("n_fetched"))


def standings(roster: DataFrame, handles: DataFrame, pages: int | None) -> DataFrame:
    """(person_id, forge, repo, commits, rank, n_fetched).

    The largest count of a person's logins counts, not their sum.
    """
    if pages is None:
        low = cap_roster(roster, None)
        mine = (low.join(handles, "login").groupBy("person_id", *REPO)
                .agg(F.max("commits").alias("commits")))
        return mine.join(commit_ranks(low), [*REPO, "commits"]).select(
            "person_id", *REPO, "commits", "rank", "n_fetched")
    return (ranked_roster(roster, pages).join(handles, "login").groupBy("person_id", *REPO)
            .agg(F.max("commits").alias("commits"), F.min("rank").alias("rank"),
                 F.max("n_fetched").alias("n_fetched")))


def true_totals(commits: DataFrame) -> DataFrame:
    """Distinct commit-author identities per project, uncapped."""
    return commits.groupBy(*REPO).agg(
        F.countDistinct("author_identity").alias("true_total"))


def contributor_total(df: DataFrame, pages: int | None) -> DataFrame:
    """Add (n_contributors, capped, approx) from n_fetched, snapshot and true_total.

    A curated snapshot wins (approximate); a list below the page cap is exact;
    else the true total (approximate), else the list length as a lower bound.
    """
    snap = F.coalesce(F.col("snapshot") > 0, F.lit(False))
    whole = F.lit(True) if pages is None else F.col("n_fetched") < max(1, pages) * 100
    resolved = F.coalesce((F.col("true_total") > 0)
                          & (F.col("true_total") >= F.col("n_fetched")), F.lit(False))
    return df.select(
        "*",
        F.when(snap, F.col("snapshot")).when(whole, F.col("n_fetched"))
         .when(resolved, F.col("true_total")).otherwise(F.col("n_fetched"))
         .cast("bigint").alias("n_contributors"),
        (~snap & ~whole & ~resolved).alias("capped"),
        (snap | (~whole & resolved)).alias("approx"))


def path_commits(commits: DataFrame, targets: DataFrame) -> DataFrame:
    """(forge, repo, path, login, n): distinct commits below each target path.

    A commit row names one touched file; its parent directories are listed in the
    row, so "below a directory" is an equi-join and not a prefix scan.
    """
    wanted = targets.select("repo", "path").distinct()
    # Only projects and depths that have a target are listed out.
    depths = wanted.groupBy("repo").agg(F.collect_set(F.size(F.split("path", "/"))).alias("depths"))
    deep = F.size(F.split("path", "/"))
    own = F.transform(F.filter("depths", lambda d: d <= deep),
                      lambda d: F.call_function("substring_index", F.col("path"), F.lit("/"), d))
    touched = commits.where("path IS NOT NULL AND login <> ''").join(depths, "repo").select(
        *REPO, F.lower("login").alias("login"), "sha", F.explode(own).alias("path"))
    return (touched.join(wanted, ["repo", "path"])
            .groupBy(*REPO, "path", "login").agg(F.countDistinct("sha").alias("n")))


def path_standings(counts: DataFrame, handles: DataFrame, cap: int | None = None) -> DataFrame:
    """Commits of a person to a path: largest of their logins, up to `cap` if one is given."""
    n = F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap))
    return (counts.join(handles, "login").groupBy("person_id", *REPO, "path")
            .agg(F.max(n).cast("bigint").alias("n")))


def merged_pull_requests(pull_requests: DataFrame) -> DataFrame:
    """(forge, repo, login, prs): merged pull requests per login."""
    return (pull_requests.where("merged").groupBy(*REPO, F.lower("login").alias("login"))
            .agg(F.count(F.lit(1)).alias("prs")))


def last_releases(releases: DataFrame, last: int | None = None) -> DataFrame:
    """The newest releases of each project, all of them without a number."""
    if last is None:
        return releases
    w = W.partitionBy(*REPO).orderBy(F.desc("published_at"), F.desc("seq"))
    return releases.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)


def release_counts(releases: DataFrame, last: int | None = None) -> DataFrame:
    """(forge, repo, login, n, total): human releases among the last ones."""
    from ..functions.roles import is_bot
    human = (last_releases(releases, last)
             .where(F.col("author_login").isNotNull() & (F.col("author_login") != "")
                    & ~is_bot(F.col("author_login")))
             .groupBy(*REPO, F.lower("author_login").alias("login"))
             .agg(F.count(F.lit(1)).alias("n")))
    return human.join(human.groupBy(*REPO).agg(F.sum("n").alias("total")), REPO)


def release_standings(releases: DataFrame, handles: DataFrame, last: int | None = None) -> DataFrame:
    """(person_id, forge, repo, mine, total) over the last releases, bots left out."""
    return (release_counts(releases, last).join(handles, "login").groupBy("person_id", *REPO)
            .agg(F.sum("n").alias("mine"), F.max("total").alias("total")))
