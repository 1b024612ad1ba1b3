"""Usage statistics over the scan log."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_DISTINCT = ("people", "repos", "orgs")
SKETCH_BITS = 14        # a standard error of about 0.8 %


def user_key() -> Column:
    return F.concat(F.lower("forge"), F.lit(":"), F.lower("username"))


def scans_per(scans: DataFrame, unit: str) -> DataFrame:
    """Scans per UTC calendar day or hour."""
    fmt = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}[unit]
    return (scans.groupBy(F.date_format(F.date_trunc(unit, "ts"), fmt).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("scans")))


def scanned_repos(scans: DataFrame) -> DataFrame:
    """(self, repo, owner) of every scanned project, folded."""
    return (scans.select(F.lower("username").alias("self"), F.explode("repos").alias("repo"))
            .withColumn("repo", F.lower("repo"))
            .withColumn("owner", F.substring_index("repo", "/", 1)).distinct())


def communities(scans: DataFrame) -> DataFrame:
    """Distinct owners, each scanned person's own account left out."""
    return scanned_repos(scans).where(F.col("repo").contains("/")
                                      & (F.col("owner") != F.col("self"))).select("owner").distinct()


def usage_totals(scans: DataFrame) -> DataFrame:
    """Total scans, distinct people, projects and communities, exactly."""
    none = F.lit(None).cast("bigint")
    base = scans.agg(F.count(F.lit(1)).alias("scans"), F.min("ts").alias("oldest"),
                     F.max("ts").alias("newest"))
    counts = [base.select("scans", "oldest", "newest", *[none.alias(c) for c in _DISTINCT])]
    for name, df in (("people", scans.select(user_key().alias("k")).distinct()),
                     ("repos", scanned_repos(scans).select("repo").distinct()),
                     ("orgs", communities(scans))):
        counts.append(df.agg(F.count(F.lit(1)).alias("n")).select(
            none.alias("scans"), F.lit(None).cast("timestamp").alias("oldest"),
            F.lit(None).cast("timestamp").alias("newest"),
            *[(F.col("n") if c == name else none).alias(c) for c in _DISTINCT]))
    return reduce(DataFrame.unionByName, counts).agg(
        *[F.max(c).alias(c) for c in ("scans", "oldest", "newest", *_DISTINCT)])


def usage_sketches(scans: DataFrame) -> DataFrame:
    """Mergeable sketches of the distinct people, projects and communities of each day."""
    day = F.to_date("ts").alias("day")
    people = scans.groupBy(day).agg(F.hll_sketch_agg(user_key(), SKETCH_BITS).alias("people"))
    seen = scans.select(day, F.lower("username").alias("self"), F.explode("repos").alias("repo")).select(
        "day", "self", F.lower("repo").alias("repo"))
    repos = seen.groupBy("day").agg(F.hll_sketch_agg("repo", SKETCH_BITS).alias("repos"))
    owner = F.substring_index("repo", "/", 1)
    orgs = (seen.where(F.col("repo").contains("/") & (owner != F.col("self")))
            .groupBy("day").agg(F.hll_sketch_agg(owner, SKETCH_BITS).alias("orgs")))
    return people.join(repos, "day", "left").join(orgs, "day", "left")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Estimates over all days, from the sketches alone."""
    return sketches.agg(
        F.hll_sketch_estimate(F.hll_union_agg("people")).alias("people"),
        F.hll_sketch_estimate(F.hll_union_agg("repos")).alias("repos"),
        F.hll_sketch_estimate(F.hll_union_agg("orgs")).alias("orgs"))


def recent_scans(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Most recently scanned users, one row each, newest first; the first `limit` if one is given."""
    rows = (scans.groupBy(F.lower("forge").alias("forge"), F.lower("username").alias("username"))
            .agg(F.max("ts").alias("created"), F.count(F.lit(1)).alias("scans"))
            .orderBy(F.desc("created"), "forge", "username"))
    return rows if limit is None else rows.limit(limit)


def latest_snapshots(results: DataFrame, version: int) -> DataFrame:
    """The newest complete result of each key, made by the current logic version."""
    rest = [c for c in results.columns if c != "key"]
    return (results.where((F.col("version") == version) & ~F.col("partial"))
            .groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts", "result_id")).alias("r"))
            .select("key", "r.*"))
