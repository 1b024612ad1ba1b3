"""Curated projects: lookup with aliases, upserts, dedup of role pages."""

from pyspark.sql import DataFrame, functions as F


def known_keys(known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, known_repo): every lower-cased spelling of a curated project."""
    own = known.select(F.lower("repo").alias("key"), F.col("repo").alias("known_repo"))
    alt = aliases.select(F.lower("alias").alias("key"), F.col("repo").alias("known_repo"))
    return own.unionByName(alt).groupBy("key").agg(F.max("known_repo").alias("known_repo"))


def with_known(df: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Left join of the registry: known_repo, importance, snapshot, override, wikipedia."""
    facts = known_keys(known, aliases).join(known.select(
        F.col("repo").alias("known_repo"), "importance",
        F.col("contributors").alias("snapshot"),
        F.coalesce("min_stars_override", F.lit(False)).alias("override"),
        F.nullif("wikipedia", F.lit("")).alias("wikipedia")), "known_repo")
    return (df.withColumn("key", F.lower("repo")).join(facts, "key", "left").drop("key")
            .withColumn("override", F.coalesce("override", F.lit(False))))


def for_candidates(child: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """A child table of the registry keyed by every spelling (column `key`)."""
    return child.withColumnRenamed("repo", "known_repo").join(
        known_keys(known, aliases), "known_repo")


def upsert_popularity(known: DataFrame, aliases: DataFrame, records: DataFrame) -> DataFrame:
    """Registry with the observed stars, forks and uncapped contributor totals.

    Existing projects keep what was not observed; unseen ones are added.
    """
    observed = (records.withColumn("key", F.lower("repo"))
                .join(known_keys(known, aliases), "key", "left")
                .groupBy(F.coalesce("known_repo", "repo").alias("repo"))
                .agg(F.max("stars").alias("new_stars"), F.max("forks").alias("new_forks"),
                     F.max(F.when(~F.col("capped"), F.col("n_contributors"))).alias("new_n")))
    return known.join(observed, "repo", "full_outer").select(
        "repo", "importance",
        F.coalesce("new_stars", "stars").alias("stars"),
        F.coalesce("new_forks", "forks").alias("forks"),
        F.coalesce("new_n", "contributors").alias("contributors"),
        "min_stars_override", "wikipedia")


def merge_role_sources(existing: DataFrame, discovered: DataFrame) -> DataFrame:
    """Role pages with the discovered ones appended, one row per (repo, url)."""
    both = existing.select("repo", "url", "role", "label", F.lit(0).alias("rank"), "pos").unionByName(
        discovered.where("url <> ''").select(
            "repo", "url", F.coalesce("role", F.lit("maintainer")).alias("role"), "label",
            F.lit(1).alias("rank"), "pos"))
    best = F.min_by(F.struct("role", "label"), F.struct("rank", "pos"))
    return both.groupBy("repo", "url").agg(best.alias("b")).select(
        "repo", "url", "b.role", "b.label")
