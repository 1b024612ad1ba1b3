"""From evidence rows to one scored record per person and project."""

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import fixed
from ..functions import roles

KEY = ["person_id", "forge", "repo"]


def strength(role: Column, confidence: Column, ord_: Column) -> Column:
    """Sort key of evidence: weight x confidence, then weight, then input order."""
    w = roles.role_weight(role)
    return F.struct((w * confidence).alias("wc"), w.alias("w"), (-ord_).alias("o"))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The strongest supported claim of each person and project."""
    return evidence.groupBy(*KEY).agg(F.max_by(
        F.struct("role", "confidence", "source", "url"),
        strength(F.col("role"), F.col("confidence"), F.col("ord"))).alias("b")).select(
        *KEY, "b.role", "b.confidence", "b.source", "b.url")


def score_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (person, forge, repo) with an elevated role.

    All measures come from one aggregate over the evidence.  The (role, source)
    set has at most roles x evidence operators members, so it stays small however
    many scopes a file credits.
    """
    standing = (F.col("rank") > 0) & (F.col("n_contributors") > 0)
    commits = F.when(F.col("contributions") > 0, F.col("contributions"))
    whole = F.when(F.coalesce(F.col("qualifier"), F.lit("")) == "", commits)
    g = evidence.groupBy(*KEY).agg(
        F.max_by(F.struct("role", "confidence", "source", "url"),
                 strength(F.col("role"), F.col("confidence"), F.col("ord"))).alias("b"),
        F.collect_set(F.struct("role", "source")).alias("pairs"),
        F.coalesce(F.max(whole), F.max(commits)).alias("contributions"),
        F.min_by(F.struct("rank", "n_contributors", "capped", "approx"),
                 F.when(standing, F.col("ord"))).alias("s"),
        F.bool_or(~roles.is_weak(F.col("role"))).alias("elevated"))
    return g.where("elevated").select(
        *KEY, F.col("b.role").alias("role"), F.col("b.confidence").alias("best_confidence"),
        F.col("b.source").alias("best_source"), F.col("b.url").alias("best_url"),
        role_list(F.col("pairs")).alias("roles"),
        record_confidence(F.col("b.confidence"), F.size(F.filter(
            "pairs", lambda p: p["role"] == F.col("b.role")))).alias("confidence"),
        "contributions", "s.rank", "s.n_contributors", "s.capped", "s.approx")


def role_list(pairs: Column) -> Column:
    """Distinct elevated roles in display order; unknown ones last, by name."""
    named = F.array_distinct(F.transform(
        F.filter(pairs, lambda p: ~roles.is_weak(p["role"])),
        lambda p: F.struct(roles.role_order(p["role"]).alias("o"), p["role"].alias("role"))))
    return F.transform(F.array_sort(named), lambda r: r["role"])


def record_confidence(best: Column, sources: Column) -> Column:
    """Confidence of the best claim, a little more for each further source of its role."""
    return F.least(F.lit(0.99), best + F.lit(0.05) * (sources - 1))


#: Whole numbers below it have the C library's logarithm; no project is so popular.
_EXACT = 1 << 20


@cache
def _differing() -> tuple[str, str]:
    """The whole numbers whose logarithms differ between the JVM and the C library, one in some 370, and
    the latter's."""
    jvm = SparkSession.active().range(1, _EXACT, 1, 8).select(F.log10(F.col("id").cast("double")).alias("v")).toArrow()["v"].to_pylist()
    at = [n for n, v in enumerate(jvm, 1) if v != math.log10(n)]
    return " ".join(map(str, at)), " ".join(repr(math.log10(n)) for n in at)


def log10(x: Column) -> Column:
    """The C library's logarithm of a whole number.

    The JVM's differs from it in the last bit (at 1414, say), and that bit orders records whose scores are equal on paper.
    """
    at, logs = _differing()
    listed = lambda text, t: F.split(F.lit(text), " ").cast(f"array<{t}>")      # folded to a constant
    place = F.array_position(listed(at, "bigint"), x.cast("bigint"))
    return F.when((place > 0) & (x == F.floor(x)), F.try_element_at(listed(logs, "double"), place.cast("int"))).otherwise(F.log10(x))


def record_score(popularity: Column, role: Column, confidence: Column) -> Column:
    return log10(popularity + 10) * roles.role_weight(role) * confidence


def to_records(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored rows with the standing of their project.

    The standing is one row a candidate, or one a (forge, repo) where it is the same for all persons.
    """
    on = [k for k in KEY if k in candidates.columns]
    c = candidates.select(*on, F.col("project_url").alias("url"), "stars", "forks", "pushed_at",
                          "has_stars", "importance", "override", "manual")
    return with_score(scored.join(c, on))


def with_score(records: DataFrame) -> DataFrame:
    """Records with the popularity of their project and their score."""
    pop = roles.popularity(F.col("stars"), F.col("forks"), F.col("has_stars"))
    return (records.withColumn("popularity", pop)
            .withColumn("score", record_score(F.col("popularity"), F.col("role"),
                                              F.col("confidence"))))


def enrich_stars(records: DataFrame, meta: DataFrame) -> DataFrame:
    """Records without stars take stars and forks, and a known push date, from `meta`."""
    m = meta.select("forge", "repo", F.coalesce("stars", F.lit(0)).alias("m_stars"),
                    F.coalesce("forks", F.lit(0)).alias("m_forks"), F.col("pushed_at").alias("m_at"))
    stale = F.col("stars") == 0
    pick = lambda new, old: F.when(stale, F.coalesce(new, old)).otherwise(F.col(old))
    return (records.join(m, ["forge", "repo"], "left")
            .withColumns({"stars": pick("m_stars", "stars"), "forks": pick("m_forks", "forks"),
                          "pushed_at": pick("m_at", "pushed_at")})
            .drop("m_stars", "m_forks", "m_at"))


def split_tiers(records: DataFrame, min_stars: int, as_of: str) -> DataFrame:
    """Add `tier`: primary, secondary or dropped."""
    pop, forks, role = F.col("popularity"), F.col("forks"), F.col("role")
    primary = (F.col("manual") | (pop >= min_stars) | F.col("override")
               | roles.is_high_signal(role, F.col("confidence"), pop, min_stars))
    secondary = (roles.is_widely_used(pop, forks, F.col("pushed_at"), as_of, min_stars)
                 | roles.is_notable_authored(role, pop, forks))
    return records.withColumn("tier", F.when(primary, "primary").when(secondary, "secondary")
                              .otherwise("dropped"))


def resplit(records: DataFrame, min_stars: int, as_of: str) -> DataFrame:
    """Stored records split again at another threshold; nothing is collected anew."""
    return split_tiers(records.drop("tier"), min_stars, as_of)


def dedupe_records(records: DataFrame, forge_order: list[str]) -> DataFrame:
    """One record per person and URL, the first host winning."""
    pos = F.array_position(F.lit(forge_order), F.col("forge"))
    pos = F.when(pos == 0, F.lit(len(forge_order) + 1)).otherwise(pos)
    w = W.partitionBy("person_id", "url").orderBy(pos, "forge", "repo")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def below_bar(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person_id, n): genuine contributions that earned no elevated role."""
    earned = evidence.where(~roles.is_weak(F.col("role"))).select(*KEY).distinct()
    return (candidates.where("genuine").join(earned, KEY, "left_anti")
            .groupBy("person_id").agg(F.count(F.lit(1)).alias("n")))


def top_records(records: DataFrame, n: int) -> DataFrame:
    """The n best-scored records of each person with their position."""
    w = W.partitionBy("person_id").orderBy(F.desc("score"), "repo")
    return records.withColumn("position", F.row_number().over(w)).where(
        F.col("position") <= max(1, n))


def reach(records: DataFrame, people: DataFrame) -> DataFrame:
    """Projects and distinct communities (owners other than the person) of each person."""
    owner = F.substring_index("repo", "/", 1)
    r = records.join(people.select("person_id", F.lower("primary_login").alias("self")), "person_id")
    # Owners are counted in two steps so that no task holds all owners of a person.
    by_owner = r.groupBy("person_id", "self", owner.alias("owner")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("contributions", F.lit(0))).alias("c"))
    return by_owner.groupBy("person_id").agg(
        F.sum("n").alias("projects"),
        F.count_if(F.lower("owner") != F.col("self")).alias("communities"),
        F.sum("c").alias("total_commits"))
