"""Evidence from enhancement-proposal series: numbered documents with an author field."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ... import fixed
from ...functions import urls
from ...functions.text import blank_to_null, matches
from ...schemas import Inputs
from ..postings import Postings
from .base import REPO, Context, emit, register


def is_markup_name(name: Column) -> Column:
    return matches(F.lower(name), r"\.(rst|md)$")


def is_series_entry(name: Column) -> Column:
    """A numbered document, or a directory-like name that is one 3-4 digit number."""
    digits = F.regexp_replace(name, r"\D", "")
    return matches(name, r"\d{3,4}") & (
        is_markup_name(name) | (matches(digits, r"^\d{3,4}$") & ~name.contains(".")))


def proposal_dirs(entries: DataFrame) -> DataFrame:
    """(forge, repo, dir, header_format) of directories that look like a series."""
    low = F.lower("name")
    return (entries.groupBy(*REPO, "dir").agg(
        F.count_if(is_series_entry(F.col("name"))).alias("n"),
        F.count_if(low.endswith(".rst")).alias("rst"), F.count_if(low.endswith(".md")).alias("md"))
        .where("n >= 3")
        .select(*REPO, "dir", F.when(F.col("rst") >= F.col("md"), "rst").otherwise("yaml")
                .alias("header_format")))


def proposal_plans(entries: DataFrame, conventions: DataFrame) -> DataFrame:
    """(forge, repo, pos, dir, header_format): which series to read, in order.

    `conventions` is keyed by lower-cased spelling; a project that has any is not
    searched for series.
    """
    dirs = entries.select(*REPO, "dir").distinct().withColumn("key", F.lower("repo"))
    curated = dirs.join(conventions.select(
        "key", "pos", F.coalesce(blank_to_null(F.col("path")), F.lit(".")).alias("dir"),
        F.coalesce(blank_to_null(F.col("header_format")), F.lit("rst")).alias("header_format")),
        ["key", "dir"]).select(*REPO, "pos", "dir", "header_format")
    detected = (proposal_dirs(entries.where(F.col("dir").isin(fixed.PROPOSAL_DIRS)))
                .withColumn("key", F.lower("repo"))
                .join(conventions.select("key").distinct(), "key", "left_anti")
                .select(*REPO, F.array_position(F.lit(fixed.PROPOSAL_DIRS), F.col("dir"))
                        .cast("int").alias("pos"), "dir", "header_format"))
    return curated.unionByName(detected)


def proposal_docs(plans: DataFrame, entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(…, n, path): documents of each series in listing order, the first `limit` if one is given."""
    prefix = F.when(F.col("dir").isin("", "."), "").otherwise(F.concat("dir", F.lit("/")))
    inside = F.transform(F.lit(fixed.PROPOSAL_INDEX_FILES),
                         lambda f: F.concat(F.col("name"), F.lit("/"), f))
    listed = (entries.where(matches(F.col("name"), r"\d{3,4}")
                            & (F.col("is_dir") | is_markup_name(F.col("name"))))
              .join(plans, [*REPO, "dir"])
              .select(*REPO, "pos", "dir", "header_format", "name", F.posexplode(
                  F.when(F.col("is_dir"), inside).otherwise(F.array("name"))).alias("i", "rel"))
              .select(*REPO, "pos", "header_format", "name", "i",
                      F.concat(prefix, "rel").alias("path")))
    w = W.partitionBy(*REPO, "pos").orderBy("name", "i")
    placed = listed.withColumn("n", F.row_number().over(w)).drop("name", "i")
    return placed if limit is None else placed.where(F.col("n") <= limit)


def series_docs(inputs: Inputs, limit: int | None = None) -> DataFrame:
    """`proposal_docs` of every series of the snapshot."""
    from .. import registry
    conv = registry.for_candidates(
        inputs.role_conventions.where("extractor = 'enhancement_proposals'"),
        inputs.known, inputs.known_aliases)
    return proposal_docs(proposal_plans(inputs.dir_entries, conv), inputs.dir_entries, limit)


def proposal_authorship(docs: DataFrame, posted: Postings, keys: DataFrame) -> DataFrame:
    """Per person and project, the first series with proposals of that person."""
    read = posted.rows("proposal rst", "proposal yaml").select(
        *REPO, "path", F.substring_index("parser", " ", -1).alias("header_format"), "kind", "key")
    hits = (docs.join(read, [*REPO, "path", "header_format"])
            .select(*REPO, "pos", "n", "path", "kind", "key")
            .join(keys, [*REPO, "kind", "key"])
            .groupBy("person_id", *REPO, "project_url", "pos", "n", "path")
            .agg(F.min(F.when(F.col("kind") == "name", 1).otherwise(0)).alias("weak")))
    group = ["person_id", *REPO, "project_url", "pos"]
    # Only the first five are named, whatever the length of a series.
    first = (hits.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("n", "path")))
             .where("_n <= 5").groupBy(*group)
             .agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("listed")))
    series = (hits.groupBy(*group).agg(F.count(F.lit(1)).alias("docs"), F.max("weak").alias("weak"))
              .join(first, group))
    return (series.groupBy("person_id", *REPO, "project_url")
            .agg(F.min_by(F.struct("docs", "weak", "listed"), "pos").alias("s"))
            .select("person_id", *REPO, "project_url", "s.*")
            .withColumn("confidence", F.when((F.col("weak") == 1) & (F.col("docs") == 1), F.lit(0.5))
                        .otherwise(0.85))
            .withColumn("path", F.element_at("listed", 1)["path"])
            .withColumn("detail", authorship_detail(F.col("docs"), F.col("listed"))))


def authorship_detail(docs: Column, listed: Column) -> Column:
    first = F.array_join(F.transform(F.slice(listed, 1, 5),
                                     lambda d: F.substring_index(d["path"], "/", -1)), ", ")
    more = F.when(docs > 5, F.concat(F.lit(" (+"), (docs - 5).cast("string"), F.lit(" more)"))) \
            .otherwise("")
    return F.concat(F.lit("author of "), docs.cast("string"), F.lit(" proposal(s): "), first, more)


@register("enhancement_proposals")
def enhancement_proposals(ctx: Context):
    found = proposal_authorship(series_docs(ctx.inputs, ctx.cfg.proposals_per_series), ctx.postings, ctx.keys)
    return emit(found, "enhancement_proposals", role="standards_author",
                url=urls.file_url(F.col("project_url"), F.col("path")),
                confidence=F.col("confidence"), detail=F.col("detail"))
