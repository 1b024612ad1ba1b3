"""Evidence from AUTHORS, THANKS and CONTRIBUTORS files."""

from pyspark.sql import Column, DataFrame, functions as F

from ... import fixed
from ...functions import display, urls
from ...functions.text import all_matches
from ..containment import contains_join
from ..postings import Postings
from .base import REPO, Context, emit, register


def credit_lines(posted: Postings) -> DataFrame:
    """(forge, repo, prio, path, line, credit, text): lines of all credit files."""
    prio = F.array_position(F.lit(fixed.CREDIT_PATHS), F.col("path"))
    return posted.rows("credits").where(F.col("path").isin(fixed.CREDIT_PATHS)).select(
        *REPO, prio.alias("prio"), "path", "line", F.col("text").alias("credit"),
        F.lower("text").alias("text"))


def find_credits(credit: DataFrame, keys: DataFrame) -> DataFrame:
    """The credit that counts for each person and project.

    The first path with any hit decides; in it a handle beats a name, and the
    first line of the (alphabetically first) name counts.
    """
    cols = [*REPO, "prio", "path", "line", "credit", "kind", "key"]
    by_handle = credit.select(
        *REPO, "prio", "path", "line", "credit", F.lit("handle").alias("kind"),
        F.explode(F.array_distinct(F.transform(
            all_matches(F.col("credit"), fixed.MENTION), F.lower))).alias("key"))
    wanted = keys.where("kind = 'name'").select(*REPO, F.col("key").alias("name")).distinct()
    by_name = (contains_join(credit, wanted, [*REPO, "prio", "path", "line"], on=REPO,
                             keep=["credit"])
               .withColumn("kind", F.lit("name")).withColumnRenamed("name", "key"))
    order = F.struct("prio", F.when(F.col("kind") == "handle", "").otherwise(F.col("key")), "line")
    return (by_handle.select(cols).unionByName(by_name.select(cols))
            .join(keys, [*REPO, "kind", "key"])
            .groupBy("person_id", *REPO, "project_url", "known_repo", "trusted", "commits")
            .agg(F.min_by(F.struct("path", "credit", (F.col("kind") == "handle").alias("strong")),
                          order).alias("b"))
            .select("person_id", *REPO, "project_url", "known_repo", "trusted", "commits",
                    "b.path", "b.credit", "b.strong"))


def _atoms(c: Column) -> Column:
    """A text as its words (letters, digits, underscores and dots) and single other characters."""
    return all_matches(F.lower(c), r"(?U)[\w.]+|[^\w.]", 0)


def label_credits(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Credits (known_repo, credit, …) with each part of the project whose label they name as a whole word.

    A line's atoms are looked up by the first atom of the labels, and the atoms that follow
    compared; a label that begins or ends with another character than a word's may not
    touch a word there.
    """
    word = lambda atom: F.coalesce(atom.rlike(r"(?U)^[\w.]"), F.lit(False))
    labels = parts.withColumn("_label", _atoms(F.col("label"))).withColumn("_first", F.get("_label", F.lit(0)))
    n = F.size("_label")
    lines_ = found.withColumn("_line", _atoms(F.col("credit")))
    before, after = F.get("_line", F.col("_at") - 1), F.get("_line", F.col("_at") + n)
    return (lines_.select("*", F.posexplode("_line").alias("_at", "_first"))
            .join(labels, ["known_repo", "_first"])
            .where((F.slice("_line", F.col("_at") + 1, n) == F.col("_label")) & ~word(before) & ~word(after))
            .drop("_line", "_label", "_first", "_at").distinct())


@register("authors")
def authors(ctx: Context):
    """A bare listing needs commits behind it; a credit for a named part stands alone."""
    found = find_credits(credit_lines(ctx.postings), ctx.keys).where("strong OR trusted")
    quoted = F.concat(F.lit("“"), display.snippet(F.col("credit")), F.lit("”"))
    url = urls.file_url(F.col("project_url"), F.col("path"))
    bare = emit(found.where(F.col("commits") >= ctx.cfg.min_ranked_commits), "authors",
                role="core_contributor", url=url,
                confidence=F.when(F.col("strong"), F.lit(0.7)).otherwise(0.5),
                detail=F.concat(F.lit("credited in "), "path", F.lit(": "), quoted))
    parts = ctx.inputs.subcomponents.where("label <> ''").select(
        F.col("repo").alias("known_repo"), "role", "label", "pos")
    named = label_credits(found, parts)
    part = emit(named, "authors", role=F.col("role"), url=url, seq=F.col("pos") + 1,
                confidence=F.when(F.col("strong"), F.lit(0.8)).otherwise(0.65),
                detail=F.concat(F.lit("credited for "), "label", F.lit(" in "), "path",
                                F.lit(": "), quoted), qualifier=F.col("label"))
    return bare.unionByName(part)
