"""Evidence from web pages that list the people of a project."""

from pyspark.sql import DataFrame, functions as F

from ... import fixed
from ...functions import markup
from ..containment import contains_join
from .base import REPO, Context, emit, register


def page_matches(sources: DataFrame, pages: DataFrame, keys: DataFrame) -> DataFrame:
    """(person, project, pos, url, role, label, strong) of pages that list the person.

    `sources` has (known_repo, pos, url, role, label).  A linked handle is strong; a
    name in the page text is weak and confers no role that needs a handle.
    """
    wanted = keys.join(sources, "known_repo").select(
        "person_id", *REPO, "pos", "url", "role", "label", "kind", "key")
    used = pages.join(sources.select("url").distinct(), "url", "left_semi")
    linked = used.select("url", F.explode(markup.page_handles(F.col("html"))).alias("key"))
    ids = ["person_id", *REPO, "pos", "url", "role", "label"]
    strong = wanted.where("kind = 'handle'").join(linked, ["url", "key"]).select(ids).distinct()
    names = wanted.where("kind = 'name'").where(~F.col("role").isin(fixed.HANDLE_REQUIRED_ROLES))
    texts = used.select("url", markup.page_text(F.col("html")).alias("text"))
    named = contains_join(texts, names.select("url", F.col("key").alias("name")), ["url"], on=["url"])
    weak = (names.withColumnRenamed("key", "name").join(named, ["url", "name"]).select(ids).distinct()
            .join(strong.select("person_id", *REPO, "pos"), ["person_id", *REPO, "pos"], "left_anti"))
    return (strong.withColumn("strong", F.lit(True))
            .unionByName(weak.select(ids).withColumn("strong", F.lit(False))))


def _listed(strong):
    return F.when(strong, "listed by GitHub handle on ").otherwise("listed by name on ")


@register("web_roles")
def web_roles(ctx: Context):
    """Curated role pages."""
    src = ctx.inputs.role_sources.withColumnRenamed("repo", "known_repo")
    found = page_matches(src, ctx.inputs.pages, ctx.keys.where("known_repo IS NOT NULL"))
    return emit(found, "web_roles", role=F.col("role"), seq=F.col("pos"), url=F.col("url"),
                confidence=F.when(F.col("strong"), F.lit(0.9)).otherwise(0.75),
                detail=F.concat(_listed(F.col("strong")), F.coalesce(
                    F.nullif("label", F.lit("")), F.lit("project role page"))))


@register("web_roles_auto")
def web_roles_auto(ctx: Context):
    """Discovered role pages of notable projects without curated ones."""
    from ...functions.roles import discovered_page_role
    src = ctx.inputs.discovered_sources.where("url LIKE 'http%'").withColumn(
        "role", discovered_page_role(F.col("role")))
    curated = ctx.inputs.role_sources.select(F.col("repo").alias("known_repo")).distinct()
    keys = (ctx.keys.where("notable").join(curated, "known_repo", "left_anti")
            .withColumn("known_repo", F.lower("repo")))
    found = page_matches(src.withColumn("known_repo", F.lower("repo")).drop("repo"),
                         ctx.inputs.pages, keys)
    return emit(found, "web_roles_auto", role=F.col("role"), seq=F.col("pos"), url=F.col("url"),
                confidence=F.when(F.col("strong"), F.lit(0.85)).otherwise(0.6),
                detail=F.concat(_listed(F.col("strong")), F.coalesce(
                    F.nullif("label", F.lit("")), F.lit("discovered role page")),
                    F.lit(" (web-search discovered)")))
