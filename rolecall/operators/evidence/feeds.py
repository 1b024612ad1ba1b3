"""Evidence from external tables: packages, curated roles, claims, articles, founders."""

from pyspark.sql import DataFrame, functions as F

from ... import fixed
from ...functions import markup, urls
from ...functions.roles import choose
from ...functions.text import first_last, fold, handle_key, percent_encode_path
from .base import REPO, Context, emit, register


# --- packages --------------------------------------------------------------
def package_index(packages: DataFrame) -> DataFrame:
    """(person_id, repo, packages): a person's packages by the project they name as source.

    The list holds the packages of one person from one project.
    """
    return packages.where("repo IS NOT NULL").groupBy("person_id", "repo").agg(
        F.array_sort(F.collect_list(F.struct("registry", "name", "url", "author_match"))).alias("packages"))


def index_matches(packages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Packages of a person that name a candidate of that person as their source."""
    refs = packages.where("repo IS NOT NULL").select(
        "person_id", F.lower("repo").alias("key"), "registry", "name", "url", "author_match", "pos")
    return candidates.withColumn("key", F.lower("repo")).join(refs, ["person_id", "key"]).select(
        "person_id", *REPO, "registry", "name", "url", "author_match", "pos")


def probe_matches(pypi: DataFrame, keys: DataFrame) -> DataFrame:
    """Packages named like a candidate whose author or maintainer is the person.

    `pypi` has (name, url, repo, kind, key), one row per author key.  A package
    that names another repository is not this one; the first guess wins.
    """
    guesses = keys.where("kind IN ('name', 'email')").select(
        "person_id", *REPO, "kind", "key",
        F.posexplode(urls.package_name_guesses(F.col("repo"))).alias("guess_pos", "name"))
    docs = pypi.withColumnRenamed("repo", "source_repo")
    return (guesses.join(docs, ["name", "kind", "key"])
            .where(F.col("source_repo").isNull() | (F.lower("source_repo") == F.lower("repo")))
            .groupBy("person_id", *REPO)
            .agg(F.min_by(F.struct("name", "url"), "guess_pos").alias("b"))
            .select("person_id", *REPO, F.lit("pypi").alias("registry"), "b.name", "b.url",
                    F.lit(True).alias("author_match"), F.lit(1 << 20).alias("pos")))


def package_evidence(found: DataFrame) -> DataFrame:
    author = F.col("author_match")
    base = choose(F.col("registry"), fixed.PACKAGE_CONFIDENCE, fixed.PACKAGE_CONFIDENCE_OTHER)
    word = F.when(author, "author").otherwise("maintainer")
    return emit(found, "packages", source=F.col("registry"), role=word, seq=F.col("pos"),
                url=F.col("url"),
                confidence=F.when(author, F.least(F.lit(0.9), base + 0.05)).otherwise(base),
                detail=F.concat(choose(F.col("registry"), fixed.PACKAGE_LABEL, F.col("registry")),
                                F.lit(" "), word, F.lit(" of package “"), "name", F.lit("”")))


@register("packages")
def packages(ctx: Context):
    from ...sources.packages import pypi_authors
    listed = index_matches(ctx.packages, ctx.candidates)
    probed = probe_matches(pypi_authors(ctx.inputs.package_docs), ctx.keys)
    return package_evidence(listed.unionByName(probed))


# --- curated roles ---------------------------------------------------------
@register("curated")
def curated(ctx: Context):
    """Roles a curator asserts for one login."""
    src = ctx.inputs.curated_roles.select(
        F.col("repo").alias("known_repo"), "pos", handle_key(F.col("login")).alias("key"),
        F.lit("handle").alias("kind"), "role", "url", "label")
    found = ctx.keys.join(src, ["known_repo", "kind", "key"])
    return emit(found, "curated", role=F.col("role"), seq=F.col("pos"),
                url=F.coalesce(F.nullif("url", F.lit("")), F.col("project_url")), confidence=0.95,
                detail=F.coalesce(F.nullif("label", F.lit("")),
                                  F.concat(F.lit("curated: "), "role")))


# --- claims ----------------------------------------------------------------
@register("wikidata")
def wikidata(ctx: Context):
    """Creator, founder and developer claims matched by handle."""
    claims = ctx.inputs.claims.where(F.col("property").isin(list(fixed.CLAIM_ROLE))).select(
        F.lower("repo").alias("key_repo"), "property", handle_key(F.col("handle")).alias("key"),
        "item")
    found = (ctx.keys.where("notable AND kind = 'handle'").withColumn("key_repo", F.lower("repo"))
             .join(claims, ["key_repo", "key"])
             .groupBy("person_id", *REPO, "property", "item").agg(F.lit(1).alias("one")))
    pick = lambda i: choose(F.col("property"), {k: v[i] for k, v in fixed.CLAIM_ROLE.items()},
                            F.lit(None))
    order = choose(F.col("property"), {k: i for i, k in enumerate(fixed.CLAIM_ROLE)}, 9)
    return emit(found, "wikidata", role=pick(0), seq=order, url=F.col("item"), confidence=pick(2),
                detail=F.concat(pick(1), F.lit(" of the project (Wikidata)")))


# --- articles --------------------------------------------------------------
def article_titles(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """(person, project, title): the curated title, else the one resolved for the project."""
    resolved = articles.where("repo IS NOT NULL AND title <> ''").groupBy(
        F.lower("repo").alias("key")).agg(F.min("title").alias("resolved"))
    return (candidates.withColumn("key", F.lower("repo")).join(resolved, "key", "left")
            .withColumn("title", F.coalesce("wikipedia", "resolved")).where("title IS NOT NULL"))


def article_names(articles: DataFrame) -> DataFrame:
    """(title, name, first_last) of everyone an article credits as an author."""
    return (articles.select("title", F.explode(markup.article_authors(F.col("wikitext"))).alias("n"))
            .select("title", fold(F.col("n")).alias("name"), first_last(F.col("n")).alias("fl"))
            .distinct())


def article_matches(titled: DataFrame, credited: DataFrame, names: DataFrame) -> DataFrame:
    """Exact name matches, and first+last matches of people known to contribute."""
    mine = titled.join(names, "person_id").select(
        "person_id", *REPO, "title", "genuine", "commits", "name",
        first_last(F.col("name")).alias("fl"))
    exact = mine.join(credited.select("title", "name"), ["title", "name"]).select(
        "person_id", *REPO, "title", F.lit(0).alias("relaxed"))
    relaxed = (mine.where(F.col("genuine") | F.col("commits").isNotNull())
               .join(credited.where("fl IS NOT NULL").select("title", "fl"), ["title", "fl"])
               .select("person_id", *REPO, "title", F.lit(1).alias("relaxed")))
    return exact.unionByName(relaxed).groupBy("person_id", *REPO, "title").agg(
        F.min("relaxed").alias("relaxed"))


@register("wikipedia_authors")
def wikipedia_authors(ctx: Context):
    from .. import people
    titled = article_titles(ctx.candidates.where("notable"), ctx.inputs.articles)
    found = article_matches(titled, article_names(ctx.inputs.articles),
                            people.names(_own_keys(ctx)))
    page = percent_encode_path(F.translate("title", " ", "_"))
    return emit(found, "wikipedia_authors", role="author", confidence=0.6,
                url=F.concat(F.lit("https://en.wikipedia.org/wiki/"), page),
                detail=F.concat(F.lit("credited as an original author in the “"), "title",
                                F.lit("” Wikipedia article"),
                                F.when(F.col("relaxed") == 1, " (name + contribution)").otherwise("")))


def _own_keys(ctx: Context) -> DataFrame:
    from .. import people
    return people.person_keys(ctx.inputs.people, ctx.inputs.accounts)


# --- founders feed ---------------------------------------------------------
@register("founders")
def founders(ctx: Context):
    """The first supplied founder claim that names the person, by handle or by name."""
    feed = ctx.inputs.founder_claims.select(
        F.lower("repo").alias("key_repo"), "pos", "url", F.explode(F.array(
            F.struct(F.lit("handle").alias("kind"), handle_key(F.col("handle")).alias("key")),
            F.struct(F.lit("name").alias("kind"), fold(F.col("name")).alias("key")))).alias("k")) \
        .select("key_repo", "pos", "url", "k.*").where("key IS NOT NULL")
    order = F.col("pos") * 2 + F.when(F.col("kind") == "name", 1).otherwise(0)
    found = (ctx.keys.where("notable").withColumn("key_repo", F.lower("repo"))
             .join(feed, ["key_repo", "kind", "key"])
             .groupBy("person_id", *REPO, "project_url")
             .agg(F.min_by(F.struct("url", "kind"), order).alias("b")))
    by_name = F.col("b.kind") == "name"
    return emit(found, "founders", role="author",
                url=F.coalesce(F.nullif(F.col("b.url"), F.lit("")), F.col("project_url")),
                confidence=F.when(by_name, F.lit(0.6)).otherwise(0.75),
                detail=F.when(by_name, "named as founder/creator by name")
                        .otherwise("named as founder/creator"))
