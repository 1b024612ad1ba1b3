"""Package-registry documents to package references."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.text import fold, handle_key

NPM = ("objects array<struct<package:struct<name:string,links:struct<repository:string>,"
       "repository:string,author:struct<name:string,email:string>>>>")
CRATES = "crates array<struct<name:string,repository:string>>"
PYPI = ("info struct<name:string,home_page:string,author:string,maintainer:string,"
        "author_email:string,maintainer_email:string,project_urls:map<string,string>>")


def _repository_url(c: Column) -> Column:
    """A repository field is a string or an object with a url."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(c)


def listed_packages(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(login, registry, name, url, repo, author_name, author_email, pos): packages a
    registry lists for a login; the first `limit` of a listing if one is given."""
    first = (lambda c: c) if limit is None else (lambda c: F.slice(c, 1, limit))
    npm = docs.where("registry = 'npm'").select(
        "login", F.posexplode(first(F.from_json("payload", NPM)["objects"]))
        .alias("pos", "o")).select("login", "pos", "o.package.*").where("name <> ''").select(
        "login", F.lit("npm").alias("registry"), "name",
        F.concat(F.lit("https://www.npmjs.com/package/"), "name").alias("url"),
        urls.github_repo(F.coalesce(F.nullif("links.repository", F.lit("")),
                                    _repository_url(F.col("repository")))).alias("repo"),
        F.col("author.name").alias("author_name"), F.col("author.email").alias("author_email"), "pos")
    crates = docs.where("registry = 'crates'").select(
        "login", F.posexplode(first(F.from_json("payload", CRATES)["crates"]))
        .alias("pos", "c")).select("login", "pos", "c.*").where("name <> ''").select(
        "login", F.lit("crates").alias("registry"), "name",
        F.concat(F.lit("https://crates.io/crates/"), "name").alias("url"),
        urls.github_repo(F.col("repository")).alias("repo"),
        F.lit(None).cast("string").alias("author_name"),
        F.lit(None).cast("string").alias("author_email"), "pos")
    return npm.unionByName(crates)


def person_packages(docs: DataFrame, people: DataFrame, keys: DataFrame,
                    limit: int | None = None) -> DataFrame:
    """(person_id, registry, name, url, repo, author_match, pos) of each person."""
    own = (listed_packages(docs, limit).withColumn("login", handle_key(F.col("login")))
           .join(people.select("person_id", handle_key(F.col("primary_login")).alias("login")),
                 "login"))
    authors = own.select(
        "person_id", "registry", "name", F.explode(F.array(
            F.struct(F.lit("name").alias("kind"), fold(F.col("author_name")).alias("key")),
            F.struct(F.lit("email").alias("kind"), fold(F.col("author_email")).alias("key"))))
        .alias("k")).select("person_id", "registry", "name", "k.*").where("key IS NOT NULL")
    matched = authors.join(keys, ["person_id", "kind", "key"], "left_semi").select(
        "person_id", "registry", "name", F.lit(True).alias("author_match")).distinct()
    return (own.join(matched, ["person_id", "registry", "name"], "left")
            .select("person_id", "registry", "name", "url", "repo",
                    F.coalesce("author_match", F.lit(False)).alias("author_match"), "pos"))


def pypi_authors(docs: DataFrame) -> DataFrame:
    """(name, url, repo, kind, key): one row per author or maintainer of each package."""
    info = docs.where("registry = 'pypi'").select(
        F.from_json("payload", PYPI)["info"].alias("i")).where("i.name <> ''")
    sources = F.array_append(F.coalesce(F.map_values("i.project_urls"),
                                        F.array().cast("array<string>")), F.col("i.home_page"))
    repo = F.try_element_at(F.filter(F.transform(sources, urls.github_repo),
                                     lambda r: r.isNotNull()), F.lit(1))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), fold(F.col(c)).alias("key"))
    return info.select(
        "i.name", F.concat(F.lit("https://pypi.org/project/"), "i.name", F.lit("/")).alias("url"),
        repo.alias("repo"), F.explode(F.array(
            key("name", "i.author"), key("name", "i.maintainer"), key("email", "i.author_email"),
            key("email", "i.maintainer_email"))).alias("k")).select(
        "name", "url", "repo", "k.*").where("key IS NOT NULL").distinct()

