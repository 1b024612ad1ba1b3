"""The curated-projects registry as tables, from JSON and back to JSON."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PROJECT = (
    "struct<importance:string,aliases:array<string>,"
    "role_conventions:array<struct<extractor:string,role:string,path:string,"
    "header_format:string,weight:double>>,"
    "role_sources:array<struct<url:string,role:string,label:string>>,"
    "curated_roles:array<struct<login:string,role:string,url:string,label:string>>,"
    "subcomponents:array<struct<path:string,role:string,label:string>>,"
    "popularity:struct<stars:bigint,forks:bigint,contributors:bigint,min_stars_override:boolean>,"
    "wikipedia:string,notes:string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(repo, …fields): one row per project of a registry file."""
    doc = spark.read.schema(f"projects map<string,{PROJECT}>").json(path, multiLine=True)
    return flatten(doc)


def flatten(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("projects").alias("repo", "p")).select("repo", "p.*")


def _or_null(name: str, df: DataFrame) -> Column:
    """Empty lists, strings and maps count as not set."""
    c, kind = F.col(name), df.schema[name].dataType.simpleString()
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    if kind.startswith("struct"):
        inner = [c[f] for f in df.schema[name].dataType.names]
        return F.when(F.coalesce(*[i.cast("string") for i in inner]).isNotNull(), c)
    return F.nullif(c, F.lit(""))


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Field-wise overlay: a field the overlay sets replaces the base field whole."""
    fields = [c for c in base.columns if c != "repo"]
    o = over.select("repo", *[_or_null(c, over).alias(f"_{c}") for c in fields])
    b = base.select("repo", *[_or_null(c, base).alias(c) for c in fields])
    return b.join(o, "repo", "full_outer").select(
        "repo", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def tables(projects: DataFrame) -> dict[str, DataFrame]:
    """The registry as the input tables known, known_aliases, role_conventions, …"""
    def child(field: str, cols: list[str]) -> DataFrame:
        return projects.select("repo", F.posexplode(field).alias("pos", "c")).select(
            "repo", "pos", *[F.col(f"c.{c}").alias(c) for c in cols])
    return {
        "known": projects.select("repo", "importance", "popularity.stars", "popularity.forks",
                                 "popularity.contributors",
                                 F.coalesce("popularity.min_stars_override", F.lit(False))
                                 .alias("min_stars_override"), "wikipedia"),
        "known_aliases": projects.select("repo", F.explode("aliases").alias("alias")),
        "role_conventions": child("role_conventions", ["extractor", "role", "path", "header_format"]),
        "role_sources": child("role_sources", ["url", "role", "label"]),
        "curated_roles": child("curated_roles", ["login", "role", "url", "label"]),
        "subcomponents": child("subcomponents", ["path", "role", "label"]),
    }


def registry_lines(projects: DataFrame) -> DataFrame:
    """(repo, json): one JSON object per project, unset fields left out, sorted by name."""
    fields = [c for c in projects.columns if c != "repo"]
    body = F.to_json(F.struct("repo", *[_or_null(c, projects).alias(c) for c in fields]))
    return projects.select("repo", body.alias("json")).orderBy("repo")


def save_registry(projects: DataFrame, path: str) -> None:
    """Write each project as one line, a JSON object, in name order across the part files."""
    registry_lines(projects).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """(repo, …fields): the projects that `save_registry` wrote."""
    return spark.read.text(path).select(F.from_json("value", f"struct<repo:string,{PROJECT[len('struct<'):]}").alias("p")).select("p.*")
