"""Repository payloads of the supported code hosts, normalised to one shape.

`raw` has (payload STRING); a payload without a repository name gives no row.  A
null count is unknown, which is not zero.
"""

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ["forge", "repo", "owner", "stars", "forks", "is_fork", "is_private", "pushed_at", "parent"]

# Payload schema of each host and shape.
SCHEMAS = {
    "github_graphql": "nameWithOwner string, stargazerCount bigint, forkCount bigint, isFork boolean, "
                      "isPrivate boolean, pushedAt string, parent struct<nameWithOwner:string>",
    "github": "full_name string, stargazers_count bigint, forks_count bigint, fork boolean, "
              "private boolean, pushed_at string, parent struct<full_name:string>",
    "gitlab": "path_with_namespace string, star_count bigint, forks_count bigint, "
              "forked_from_project string, visibility string, last_activity_at string",
    "codeberg": "full_name string, stars_count bigint, forks_count bigint, fork boolean, "
                "private boolean, updated_at string",
    "gitee": "full_name string, stargazers_count bigint, forks_count bigint, fork boolean, "
             "private boolean, pushed_at string",
    "bitbucket": "full_name string, parent string, is_private boolean, updated_on string, "
                 "watchers bigint",
    "cgit": "full_name string",
}


def _rows(df: DataFrame, forge: str, name: Column, stars, forks, is_fork, is_private, pushed,
          parent=None) -> DataFrame:
    lit = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    flag = lambda v: F.coalesce(lit(v, "boolean"), F.lit(False))
    when = F.try_to_timestamp(pushed) if isinstance(pushed, Column) else F.lit(None).cast("timestamp")
    return df.where(F.coalesce(name, F.lit("")) != "").select(
        F.lit(forge).alias("forge"), name.alias("repo"),
        F.substring_index(name, "/", 1).alias("owner"), lit(stars, "bigint").alias("stars"),
        lit(forks, "bigint").alias("forks"), flag(is_fork).alias("is_fork"),
        flag(is_private).alias("is_private"), when.alias("pushed_at"),
        lit(parent, "string").alias("parent"))


def normalise(raw: DataFrame, shape: str) -> DataFrame:
    """Repository rows of one payload shape (a key of SCHEMAS)."""
    d = raw.select(F.from_json("payload", SCHEMAS[shape]).alias("d")).select("d.*")
    c, zero = F.col, lambda n: F.coalesce(F.col(n), F.lit(0))
    if shape == "github_graphql":
        # A missing count means a partial response: neither count is trusted.
        known = c("stargazerCount").isNotNull() & c("forkCount").isNotNull()
        return _rows(d, "github", c("nameWithOwner"), F.when(known, c("stargazerCount")),
                     F.when(known, c("forkCount")), c("isFork"), c("isPrivate"), c("pushedAt"),
                     c("parent.nameWithOwner"))
    if shape == "github":
        return _rows(d, "github", c("full_name"), zero("stargazers_count"), zero("forks_count"),
                     c("fork"), c("private"), c("pushed_at"), c("parent.full_name"))
    if shape == "gitlab":
        return _rows(d, "gitlab", c("path_with_namespace"), zero("star_count"), zero("forks_count"),
                     ~F.coalesce("forked_from_project", F.lit("")).isin("", "{}"),
                     F.coalesce("visibility", F.lit("public")) != "public", c("last_activity_at"))
    if shape == "codeberg":
        return _rows(d, "codeberg", c("full_name"), zero("stars_count"), zero("forks_count"),
                     c("fork"), c("private"), c("updated_at"))
    if shape == "gitee":
        return _rows(d, "gitee", c("full_name"), zero("stargazers_count"), zero("forks_count"),
                     c("fork"), c("private"), c("pushed_at"))
    if shape == "bitbucket":
        # No stars on this host: watchers stand in, on the forks axis.
        return _rows(d, "bitbucket", c("full_name"), 0, zero("watchers"), c("parent").isNotNull(),
                     c("is_private"), c("updated_on"))
    if shape == "cgit":
        return _rows(d, "cgit", c("full_name"), 0, 0, False, False, None)
    raise ValueError(f"unknown payload shape: {shape}")


def forges(spark) -> DataFrame:
    """Known hosts with their web address and whether they count stars."""
    from ..fixed import WEB_HOST
    rows = [(f, h, f != "bitbucket") for f, h in WEB_HOST.items()]
    return spark.createDataFrame([*rows, ("cgit", None, False)],
                                 "forge string, web_host string, has_stars boolean")
