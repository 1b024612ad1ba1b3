"""Input and output tables.

Every input is optional: a table that was not crawled is an empty DataFrame of
its schema, and every operator is written so that an empty input yields no
evidence rather than an error.
"""

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

INPUT_DDL = {
    "people": "person_id BIGINT, primary_login STRING",
    "accounts": "person_id BIGINT, forge STRING, login STRING, name STRING, email STRING, "
                "bio STRING, website STRING",
    "person_orgs": "person_id BIGINT, org STRING",
    "teams": "org STRING, team STRING, login STRING",
    "forges": "forge STRING, web_host STRING, has_stars BOOLEAN",
    "repos": "forge STRING, repo STRING, owner STRING, stars BIGINT, forks BIGINT, "
             "is_fork BOOLEAN, is_private BOOLEAN, pushed_at TIMESTAMP, parent STRING",
    "discovery_hits": "person_id BIGINT, forge STRING, repo STRING, source STRING",
    "roster": "forge STRING, repo STRING, login STRING, commits BIGINT",
    "commits": "forge STRING, repo STRING, login STRING, author_name STRING, "
               "author_identity STRING, sha STRING, path STRING, committed_at TIMESTAMP",
    "pull_requests": "forge STRING, repo STRING, login STRING, merged BOOLEAN",
    "releases": "forge STRING, repo STRING, author_login STRING, published_at TIMESTAMP, seq BIGINT",
    "files": "forge STRING, repo STRING, path STRING, text STRING",
    "dir_entries": "forge STRING, repo STRING, dir STRING, name STRING, is_dir BOOLEAN",
    "package_docs": "registry STRING, login STRING, payload STRING",
    "claims": "repo STRING, property STRING, handle STRING, item STRING",
    "founder_claims": "repo STRING, handle STRING, name STRING, url STRING, pos INT",
    "articles": "repo STRING, title STRING, wikitext STRING",
    "pages": "url STRING, html STRING",
    "profile_links": "forge STRING, login STRING, url STRING",
    "known": "repo STRING, importance STRING, stars BIGINT, forks BIGINT, contributors BIGINT, "
             "min_stars_override BOOLEAN, wikipedia STRING",
    "known_aliases": "repo STRING, alias STRING",
    "role_conventions": "repo STRING, pos INT, extractor STRING, role STRING, path STRING, "
                        "header_format STRING",
    "role_sources": "repo STRING, pos INT, url STRING, role STRING, label STRING",
    "discovered_sources": "repo STRING, pos INT, url STRING, role STRING, label STRING",
    "curated_roles": "repo STRING, pos INT, login STRING, role STRING, url STRING, label STRING",
    "subcomponents": "repo STRING, pos INT, path STRING, role STRING, label STRING",
    "manual": "person_id BIGINT, repo STRING, path STRING",
    "reverse_index": "login STRING, repo STRING, batch BIGINT",
}

SCAN_DDL = "ts TIMESTAMP, forge STRING, username STRING, repos ARRAY<STRING>"

EVIDENCE_COLUMNS = [
    ("person_id", "bigint"), ("forge", "string"), ("repo", "string"), ("ord", "bigint"),
    ("source", "string"), ("role", "string"), ("url", "string"), ("confidence", "double"),
    ("detail", "string"), ("qualifier", "string"), ("rank", "bigint"),
    ("n_contributors", "bigint"), ("capped", "boolean"), ("approx", "boolean"),
    ("contributions", "bigint"), ("releases_authored", "bigint"), ("releases_total", "bigint"),
]
EVIDENCE_DDL = ", ".join(f"{n} {t}" for n, t in EVIDENCE_COLUMNS)


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of a schema, in a form the optimizer knows to be empty.

    Joins and unions with it are removed from a plan, so a table that was not
    crawled costs nothing.
    """
    cols = [c.split() for c in ddl.split(", ")]
    return spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in cols]).where("false")


@dataclass(frozen=True)
class Inputs:
    """The crawled snapshot: one DataFrame per table of INPUT_DDL."""

    people: DataFrame
    accounts: DataFrame
    person_orgs: DataFrame
    teams: DataFrame
    forges: DataFrame
    repos: DataFrame
    discovery_hits: DataFrame
    roster: DataFrame
    commits: DataFrame
    pull_requests: DataFrame
    releases: DataFrame
    files: DataFrame
    dir_entries: DataFrame
    package_docs: DataFrame
    claims: DataFrame
    founder_claims: DataFrame
    articles: DataFrame
    pages: DataFrame
    profile_links: DataFrame
    known: DataFrame
    known_aliases: DataFrame
    role_conventions: DataFrame
    role_sources: DataFrame
    discovered_sources: DataFrame
    curated_roles: DataFrame
    subcomponents: DataFrame
    manual: DataFrame
    reverse_index: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> "Inputs":
        """Build a snapshot from the tables at hand; the rest are empty."""
        unknown = set(tables) - set(INPUT_DDL)
        if unknown:
            raise ValueError(f"unknown input tables: {sorted(unknown)}")
        full = {}
        for f in fields(cls):
            full[f.name] = (tables[f.name] if f.name in tables
                            else empty_table(spark, INPUT_DDL[f.name]))
        return cls(**full)

    def with_tables(self, **tables: DataFrame) -> "Inputs":
        return replace(self, **tables)
