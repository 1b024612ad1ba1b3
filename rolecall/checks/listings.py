"""Checks of the search and listing sources."""

from pyspark.sql import functions as F

from ..operators import discovery, people
from ..sources import files as src
from .base import check
from .documents import cat, credit_files, maintainers_files, owners_files, posted, text


@check("handle_mentions", """
SELECT DISTINCT p.person_id, m.repo, m.source FROM (
  SELECT repo, regexp_extract(txt, 's[0-9]+') AS login, 'search:OWNERS' AS source FROM b_owners_lines
  WHERE txt LIKE '  - s%'
  UNION ALL SELECT repo, split_part(key, '@', 1), 'search:MAINTAINERS' FROM b_maint WHERE kind <> 'name') m
JOIN b_people p ON p.primary_login = m.login""")
def handle_mentions(t):
    files = owners_files(t).unionByName(maintainers_files(t))
    return discovery.handle_mentions(posted(t, files), t.people).select("person_id", "repo", "source").distinct()


@check("name_mentions", """
SELECT DISTINCT a.person_id, l.repo, CASE prio WHEN 1 THEN 'namesearch:AUTHORS' WHEN 6 THEN 'namesearch:THANKS'
  ELSE 'namesearch:CONTRIBUTORS' END AS source
FROM b_credit_lines l JOIN b_acc a ON contains(lower(l.txt), a.name)""")
def name_mentions(t):
    return discovery.name_mentions(posted(t, credit_files(t)), people.names(t.keys)).select("person_id", "repo", "source")


@check("commit_search", """
SELECT DISTINCT person_id, repo, how FROM b_items, (VALUES ('history'), ('commit-search')) v(how)
WHERE how = 'history' OR l_linenumber % 2 = 0""")
def commit_search(t):
    commits = t.items.select(F.lit("github").alias("forge"), "repo", F.upper("login").alias("login"), F.when(
        F.col("l_linenumber") % 2 == 0, cat(" Supplier No", text(F.col("l_suppkey")))).alias("author_name"))
    by_login = discovery.commit_history(commits, t.handles).withColumn("how", F.lit("history"))
    by_name = discovery.commits_by_name(commits, people.names(t.keys)).withColumn("how", F.lit("commit-search"))
    return by_login.unionByName(by_name).drop("forge")


@check("profile_readme", """
SELECT DISTINCT partkey % h AS person_id, repo FROM (
  SELECT partkey, repo FROM b_repos UNION ALL SELECT partkey, 'a/b' || partkey FROM b_repos),
  (SELECT count(*) // 2 AS h FROM supplier)""")
def profile_readme(t):
    who = t.login(F.pmod("partkey", F.floor(t.n_suppliers / 2).cast("bigint")))
    readmes = t.part_names.select(
        F.lit("github").alias("forge"), cat(who, "/", who).alias("repo"), F.lit("README.md").alias("path"),
        cat("See https://github.com/", F.col("repo"), ". More: github.com/topics/x (github.com/a/b",
            text(F.col("partkey")), "/issues), github.com/nobody").alias("text"))
    return discovery.profile_readme_links(readmes, t.people).select("person_id", "repo").distinct()


@check("profile_urls", """
SELECT 'c' || c_custkey AS login, 'https://w.io/' || c_custkey AS url FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'c' || c_custkey, 'https://b.io/' || c_custkey FROM customer
UNION ALL SELECT 'c' || c_custkey, 'http://c.io/' || c_mktsegment FROM customer
UNION ALL SELECT 'c' || c_custkey, 'https://r.io/' || c_nationkey FROM customer""")
def profile_urls(t):
    k = text(F.col("c_custkey"))
    acc = t.customer.select(
        F.lit("github").alias("forge"), cat("c", k).alias("login"),
        F.when(F.col("c_custkey") % 2 == 0, cat("https://w.io/", k)).alias("website"),
        cat("me (https://b.io/", k, ") or 'http://c.io/", F.col("c_mktsegment"), "'").alias("bio"))
    own = t.customer.select(F.lit("github").alias("forge"), cat("c", k, "/c", k).alias("repo"),
                            F.lit("README.md").alias("path"),
                            cat("<https://r.io/", text(F.col("c_nationkey")), "> x").alias("text"))
    return src.profile_urls(acc, own).select("login", "url")


@check("base64_files", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 <> 0 THEN text END AS text FROM documents")
def base64_files(t):
    raw = t.documents.select(
        F.lit("gitee").alias("forge"), F.lit("o/r").alias("repo"), text(F.col("doc_id")).alias("path"),
        F.when(F.col("doc_id") % 4 != 0, "base64").otherwise("none").alias("encoding"),
        F.base64(F.encode("text", "UTF-8")).alias("content"))
    return src.decode_base64_files(raw).select("path", "text")


@check("identity_merge", """
SELECT person_id, 'github' AS forge, login FROM b_acc
UNION SELECT person_id, 'gitlab', 'x' || person_id FROM b_people""")
def identity_merge(t):
    more = t.people.select("person_id", F.explode(F.array(
        F.struct(F.lit("gitlab").alias("forge"), cat("X", text(F.col("person_id"))).alias("login")),
        F.struct(F.lit("github").alias("forge"), F.col("primary_login").alias("login")),
        F.struct(F.lit("github").alias("forge"), F.lit("").alias("login")))).alias("a")).select(
        "person_id", "a.forge", "a.login")
    return people.merge_identities(t.accounts, more)
