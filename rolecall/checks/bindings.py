"""Snapshot tables derived from the driver's tables, in Spark and in SQL.

A part is a repository, a supplier an account, a pair of suppliers one person, a
line item a contribution, a document the source of role files.  Every table is a
row-wise or aggregated function of whole driver tables.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Config
from ..functions.text import lines
from ..schemas import Inputs
from ..sources import hosts
from .base import VIEWS, view

CFG = Config()

#: Rows of a table that one task groups, about.
_TASK_ROWS = 500_000

#: Candidates by session, folder and binding.
_CANDIDATES: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A text table on all cores: a small one arrives as one scan task."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A table of numbers dealt by its keys, to as many tasks as its rows need: what packs into one shuffle
        block may be many more groups than a task's memory should hold."""
        df = getattr(self, name)
        n = -(-df.count() // _TASK_ROWS)        # from file metadata
        return df if n < 2 else df.repartition(max(n, self.spark.sparkContext.defaultParallelism), *keys)

    # -- people -------------------------------------------------------------
    @cached_property
    def n_suppliers(self) -> Column:
        return F.lit(self.supplier.count())     # one number, from file metadata

    def login(self, number: Column) -> Column:
        return F.concat(F.lit("s"), number.cast("string"))

    def someone(self, number: Column) -> Column:
        """Number of some supplier, as a function of a number."""
        return F.pmod(number, self.n_suppliers)

    @cached_property
    def accounts(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(
            F.pmod(k, F.floor(self.n_suppliers / 2)).cast("bigint").alias("person_id"),
            F.lit("github").alias("forge"), self.login(k).alias("login"),
            F.concat(F.lit("Supplier No"), k.cast("string")).alias("name"),
            F.concat(self.login(k), F.lit("@example.com")).alias("email"),
            F.lit(None).cast("string").alias("bio"), F.lit(None).cast("string").alias("website"))

    @cached_property
    def people(self) -> DataFrame:
        return self.accounts.select("person_id").distinct().withColumn(
            "primary_login", self.login(F.col("person_id")))

    @cached_property
    def keys(self) -> DataFrame:
        from ..operators.people import person_keys
        return person_keys(self.people, self.accounts)

    @cached_property
    def handles(self) -> DataFrame:
        from ..operators.people import handles
        return handles(self.keys)

    @cached_property
    def person_orgs(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.accounts.select("person_id", F.substring("login", 2, 20).cast("bigint")
                                    .alias("s_suppkey")).select(
            "person_id", F.concat(F.lit("brand"), (k * 31 % 25).cast("string")).alias("org"))

    # -- repositories -------------------------------------------------------
    @cached_property
    def part_names(self) -> DataFrame:
        """Name and counts of every part's repository; every fifth is owned by a person."""
        k = F.col("p_partkey")
        x, y = k * 7919 % 1009, k * 104729 % 211
        owner = F.when(k % 5 == 0, self.login(self.someone(k * 31))).otherwise(
            F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
        return self.part.select(
            k.alias("partkey"), owner.alias("owner"),
            F.concat(owner, F.lit("/part"), k.cast("string")).alias("repo"),
            F.floor(x * x / 500).cast("bigint").alias("stars"),
            F.floor(y * y / 300).cast("bigint").alias("forks"),
            (k % 13 == 0).alias("is_fork"), (k % 17 == 0).alias("is_private"))

    @cached_property
    def part_repos(self) -> DataFrame:
        """The same with push date and upstream."""
        p = self.part_names
        pushed = self.lineitem.groupBy(F.col("l_partkey").alias("partkey")).agg(
            F.max("l_shipdate").cast("timestamp").alias("pushed_at"))
        up = p.select((F.col("partkey") + 1).alias("partkey"), F.col("repo").alias("parent"))
        return (p.join(pushed, "partkey", "left").join(up, "partkey", "left")
                .withColumn("parent", F.when(F.col("is_fork"), F.col("parent"))))

    @cached_property
    def repos(self) -> DataFrame:
        """Metadata rows: none for every 19th name, unknown counts for every 23rd."""
        known = F.col("partkey") % 23 != 0
        return self.part_repos.where("partkey % 19 <> 0").select(
            F.lit("github").alias("forge"), "repo", "owner",
            F.when(known, F.col("stars")).alias("stars"), F.when(known, F.col("forks")).alias("forks"),
            "is_fork", "is_private", "pushed_at", "parent")

    @cached_property
    def items(self) -> DataFrame:
        """Line items with the repository of their part and the person of their supplier."""
        who = self.accounts.select(F.substring("login", 2, 20).cast("bigint").alias("l_suppkey"),
                                   "person_id", "login")
        return (self.lineitem.join(self.part_names.select(F.col("partkey").alias("l_partkey"), "repo"),
                                   "l_partkey").join(who, "l_suppkey"))

    @cached_property
    def roster(self) -> DataFrame:
        by_part = self.dealt("lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
            F.sum("l_quantity").cast("bigint").alias("commits"))
        return by_part.join(self.part_names.select(F.col("partkey").alias("l_partkey"), "repo"),
                            "l_partkey").select(
            F.lit("github").alias("forge"), "repo", self.login(F.col("l_suppkey")).alias("login"),
            "commits")

    @cached_property
    def discovery_hits(self) -> DataFrame:
        i = self.items
        kind = (F.col("l_partkey") + F.col("l_suppkey")) % 3
        cut = F.lit("2001-01-01").cast("timestamp_ntz")
        source = F.explode(F.array_compact(F.array(
            F.when(kind == 0, "history"),
            F.when((kind == 1) & (F.col("l_shipdate") >= cut), "contributed"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 7 == 0), "pkg:npm"),
            F.when(F.col("l_linenumber") == 7, "search:CODEOWNERS"))))
        listed = i.select("person_id", "repo", source.alias("source"))
        owned = self.part_names.where("partkey % 5 = 0").join(
            self.accounts.select(F.col("login").alias("owner"), "person_id"), "owner").select(
            "person_id", "repo", F.lit("owned").alias("source"))
        return listed.unionByName(owned).select(
            "person_id", F.lit("github").alias("forge"), "repo", "source")

    @cached_property
    def known(self) -> DataFrame:
        k = F.col("partkey")
        null = F.lit(None)
        return self.curated_parts.select(
            "repo", F.when(k % 2 == 0, "critical").otherwise("high").alias("importance"),
            null.cast("bigint").alias("stars"), null.cast("bigint").alias("forks"),
            F.when(k % 5 == 0, k + 300).cast("bigint").alias("contributors"),
            (k % 3 == 0).alias("min_stars_override"), self.title.alias("wikipedia"))

    @property
    def curated_parts(self) -> DataFrame:
        """The curated projects: a registry holds few of all."""
        return self.part_names.where("partkey % 97 = 0")

    #: The curated article title of a project.
    title = property(lambda self: F.lit(None).cast("string"))

    @cached_property
    def manual(self) -> DataFrame:
        return self.items.where("l_partkey % 41 = 0 AND l_linenumber = 1").select(
            "person_id", "repo", F.lit(None).cast("string").alias("path")).distinct()

    @cached_property
    def pull_requests(self) -> DataFrame:
        return self.items.select(F.lit("github").alias("forge"), "repo", "login",
                                 (F.col("l_linestatus") == "F").alias("merged"))

    @cached_property
    def inputs(self) -> Inputs:
        """The relational part of the snapshot."""
        return Inputs.of(
            self.spark, people=self.people, accounts=self.accounts, person_orgs=self.person_orgs,
            forges=hosts.forges(self.spark), repos=self.repos, roster=self.roster,
            discovery_hits=self.discovery_hits, known=self.known, manual=self.manual,
            pull_requests=self.pull_requests)

    @cached_property
    def candidates(self) -> DataFrame:
        from ..plans.lineage import cut
        # Written once a session: every check of candidates reads it.
        made = (self.spark.sparkContext.applicationId, self.dir, type(self).__name__)
        if made not in _CANDIDATES:
            _CANDIDATES[made] = cut(self._discovered())
        return _CANDIDATES[made]

    @property
    def discovered(self) -> DataFrame:
        """The same, made as they are read: members times projects are too many to store for a query that reads them once."""
        return self._discovered()

    def candidates_among(self, pairs: DataFrame, teams=None) -> DataFrame:
        """The candidates among (person_id, key) pairs, the key being a project's name in lower case, and among the
        members of the `teams` (`mentions.Teams`) that projects name."""
        from ..operators.mentions import Teams
        from ..plans.lineage import cut
        teams = teams and Teams(cut(teams.places), cut(teams.members))
        return cut(self._discovered(cut(pairs.select("person_id", "key").distinct()), teams))

    def _discovered(self, within: DataFrame | None = None, teams=None) -> DataFrame:
        from ..operators import discovery
        from ..operators.postings import Postings
        from ..sources import packages
        inp = self.inputs
        pkgs = packages.person_packages(inp.package_docs, inp.people, self.keys)
        named = discovery.named_projects(within, teams)
        known = self.known.select("repo").join(discovery.of_named(self.roster, named), "repo").join(self.handles, "login")
        hits = known.select("person_id", "forge", "repo").distinct()
        return discovery.discover(inp, self.keys, pkgs, hits, CFG, Postings.empty(self.spark), within, teams)

    # -- role files: one text per document, made line by line ---------------
    def document_files(self, path: Column, line, blank: str = " ") -> DataFrame:
        """(forge, repo, path, text) with each line of a document rewritten.

        `line(letters, i, doc_id, raw)` gives the new line from the letters of the old,
        everything between letters being one `blank`, or from the old line as it is.
        """
        letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", blank)
        text = F.array_join(F.transform(lines(F.col("text")), lambda x, i: line(
            letters(x), i.cast("bigint"), F.col("doc_id"), x)), "\n")
        repo = self.part_names.select(F.col("partkey").alias("doc_id"), "repo")
        docs = self.spread("documents").select("doc_id", path.alias("path"), text.alias("text"))
        return docs.join(repo, "doc_id").select(F.lit("github").alias("forge"), "repo", "path", "text")


class AllCurated(Tables):
    """The same tables with every project curated, every second one with an article of its own."""

    @property
    def curated_parts(self) -> DataFrame:
        return self.part_names

    @property
    def title(self) -> Column:
        k = F.col("partkey")
        return F.when(k % 2 == 0, F.concat(F.lit("Part "), k.cast("string"), F.lit(" (book)")))


# --- the same tables in SQL -------------------------------------------------
view("b_acc", """
SELECT s_suppkey AS k, s_suppkey % ((SELECT count(*) FROM supplier) // 2) AS person_id,
       's' || s_suppkey AS login, 'supplier no' || s_suppkey AS name,
       's' || s_suppkey || '@example.com' AS email FROM supplier""")
view("b_people", "SELECT DISTINCT person_id, 's' || person_id AS primary_login FROM b_acc")
view("b_orgs", "SELECT DISTINCT person_id, 'brand' || (k * 31 % 25) AS org FROM b_acc")
view("b_repo0", """
SELECT p_partkey AS partkey,
       CASE WHEN p_partkey % 5 = 0 THEN 's' || (p_partkey * 31 % (SELECT count(*) FROM supplier))
            ELSE lower(replace(p_brand, '#', '')) END AS owner,
       (p_partkey * 7919 % 1009) * (p_partkey * 7919 % 1009) // 500 AS stars,
       (p_partkey * 104729 % 211) * (p_partkey * 104729 % 211) // 300 AS forks,
       p_partkey % 13 = 0 AS is_fork, p_partkey % 17 = 0 AS is_private FROM part""")
view("b_repos", """
SELECT r.*, r.owner || '/part' || r.partkey AS repo, m.pushed_at,
       CASE WHEN r.is_fork THEN u.owner || '/part' || u.partkey END AS parent
FROM b_repo0 r
LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS pushed_at FROM lineitem GROUP BY 1) m
       ON m.l_partkey = r.partkey
LEFT JOIN b_repo0 u ON u.partkey = r.partkey - 1""")
view("b_meta", """
SELECT repo, owner, CASE WHEN partkey % 23 <> 0 THEN stars END AS stars,
       CASE WHEN partkey % 23 <> 0 THEN forks END AS forks, is_fork, is_private, pushed_at, parent
FROM b_repos WHERE partkey % 19 <> 0""")
view("b_items", """
SELECT l.*, r.repo, a.person_id, a.login FROM lineitem l
JOIN b_repos r ON r.partkey = l.l_partkey JOIN b_acc a ON a.k = l.l_suppkey""")
view("b_roster", """
SELECT repo, login, CAST(sum(l_quantity) AS BIGINT) AS commits FROM b_items GROUP BY repo, login""")
view("b_known", """
SELECT repo, CASE WHEN partkey % 2 = 0 THEN 'critical' ELSE 'high' END AS importance,
       CASE WHEN partkey % 5 = 0 THEN partkey + 300 END AS snapshot, partkey % 3 = 0 AS override
FROM b_repos WHERE partkey % 97 = 0""")
ALL_CURATED = {"b_known": VIEWS["b_known"].replace("partkey % 97 = 0", "TRUE")}
view("b_manual", """
SELECT DISTINCT person_id, repo FROM b_items WHERE l_partkey % 41 = 0 AND l_linenumber = 1""")
view("b_listed", """
SELECT person_id, repo, 'history' AS source FROM b_items WHERE (l_partkey + l_suppkey) % 3 = 0
UNION ALL SELECT person_id, repo, 'contributed' FROM b_items
 WHERE (l_partkey + l_suppkey) % 3 = 1 AND l_shipdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT person_id, repo, 'pkg:npm' FROM b_items WHERE l_returnflag = 'R' AND l_partkey % 7 = 0
UNION ALL SELECT person_id, repo, 'search:CODEOWNERS' FROM b_items WHERE l_linenumber = 7
UNION ALL SELECT a.person_id, r.repo, 'owned' FROM b_repos r JOIN b_acc a ON a.login = r.owner
 WHERE r.partkey % 5 = 0""")
view("b_orgtop", "SELECT lower(owner) AS org, repo FROM b_meta")
view("b_parents", """
SELECT l.person_id, m.parent AS repo FROM b_listed l JOIN b_meta m ON m.repo = l.repo
WHERE l.source = 'owned' AND m.is_fork AND m.parent IS NOT NULL""")
view("b_hits", """
SELECT * FROM b_listed
UNION ALL SELECT person_id, repo, 'fork-parent' FROM b_parents
UNION ALL SELECT o.person_id, t.repo, 'org-repo' FROM b_orgs o JOIN b_orgtop t USING (org)
UNION ALL SELECT a.person_id, k.repo, 'registry' FROM b_known k JOIN b_roster r USING (repo)
          JOIN b_acc a USING (login)
UNION ALL SELECT person_id, repo, 'manual' FROM b_manual""")
view("b_merged", """
SELECT person_id, repo, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
       bool_or(source IN ('history', 'contributed')) AS genuine,
       bool_and(source IN ('org-repo', 'registry')) AS speculative,
       bool_or(source = 'manual') AS manual FROM b_hits GROUP BY person_id, repo""")
view("b_resolved", """
SELECT c.*, coalesce(m.stars, 0) AS stars, coalesce(m.forks, 0) AS forks,
       CASE WHEN m.repo IS NULL THEN TRUE ELSE m.is_fork END AS is_fork,
       coalesce(m.is_private, FALSE) AS is_private, m.pushed_at,
       k.repo IS NOT NULL AS known, k.importance, coalesce(k.override, FALSE) AS override
FROM b_merged c LEFT JOIN b_meta m USING (repo) LEFT JOIN b_known k USING (repo)""")
view("b_ranked", """
SELECT repo, login, commits, rank() OVER (PARTITION BY repo ORDER BY commits DESC) AS rank,
       count(*) OVER (PARTITION BY repo) AS n FROM b_roster""")
view("b_standing", """
SELECT a.person_id, r.repo, max(r.commits) AS commits, min(r.rank) AS rank, max(r.n) AS n_fetched
FROM b_ranked r JOIN b_acc a USING (login) GROUP BY a.person_id, r.repo""")
view("b_cand", """
SELECT c.*, split_part(c.repo, '/', 1) AS owner, s.commits, s.rank, s.n_fetched,
       EXISTS (SELECT 1 FROM b_acc a WHERE a.person_id = c.person_id
               AND a.login = split_part(c.repo, '/', 1)) AS owns,
       c.manual OR c.stars >= 1000 OR c.forks >= 100
         OR EXISTS (SELECT 1 FROM b_acc a WHERE a.person_id = c.person_id
                    AND a.login = split_part(c.repo, '/', 1))
         OR EXISTS (SELECT 1 FROM b_orgs o WHERE o.person_id = c.person_id
                    AND o.org = split_part(c.repo, '/', 1)) AS trusted,
       c.stars >= 1000 OR c.forks >= 100 OR c.known AS notable
FROM b_resolved c LEFT JOIN b_standing s USING (person_id, repo)
WHERE c.manual OR c.known OR (NOT c.is_fork AND NOT c.is_private)""")
view("b_prs", """
SELECT person_id, repo, max(n) AS prs FROM (
  SELECT person_id, repo, login, count(*) AS n FROM b_items WHERE l_linestatus = 'F'
  GROUP BY person_id, repo, login) GROUP BY person_id, repo""")
