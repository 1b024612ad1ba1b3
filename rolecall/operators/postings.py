"""One index of what role files say, parsed once per content.

A file is asked for by one or more parsers, by its path or by a plan that names it.  What
a parser finds is a posting, and postings belong to the content: copies of a file in any
number of projects are parsed once, and a later run with the same store parses only
contents it has not seen.  `places` says which project has which content where; every
operator that reads role files joins it with the postings of its parser.
"""

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import documents as doc, people as ppl
from ..functions.text import all_matches, fold, handle_key, lines, matches, strip
from ..schemas import Inputs, empty_table
from .containment import only_wanted

REPO = ["forge", "repo"]
CONTENT = ["parser", "h1", "h2"]
DDL = ("parser STRING, h1 BIGINT, h2 BIGINT, line BIGINT, pos BIGINT, kind STRING, key STRING, "
       "role STRING, scope STRING, text STRING, flags INT")
COUNCIL, MAINTAINER = 1, 2


def base_name(path: Column) -> Column:
    """File name without directory and extension, upper case."""
    return F.upper(F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1))


def listed_keys(people_: DataFrame, ids: list[str]) -> DataFrame:
    """One row per handle, e-mail and name of listed people (struct column `p`)."""
    return people_.select(*ids, F.explode(F.array(
        F.struct(F.lit("handle").alias("kind"), handle_key(F.col("p.handle")).alias("key")),
        F.struct(F.lit("email").alias("kind"), fold(F.col("p.email")).alias("key")),
        F.struct(F.lit("name").alias("kind"), fold(F.col("p.name")).alias("key")),
    )).alias("k")).select(*ids, "k.kind", "k.key").where("key IS NOT NULL")


# --- parsers: (parser, h1, h2, path, text) -> columns of DDL -----------------
def _codeowners(f: DataFrame) -> DataFrame:
    rules = f.select(*CONTENT, F.posexplode(doc.codeowner_rules(F.col("text"))).alias("line", "r"))
    return rules.where(~doc.owns_ownership_file(F.col("r.pattern"))).select(
        *CONTENT, "line", doc.rule_scope(F.col("r.pattern"), F.col("r.section")).alias("scope"),
        F.posexplode("r.owners").alias("pos", "key")).withColumn("kind", doc.owner_kind(F.col("key")))


def _owners(f: DataFrame) -> DataFrame:
    # Most files whose name ends so, CODEOWNERS above all, have neither key.
    f = f.where(F.col("text").contains("approvers") | F.col("text").contains("reviewers"))
    both = F.array(
        F.struct(F.lit("maintainer").alias("role"),
                 doc.owners_list(F.col("text"), "approvers").alias("logins")),
        F.struct(F.lit("code_owner").alias("role"),
                 doc.owners_list(F.col("text"), "reviewers").alias("logins")))
    return (f.select(*CONTENT, F.explode(both).alias("b"))
            .select(*CONTENT, "b.role", F.explode("b.logins").alias("login"))
            .select(*CONTENT, "role", F.lit("handle").alias("kind"), handle_key(F.col("login")).alias("key"))
            .where("key IS NOT NULL").distinct())


def _maintainers(f: DataFrame) -> DataFrame:
    people_ = f.select(*CONTENT, F.posexplode(F.transform(
        lines(F.col("text")), ppl.from_maintainer_line)).alias("line", "p")).where("p IS NOT NULL")
    return listed_keys(people_, [*CONTENT, "line"])


def _credits(f: DataFrame) -> DataFrame:
    return (f.select(*CONTENT, F.posexplode(lines(F.col("text"))).alias("line", "raw"))
            .select(*CONTENT, "line", F.lit("line").alias("kind"), strip(F.col("raw")).alias("text"))
            .where("text <> ''"))


def _governance(f: DataFrame) -> DataFrame:
    w = (f.select(*CONTENT, F.posexplode(doc.line_windows(F.col("text"))).alias("line", "text"))
         .where("text <> ''"))
    flag = lambda pattern, bit: F.when(matches(F.col("text"), pattern), F.lit(bit)).otherwise(0)
    return w.withColumns({"kind": F.lit("window"), "flags": flag("(?U)" + fixed.COUNCIL_WORDS, COUNCIL)
                          + flag(fixed.MAINTAINER_WORDS, MAINTAINER)})


def _manifest(f: DataFrame) -> DataFrame:
    from .evidence.manifests import manifest_people
    ids = [*CONTENT, "role"]
    return listed_keys(manifest_people(f, CONTENT), ids).distinct()


def _proposal(fmt: str) -> Callable[[DataFrame], DataFrame]:
    return lambda f: listed_keys(f.select(*CONTENT, F.explode(
        doc.proposal_authors(F.col("text"), F.lit(fmt))).alias("p")), CONTENT).distinct()


def _words(f: DataFrame) -> DataFrame:
    words = F.array_distinct(all_matches(F.lower("text"), r"[a-z0-9-]+", 0))
    return f.select(*CONTENT, F.lit("word").alias("kind"), F.explode(words).alias("key"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "codeowners": _codeowners, "owners": _owners, "maintainers": _maintainers, "credits": _credits,
    "governance": _governance, "proposal rst": _proposal("rst"), "proposal yaml": _proposal("yaml"),
    "words": _words, **{f"manifest {p}": _manifest for p in fixed.MANIFEST_PATHS},
}

#: What evidence operators read; words are for discovery alone.
EVIDENCE_PARSERS = [p for p in PARSERS if p != "words"]


def parsers_of(path: Column) -> Column:
    """The parsers that a path alone asks for."""
    base = base_name(path)
    asked = [
        ("codeowners", path.isin(fixed.CODEOWNERS_PATHS)), ("owners", path.endswith("OWNERS")),
        ("maintainers", path.isin(fixed.MAINTAINERS_PATHS)),
        ("credits", path.isin(fixed.CREDIT_PATHS) | base.isin(fixed.NAME_SEARCH_FILES)),
        ("governance", path.isin(fixed.GOVERNANCE_PATHS)), ("words", base.isin(fixed.HANDLE_SEARCH_FILES)),
    ]
    return F.array_compact(F.array(*[F.when(when, name) for name, when in asked],
                                   F.when(path.isin(fixed.MANIFEST_PATHS), F.concat(F.lit("manifest "), path))))


# --- the index -----------------------------------------------------------------
@dataclass(frozen=True)
class Postings:
    places: DataFrame       # forge, repo, path, parser, h1, h2
    posts: DataFrame        # DDL

    @classmethod
    def empty(cls, spark) -> "Postings":
        """The index of a snapshot without files."""
        return cls(empty_table(spark, "forge STRING, repo STRING, path STRING, parser STRING, h1 BIGINT, h2 BIGINT"),
                   empty_table(spark, DDL))

    def rows(self, *parsers: str) -> DataFrame:
        """(forge, repo, path, parser, …) of these parsers' postings in every place."""
        mine = F.col("parser").isin(*parsers)
        return self.places.where(mine).join(self.posts.where(mine), CONTENT).drop("h1", "h2")

    def manifests(self) -> DataFrame:
        return self.rows(*[p for p in PARSERS if p.startswith("manifest ")])

    def naming(self, keys: DataFrame) -> "Postings":
        """The index of the postings whose key is a `key` of a table, and few others: the rest is dropped where it is read."""
        of = F.xxhash64("_said")
        said = self.posts.withColumnRenamed("key", "_said").withColumn("key", of)
        found = only_wanted(said, keys.select(F.xxhash64("key").alias("key"))).drop("key")
        return replace(self, posts=found.withColumnRenamed("_said", "key"))

    def within(self, keep: Callable[[DataFrame], DataFrame]) -> "Postings":
        """The index of the projects that `keep` leaves of a table with (forge, repo)."""
        return replace(self, places=keep(self.places))


def planned(inputs: Inputs, limit: int | None = None) -> DataFrame:
    """(forge, repo, path, parser) of files that no path alone asks for: curated OWNERS paths
    and the documents of proposal series."""
    from .evidence.documents import owners_targets
    from .evidence.proposals import series_docs
    owners = owners_targets(inputs).select(*REPO, "path", F.lit("owners").alias("parser"))
    docs = series_docs(inputs, limit).select(
        *REPO, "path", F.concat(F.lit("proposal "), "header_format").alias("parser"))
    return owners.unionByName(docs).where(F.col("parser").isin(*PARSERS)).distinct()


def _hashed(files: DataFrame) -> DataFrame:
    return files.select(*REPO, "path", F.xxhash64("text", F.lit(1)).alias("h1"),
                        F.xxhash64("text", F.lit(2)).alias("h2"), "text")


def index_files(inputs: Inputs, limit: int | None = None, store: str | None = None,
                only: list[str] | None = None) -> Postings:
    """The index of the snapshot's role files, of all parsers or of those named in `only`.

    With `store`, a folder that executors share, contents that an earlier run has parsed
    are not parsed again.  A run writes its postings before the list of contents they are
    of, and postings without such a list do not count: a run that dies leaves nothing.
    """
    from ..plans.lineage import cut, new_path
    spark = inputs.files.sparkSession
    store = store or new_path(spark, "postings")
    run = uuid.uuid4().hex
    hashed = _hashed(inputs.files.where("text IS NOT NULL"))
    by_path = hashed.select(*REPO, "path", "h1", "h2", F.explode(parsers_of(F.col("path"))).alias("parser"))
    by_plan = hashed.join(planned(inputs, limit), [*REPO, "path"]).select(*REPO, "path", "h1", "h2", "parser")
    asked_for = by_path.unionByName(by_plan)
    places = cut((asked_for if only is None else asked_for.where(F.col("parser").isin(only))).distinct())

    # The first run begins with an empty list, so that it can be read.
    empty_table(spark, ", ".join(f"{c} {'STRING' if c == 'parser' else 'BIGINT'}" for c in CONTENT)).write.mode(
        "overwrite").parquet(f"{store}/done/run=none")
    done = lambda: spark.read.schema("parser STRING, h1 BIGINT, h2 BIGINT, run STRING").parquet(f"{store}/done")
    todo = (places.join(done().select(CONTENT), CONTENT, "left_anti").groupBy(CONTENT)
            .agg(F.min(F.struct(*REPO, "path")).alias("at")).select(*CONTENT, "at.*"))
    todo = cut(todo)
    # One text of each content, written by parser so that a parser reads only its own.
    texts = new_path(spark, "texts")
    (hashed.join(todo, [*REPO, "path", "h1", "h2"]).select(*CONTENT, "path", "text")
     .write.partitionBy("parser").parquet(texts))
    read = spark.read.schema("h1 BIGINT, h2 BIGINT, path STRING, text STRING, parser STRING").parquet(texts)
    columns = [c.split()[0] for c in DDL.split(", ")]
    types = dict(c.split() for c in DDL.split(", "))

    def parsed(name: str) -> DataFrame:
        found = PARSERS[name](read.where(F.col("parser") == name))
        return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns])

    asked = [r.parser for r in todo.select("parser").distinct().collect()]     # some of PARSERS
    if asked:
        (reduce(DataFrame.unionByName, [parsed(name) for name in sorted(asked)])
         .write.partitionBy("parser").parquet(f"{store}/posts/run={run}"))
        todo.select(CONTENT).write.parquet(f"{store}/done/run={run}")
    runs = [r.run for r in done().select("run").distinct().collect()]
    kept = [f"{store}/posts/run={r}" for r in sorted(runs) if r != "none"]
    posts = (spark.read.schema(", ".join(DDL.split(", ")[1:]) + ", parser STRING, run STRING")
             .option("basePath", f"{store}/posts").parquet(*kept).select(columns)
             if kept else empty_table(spark, DDL))
    return Postings(places, posts)


def first_existing(places: DataFrame, paths: list[str]) -> DataFrame:
    """(forge, repo, path) of the first existing path in priority order.

    Reads only the key columns, so no file text is shuffled to decide it.
    """
    prio = F.array_position(F.lit(paths), F.col("path"))
    return (places.where(F.col("path").isin(paths)).groupBy(*REPO)
            .agg(F.min(prio).alias("_p"))
            .select(*REPO, F.element_at(F.lit(paths), F.col("_p").cast("int")).alias("path")))
