"""What runs learn, kept between them: accounts, the login index, popularity and role pages.

Each is a merged table, so a run adds what it learnt as one commit and rewrites nothing; a
run that is repeated after it died adds the same commits again, and those it had made are
skipped.  The next run reads them beside its snapshot.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import accounts as ac, discovery, people, registry
from ..operators.index import build_index
from ..schemas import Inputs
from ..streaming.index import index_table
from ..streaming.merged import MergedTable
from . import run as plan
from .lineage import cut

_ACCOUNT = ["person_id", "forge", "login"]


def _last(columns: list[str], keys: list[str]):
    """Per key and column the value of the newest run that has one."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("run"))).alias(c)
    return lambda rows: rows.groupBy(*keys).agg(*[newest(c) for c in columns], F.max("run").alias("run"))


def _first_source(rows: DataFrame) -> DataFrame:
    """One row a page: as the earliest run found it."""
    return rows.groupBy("repo", "url").agg(F.min_by(F.struct("role", "label", "run", "pos"), F.struct("run", "pos")).alias("b")).select(
        "repo", "url", "b.*")


@dataclass(frozen=True)
class State:
    """The tables below a folder that executors share."""

    spark: SparkSession
    path: str

    def _table(self, name: str, ddl: str, keys: list[str], fold) -> MergedTable:
        return MergedTable(self.spark, f"{self.path}/{name}", ddl, tuple(keys), fold)

    @property
    def accounts(self) -> MergedTable:
        return self._table("accounts", "person_id BIGINT, forge STRING, login STRING", _ACCOUNT, lambda rows: rows.select(_ACCOUNT).distinct())

    @property
    def index(self) -> MergedTable:
        return index_table(self.spark, f"{self.path}/index")

    @property
    def popularity(self) -> MergedTable:
        measures = ["stars", "forks", "contributors"]
        return self._table("popularity", "repo STRING, stars BIGINT, forks BIGINT, contributors BIGINT, run BIGINT", ["repo"], _last(measures, ["repo"]))

    @property
    def role_sources(self) -> MergedTable:
        return self._table("role_sources", "repo STRING, url STRING, role STRING, label STRING, run BIGINT, pos INT", ["repo", "url"], _first_source)

    def next_run(self) -> int:
        """The number of the next run: one more than the last that all tables have."""
        return min(t.state()["batch"] for t in (self.accounts, self.index, self.popularity, self.role_sources)) + 1


def confirmed_accounts(inputs: Inputs, cfg: Config) -> DataFrame:
    """(person_id, forge, login): every account of each person, by links between them and sites."""
    anchors = inputs.accounts.select(_ACCOUNT).unionByName(inputs.people.select(
        "person_id", F.lit("github").alias("forge"), F.col("primary_login").alias("login"))).where("login <> ''").distinct()
    return ac.resolve_accounts(anchors, inputs.profile_links, inputs.pages, inputs.accounts, max_accounts=cfg.max_accounts,
                               max_hub_accounts=cfg.max_hub_accounts)


def with_accounts(inputs: Inputs, known: DataFrame) -> Inputs:
    """The snapshot with accounts it does not list."""
    listed = inputs.accounts.select("person_id", "forge", F.lower("login").alias("login"))
    more = known.join(listed, _ACCOUNT, "left_anti")
    return inputs.with_tables(accounts=inputs.accounts.unionByName(more, allowMissingColumns=True))


def with_state(inputs: Inputs, state: State) -> Inputs:
    """The snapshot with what earlier runs learnt."""
    popular = state.popularity.read().withColumnRenamed("contributors", "n_contributors").withColumn("capped", F.lit(False))
    pages = registry.merge_role_sources(inputs.role_sources, state.role_sources.read().select("repo", "pos", "url", "role", "label"))
    curated = inputs.known.select("repo").distinct()
    # Popularity does not make a project curated: only curated ones take it.
    of_known = popular.join(registry.known_keys(inputs.known, inputs.known_aliases).select("key"), F.lower("repo") == F.col("key"), "left_semi")
    return inputs.with_tables(
        known=registry.upsert_popularity(inputs.known, inputs.known_aliases, of_known),
        role_sources=pages.join(curated, "repo", "left_semi").withColumn("pos", F.lit(0)),
        reverse_index=inputs.reverse_index.unionByName(state.index.read()))


def scan(inputs: Inputs, cfg: Config, path: str) -> plan.Outputs:
    """A run that reads the state below `path` and adds to it.

    Accounts are linked first, over those that earlier runs confirmed; the snapshot's own
    metadata fills records without stars; then the run's popularity, rosters and discovered
    role pages are added.
    """
    state = State(inputs.people.sparkSession, path)
    number = state.next_run()
    confirmed = cut(people.merge_identities(confirmed_accounts(inputs, cfg), state.accounts.read()))
    seen = with_state(with_accounts(inputs, confirmed), state)
    out = plan.run(seen, cfg, f"{path}/postings", meta=discovery.merge_metadata(inputs.repos))
    state.accounts.add(confirmed, number)
    state.index.add(build_index(inputs.roster.where("forge = 'github'"), cfg.min_index_commits).withColumn("batch", F.lit(number).cast("bigint")), number)
    observed = out.records.groupBy("repo").agg(
        F.max("stars").alias("stars"), F.max("forks").alias("forks"),
        F.max(F.when(~F.col("capped"), F.col("n_contributors"))).alias("contributors")).withColumn("run", F.lit(number).cast("bigint"))
    state.popularity.add(observed, number)
    found = inputs.discovered_sources.where("url <> ''").select(
        "repo", "url", F.coalesce("role", F.lit("maintainer")).alias("role"), "label", F.lit(number).cast("bigint").alias("run"), "pos")
    state.role_sources.add(found, number)
    return out
