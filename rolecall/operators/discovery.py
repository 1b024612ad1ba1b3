"""Candidate projects of every person: union of sources, metadata, gates."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..config import Config
from ..functions import roles, urls
from ..functions.text import all_matches, fold
from ..schemas import Inputs
from . import people, registry, roster
from .containment import contains_join, only_wanted
from .postings import Postings, base_name, index_files

REPO = ["forge", "repo"]


# --- sources ---------------------------------------------------------------
def hits(df: DataFrame, source, forge="github") -> DataFrame:
    """(person_id, forge, repo, mask) rows of one discovery source."""
    mask = source if isinstance(source, Column) else F.lit(roles.bits(source)).cast("bigint")
    f = F.col("forge") if "forge" in df.columns else F.lit(forge)
    return df.select("person_id", f.alias("forge"), "repo", mask.alias("mask"))


def fork_parents(owned: DataFrame, repos: DataFrame) -> DataFrame:
    """Upstream projects of owned forks."""
    return owned.join(
        repos.where("is_fork AND parent IS NOT NULL").select(*REPO, "parent"), REPO).select(
        "person_id", "forge", F.col("parent").alias("repo"))


def top_org_repos(repos: DataFrame, limit: int | None = None) -> DataFrame:
    """The most-starred repositories of each owner, all of them without a limit."""
    if limit is None:
        return repos.select(F.lower("owner").alias("org"), *REPO)
    w = W.partitionBy("forge", "org").orderBy(F.desc_nulls_last("stars"), "repo")
    return (repos.select(*REPO, F.lower("owner").alias("org"), "stars")
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
            .select("org", *REPO))


def commit_history(commits: DataFrame, handles: DataFrame) -> DataFrame:
    """Repositories a person committed to, in any year."""
    seen = commits.select(F.lower("login").alias("login"), *REPO).distinct()
    return seen.join(handles, "login").select("person_id", *REPO).distinct()


def commits_by_name(commits: DataFrame, names: DataFrame) -> DataFrame:
    """Repositories with commits under a person's name (short names are too ambiguous)."""
    seen = commits.select(fold(F.col("author_name")).alias("name"), *REPO).distinct()
    return seen.join(names.where(F.length("name") >= 5), "name").select(
        "person_id", *REPO).distinct()


def handle_mentions(posted: Postings, people_: DataFrame) -> DataFrame:
    """Role files that mention a primary login as a word."""
    logins = people_.select("person_id", F.lower("primary_login").alias("login"))
    # Most words are nobody's login.
    mentioned = posted.naming(logins.select(F.col("login").alias("key"))).rows("words").select(
        *REPO, base_name(F.col("path")).alias("base"), F.col("key").alias("login")).distinct()
    return mentioned.join(logins, "login").select(
        "person_id", *REPO, F.concat(F.lit("search:"), "base").alias("source"))


def name_mentions(posted: Postings, names: DataFrame) -> DataFrame:
    """Credit files that contain a person's full name, which never spans lines."""
    credit = posted.rows("credits").withColumn("base", base_name(F.col("path"))).where(
        F.col("base").isin(fixed.NAME_SEARCH_FILES)).select(
        *REPO, "path", "line", "base", F.lower("text").alias("text"))
    found = contains_join(credit, names, [*REPO, "path", "line", "base"], min_len=5)
    return found.select(*REPO, "base", "name").distinct().join(names, "name").select(
        "person_id", *REPO, F.concat(F.lit("namesearch:"), "base").alias("source")).distinct()


def profile_readme_links(files: DataFrame, people_: DataFrame) -> DataFrame:
    """Repositories linked from the README of a person's profile repository."""
    own = people_.select("person_id", F.col("primary_login").alias("login"))
    readme = files.where("path = 'README.md'").withColumn("login", urls.repo_owner(F.col("repo")))
    readme = readme.where(F.col("repo") == F.concat("login", F.lit("/"), "login"))
    return readme.join(own, "login").select(
        "person_id", "forge", F.explode(urls.readme_repo_links(F.col("text"))).alias("repo"))


def of_named(df: DataFrame, within: DataFrame | None) -> DataFrame:
    """The rows of the projects that pairs (person_id, key) name, and few others; all rows without pairs.

    Rows are dropped where they are read: what other projects have is not shuffled.
    """
    if within is None:
        return df
    wanted = within.select(F.xxhash64("key").alias("key"))
    return only_wanted(df.withColumn("key", F.xxhash64(F.lower("repo"))), wanted).drop("key")


def named_projects(within: DataFrame | None, teams) -> DataFrame | None:
    """(key) of the projects that pairs or teams name."""
    return within if within is None or teams is None else within.select("key").unionByName(teams.places.select("key"))


def team_pairs(teams, said: DataFrame, orgs: DataFrame, top: DataFrame) -> DataFrame:
    """Distinct (person_id, key) of the members of each project's `teams` whom a source, or an organisation, makes candidates
    of it: what is said is looked up, and members of organisations meet by team as well."""
    key = F.lower("repo").alias("key")
    listed = said.select("person_id", key).distinct().join(teams.members, "person_id").join(teams.places, ["key", "team"])
    owned = teams.places.join(top.select("org", key).distinct(), "key").join(
        teams.members.join(orgs, "person_id"), ["org", "team"])
    return listed.select("person_id", "key").unionByName(owned.select("person_id", "key")).distinct()


def discovery_union(inputs: Inputs, keys: DataFrame, packages: DataFrame,
                    registry_hits: DataFrame, cfg: Config, posted: Postings,
                    within: DataFrame | None = None, teams=None) -> DataFrame:
    """All sources, one row per (person, forge, repo, source occurrence).

    `within`, distinct (person_id, key) with a project's name in lower case, asks for these pairs only, and those of the
    members of `teams`. The members of an organisation times its projects are far more than any other source, so they
    are looked up, not made.
    """
    from ..plans.lineage import cut
    orgs, top = people.org_logins(inputs.person_orgs), top_org_repos(inputs.repos, cfg.org_repo_limit)
    said = _said(inputs, keys, packages, registry_hits, posted, named_projects(within, teams))
    if within is not None and teams is not None:
        said = cut(merge_hits(said))
        within = cut(within.unionByName(team_pairs(teams, said, orgs, top)).distinct())
    members = orgs.join(top, "org") if within is None else (
        within.join(top.withColumn("key", F.lower("repo")), "key").join(orgs, ["person_id", "org"]))
    found = said.unionByName(hits(members, "org-repo"))
    return found if within is None else found.withColumn("key", F.lower("repo")).join(
        within, ["person_id", "key"], "left_semi").drop("key")


def _said(inputs: Inputs, keys: DataFrame, packages: DataFrame, registry_hits: DataFrame, posted: Postings,
          within: DataFrame | None = None) -> DataFrame:
    """The sources that name a person with a project: all but membership."""
    handles, names = people.handles(keys), people.names(keys)
    listed, commits = inputs.discovery_hits, of_named(inputs.commits, within)
    branches = [
        hits(of_named(listed, within), roles.source_bit(F.col("source"))),
        hits(fork_parents(listed.where("source = 'owned'"), inputs.repos), "fork-parent"),
        hits(commit_history(commits, handles), "history"),
        hits(profile_readme_links(inputs.files, inputs.people), "profile"),
        hits(commits_by_name(commits, names), "commit-search"),
        hits(packages.where("repo IS NOT NULL"),
             roles.source_bit(F.concat(F.lit("pkg:"), "registry"))),
        hits(inputs.reverse_index.withColumn("login", F.lower("login")).join(handles, "login")
             .where("repo LIKE '%/%'"), "reverse-index"),
        hits(registry_hits, "registry"),
        hits(inputs.manual.where("repo LIKE '%/%'"), "manual"),
    ]
    mentioned = handle_mentions(posted, inputs.people)
    branches.append(hits(mentioned, roles.source_bit(F.col("source"))))
    credited = name_mentions(posted, names)
    branches.append(hits(credited, roles.source_bit(F.col("source"))))
    return reduce(DataFrame.unionByName, branches)


def merge_hits(union: DataFrame) -> DataFrame:
    """One candidate per (person, forge, repo); its sources are one bit mask.

    A bitwise OR over a BIGINT is combined on the map side in a hash aggregate,
    which a set of strings is not.
    """
    return (union.where("repo IS NOT NULL").groupBy("person_id", *REPO)
            .agg(F.bit_or("mask").alias("mask")))


# --- members of organisations ------------------------------------------------
#: Pairs of a cell, about: members of an organisation times some of its projects.
_CELL = 1 << 20
#: Members that one row of a project leaves out, about.
_LIST = 1 << 10


def lone_members(orgs: DataFrame, places: DataFrame, held: DataFrame) -> DataFrame:
    """Members of each organisation times its projects, without the pairs (person_id, forge, repo) of `held`.

    No other table has so many rows, hence these are made last and not shuffled: a project carries the members it leaves
    out (beyond about `_LIST` they are dealt by hash, to a row each), and the projects of an organisation meet its members
    in cells of about `_CELL` pairs, however large it is.
    """
    from ..plans.lineage import cut
    spark = places.sparkSession
    count = lambda df, name: df.groupBy("org").agg(F.count(F.lit(1)).alias(name))
    sizes = cut(count(orgs, "_m").join(count(places, "_r"), "org").select(
        "org", F.ceil(F.col("_m") * F.col("_r") / F.lit(_CELL)).alias("_cells")))
    cells = sizes.agg(F.sum("_cells")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-cells // 4))

    dealt = F.pmod(F.xxhash64("person_id"), F.col("_lists"))
    lists = held.groupBy(*REPO).agg(F.ceil(F.count(F.lit(1)) / F.lit(_LIST)).alias("_lists"))
    left_out = held.join(lists, REPO).groupBy(*REPO, dealt.alias("_list")).agg(
        F.collect_list("person_id").alias("_held"))
    listed = (places.join(lists, REPO, "left").withColumn("_lists", F.coalesce("_lists", F.lit(1)))
              .withColumn("_list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lists") - 1)))
              .join(left_out, [*REPO, "_list"], "left"))
    projects = (listed.join(sizes, "org").withColumn("_cell", F.pmod(F.xxhash64(*REPO), F.col("_cells")))
                .drop("_cells").repartition(tasks, "org", "_cell"))
    members = (orgs.join(sizes, "org").withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cells") - 1)))
               .drop("_cells").repartition(tasks, "org", "_cell"))
    return projects.join(members.hint("merge"), ["org", "_cell"]).where(
        ((F.col("_lists") == 1) | (dealt == F.col("_list")))
        & ~F.coalesce(F.array_contains("_held", F.col("person_id")), F.lit(False))).drop(
        "_cell", "_lists", "_list", "_held")


def _with_members(said: DataFrame, orgs: DataFrame, places: DataFrame,
                  also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, held): one row per pair that a source of `said` names, or that is a member's and in `also`, with the
    members' bit; and the members' pairs among them."""
    from ..plans.lineage import cut
    said = cut(merge_hits(said))
    pairs = said.select("person_id", *REPO)
    pairs = pairs if also is None else pairs.unionByName(also.select("person_id", *REPO))
    held = cut(pairs.join(places.select("org", *REPO), REPO).join(orgs, ["person_id", "org"], "left_semi")
               .select("person_id", *REPO).distinct())
    return merge_hits(said.unionByName(hits(held, "org-repo"))), held


def merge_sources(inputs: Inputs, keys: DataFrame, packages: DataFrame, registry_hits: DataFrame,
                  cfg: Config, posted: Postings) -> DataFrame:
    """`merge_hits` of all sources, where `repos` has one row per repository; members' pairs that no other source names
    are not shuffled."""
    orgs, top = people.org_logins(inputs.person_orgs), top_org_repos(inputs.repos, cfg.org_repo_limit)
    merged, held = _with_members(_said(inputs, keys, packages, registry_hits, posted), orgs, top)
    return merged.unionByName(hits(lone_members(orgs, top, held), "org-repo"))


# --- metadata --------------------------------------------------------------
def merge_metadata(observations: DataFrame) -> DataFrame:
    """One row per repository from several observations of it.

    Counts take the largest value seen (a null count was a degraded response, not
    a zero), flags and push date the latest observation that has them.
    """
    order = "seq" if "seq" in observations.columns else F.lit(0)
    return observations.groupBy(*REPO).agg(
        F.max("owner").alias("owner"), F.max("stars").alias("stars"), F.max("forks").alias("forks"),
        F.max_by(F.struct("is_fork", "is_private"), order).alias("flags"),
        F.max_by("pushed_at", F.when(F.col("pushed_at").isNotNull(), order)).alias("pushed_at"),
        F.max("parent").alias("parent")).select(
        *REPO, "owner", "stars", "forks", "flags.is_fork", "flags.is_private", "pushed_at", "parent")


def resolve_metadata(candidates: DataFrame, repos: DataFrame) -> DataFrame:
    """Candidates with metadata; a name nothing is known about counts as a fork."""
    meta = repos.select(*REPO, "stars", "forks", "is_fork", "is_private", "pushed_at",
                        F.lit(True).alias("found"))
    return (candidates.join(meta, REPO, "left")
            .withColumn("is_fork", F.when(F.col("found"), F.coalesce("is_fork", F.lit(False)))
                        .otherwise(True))
            .withColumn("is_private", F.coalesce("is_private", F.lit(False)))
            .withColumn("stars", F.coalesce("stars", F.lit(0).cast("bigint")))
            .withColumn("forks", F.coalesce("forks", F.lit(0).cast("bigint"))).drop("found"))


def keep_candidate(mask: Column, is_known: Column, is_fork: Column, is_private: Column,
                   include_private: bool = False) -> Column:
    """Vouched and curated projects stay; otherwise forks and private ones go."""
    private_ok = F.lit(True) if include_private else ~is_private
    return roles.is_manual(mask) | is_known | (~is_fork & private_ok)


# --- gates -----------------------------------------------------------------
def with_gates(candidates: DataFrame, keys: DataFrame, inputs: Inputs, standing: DataFrame,
               cfg: Config) -> DataFrame:
    """Candidates with every fact the evidence operators gate on.

    trusted, notable, genuine, manual, owns, the person's roster standing and the
    project URL are worked out once here, so no evidence operator repeats a join.
    """
    df = (candidates.withColumn("owner_key", _owner_key())
          .join(_ties(keys, inputs), ["person_id", "owner_key"], "left")
          .join(standing, ["person_id", *REPO], "left")
          .join(_hosts(inputs), "forge", "left"))
    return _gated(df, cfg)


def _owner_key() -> Column:
    return F.lower(urls.repo_owner(F.col("repo")))


def _ties(keys: DataFrame, inputs: Inputs) -> DataFrame:
    """(person_id, owner_key, tie): accounts (2) and organisations (1) of a person."""
    return (people.handles(keys).select("person_id", F.col("login").alias("owner_key"),
                                        F.lit(2).alias("tie"))
            .unionByName(people.org_logins(inputs.person_orgs).select(
                "person_id", F.col("org").alias("owner_key"), F.lit(1).alias("tie")))
            .groupBy("person_id", "owner_key").agg(F.max("tie").alias("tie")))


def _hosts(inputs: Inputs) -> DataFrame:
    return inputs.forges.select("forge", F.col("web_host"), F.col("has_stars"))


def _gated(df: DataFrame, cfg: Config) -> DataFrame:
    """Gates of candidates with their project's facts, the person's tie to its owner and their standing."""
    canonical = ((F.col("stars") >= cfg.canonical_stars) | (F.col("forks") >= cfg.canonical_forks))
    return df.select(
        "person_id", *REPO, "mask", "stars", "forks", "is_fork", "is_private", "pushed_at",
        "known_repo", "importance", "override", "snapshot", "wikipedia",
        F.coalesce("has_stars", F.lit(True)).alias("has_stars"),
        urls.repo_url(F.col("forge"), F.col("repo"), F.col("web_host")).alias("project_url"),
        F.coalesce(F.col("tie") == 2, F.lit(False)).alias("owns"),
        roles.is_manual(F.col("mask")).alias("manual"),
        roles.is_genuine(F.col("mask")).alias("genuine"),
        (roles.is_manual(F.col("mask")) | F.col("tie").isNotNull() | canonical).alias("trusted"),
        ((F.col("stars") >= cfg.role_discovery_floor) | (F.col("forks") >= cfg.canonical_forks)
         | F.col("known_repo").isNotNull()).alias("notable"),
        "commits", "rank", "n_fetched")


def discover(inputs: Inputs, keys: DataFrame, packages: DataFrame, registry_hits: DataFrame,
             cfg: Config, posted: Postings | None = None, within: DataFrame | None = None, teams=None) -> DataFrame:
    """Candidates worth scanning, with gates: all, or those among the pairs (person_id, key) of `within` and the members
    of `teams` (`mentions.Teams`)."""
    from ..plans.lineage import cut
    posted = posted or index_files(inputs, cfg.proposals_per_series)
    inputs = replace(inputs, repos=merge_metadata(inputs.repos))
    standing = roster.standings(of_named(inputs.roster, named_projects(within, teams)), people.handles(keys), cfg.contributor_pages)
    if within is not None:
        merged = merge_hits(discovery_union(inputs, keys, packages, registry_hits, cfg, posted, within, teams))
        return with_gates(_kept(merged, inputs, cfg), keys, inputs, standing, cfg)
    # A project's facts are worked out before its members are made, and a project that is not kept has none.
    orgs, top = people.org_logins(inputs.person_orgs), top_org_repos(inputs.repos, cfg.org_repo_limit)
    top = top.withColumn("owner_key", _owner_key())
    said = _said(inputs, keys, packages, registry_hits, posted).unionByName(
        # The name says another owner than the host: its members' ties have to be looked up.
        hits(orgs.join(top.where("NOT org <=> owner_key"), "org"), "org-repo"))
    top = top.where("org = owner_key")
    ranked = inputs.roster.withColumn("login", F.lower("login")).join(people.handles(keys), "login")
    merged, held = _with_members(said, orgs, top, ranked)
    named = with_gates(_kept(merged, inputs, cfg), keys, inputs, standing, cfg)
    bit = F.lit(roles.bits("org-repo")).cast("bigint")
    # Written: a host that all projects share would fold into a constant, and leave the join with hosts without a key.
    places = cut(_kept(top.withColumn("mask", bit), inputs, cfg)).join(_hosts(inputs), "forge", "left")
    tied = orgs.withColumn("owner_key", F.col("org")).join(_ties(keys, inputs), ["person_id", "owner_key"])
    none = {c: F.lit(None).cast(standing.schema[c].dataType) for c in ("commits", "rank", "n_fetched")}
    lone = _gated(lone_members(tied.drop("owner_key"), places, held).withColumns(none), cfg)
    return named.unionByName(lone)


def _kept(merged: DataFrame, inputs: Inputs, cfg: Config) -> DataFrame:
    """Projects of a person with metadata and registry facts, those worth scanning."""
    meta = resolve_metadata(merged, inputs.repos)
    known = registry.with_known(meta, inputs.known, inputs.known_aliases)
    return known.where(keep_candidate(
        F.col("mask"), F.col("known_repo").isNotNull(), F.col("is_fork"), F.col("is_private"),
        cfg.include_private))


def candidate_keys(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates times the keys of their person, carrying the gates.

    Documents are joined on (forge, repo, kind, key): a common name or a busy
    project is spread over many keys instead of meeting in one group.
    """
    return candidates.select(
        "person_id", *REPO, "project_url", "known_repo", "trusted", "notable", "genuine",
        "manual", "commits").join(keys, "person_id")
