"""Which persons the tables of a snapshot name in connection with which projects.

An evidence operator can find nothing for a person whom none of its tables names with the project.  Candidates are
many more than that: whoever belongs to an organisation is one of each of its projects.  So a run that asks for
evidence alone looks up the candidates among the pairs named here.  They are found by key, not by candidate: rosters,
postings, claims and pages are joined with the keys of persons, running text with their names.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import markup, urls
from ..functions.text import all_matches, first_last, fold, handle_key
from ..schemas import Inputs
from . import people, registry
from .containment import contains_join
from .postings import Postings

#: Shortest name that any operator looks for in running text.
_MIN_NAME = 4


@dataclass(frozen=True)
class Teams:
    """Teams that projects name. Their members are not listed with each project: members times projects grow with the
    square of the input, and few are candidates."""

    places: DataFrame       # key, team: a project's name in lower case, a team it names
    members: DataFrame      # person_id, team


def _row(df: DataFrame, kind: str, key) -> DataFrame:
    return df.select(F.lower("repo").alias("project"), F.lit(kind).alias("kind"), key.alias("key"))


def _listed(df: DataFrame) -> DataFrame:
    return df.select(F.lower("repo").alias("project"), "kind", "key")


def _at_handles(df: DataFrame, column: str) -> DataFrame:
    return _row(df.select("repo", F.explode(F.array_distinct(F.transform(
        all_matches(F.col(column), fixed.MENTION), F.lower))).alias("h")), "handle", F.col("h"))


def _spelled(df: DataFrame, inputs: Inputs) -> DataFrame:
    """Rows of curated projects under every spelling of their name."""
    return registry.for_candidates(df, inputs.known, inputs.known_aliases).drop("known_repo").withColumnRenamed("key", "repo")


def _sources(inputs: Inputs) -> DataFrame:
    """(repo, url) of curated and discovered role pages."""
    found = inputs.discovered_sources.select("repo", "url")
    return found.unionByName(_spelled(inputs.role_sources.select("repo", "url"), inputs)).distinct()


def _titles(inputs: Inputs) -> DataFrame:
    """(repo, title) of curated and resolved articles."""
    resolved = inputs.articles.where("repo IS NOT NULL AND title <> ''").select("repo", "title")
    return resolved.unionByName(_spelled(inputs.known.where("wikipedia <> ''").select(
        "repo", F.col("wikipedia").alias("title")), inputs)).distinct()


def _by_key(inputs: Inputs, posted: Postings) -> DataFrame:
    """(project, kind, key): every handle, e-mail and name that stands by itself in some table."""
    from .evidence import credits, documents
    owners = documents.scoped_owners(documents.codeowner_entries(posted))
    linked = _sources(inputs).join(inputs.pages, "url").select("repo", F.explode(markup.page_handles(F.col("html"))).alias("h"))
    login = lambda df, c: _row(df, "handle", handle_key(F.col(c)))
    lists = ["owners", "maintainers", "proposal rst", "proposal yaml"]
    return reduce(DataFrame.unionByName, [
        login(inputs.roster, "login"), login(inputs.releases, "author_login"), login(inputs.commits, "login"),
        login(inputs.claims, "handle"), login(_spelled(inputs.curated_roles.select("repo", "login"), inputs), "login"),
        login(inputs.founder_claims, "handle"), _row(inputs.founder_claims, "name", fold(F.col("name"))),
        login(owners.where("kind = 'handle'"), "owner"), _row(owners.where("kind = 'email'"), "email", fold(F.col("owner"))),
        _listed(posted.rows(*lists)), _listed(posted.manifests()),
        _row(linked, "handle", F.col("h")), _at_handles(documents.governance_windows(posted), "window"),
        _at_handles(credits.credit_lines(posted), "credit")]).where("key IS NOT NULL").distinct()


def _by_text(inputs: Inputs, posted: Postings, names: DataFrame) -> DataFrame:
    """(person_id, project) of the names in credit lines, governance windows and role pages."""
    from .evidence import credits, documents
    found = names.select("person_id", F.lit(None).cast("string").alias("project")).where("false")
    pairs = lambda df: df.join(names, "name").select("person_id", "project")
    texts = reduce(DataFrame.unionByName, [
        documents.governance_windows(posted).where("council OR maint").select("repo", F.lower("window").alias("text")),
        credits.credit_lines(posted).select("repo", "text")])
    if not texts.isEmpty():
        found = found.unionByName(pairs(contains_join(
            texts.select(F.lower("repo").alias("project"), "text"), names, ["project"], min_len=_MIN_NAME)))
    # A page that many projects name is searched once.
    sources = _sources(inputs)
    used = inputs.pages.join(sources.select("url").distinct(), "url", "left_semi")
    if not used.isEmpty():
        named = contains_join(used.select("url", markup.page_text(F.col("html")).alias("text")), names, ["url"], min_len=_MIN_NAME)
        found = found.unionByName(pairs(named.join(sources, "url").select(F.lower("repo").alias("project"), "name")))
    return found


def _by_article(inputs: Inputs, names: DataFrame) -> DataFrame:
    """(person_id, project) of the authors that an article credits, by whole name or first and last."""
    credited = _titles(inputs).join(inputs.articles.select("title", "wikitext"), "title").select(
        F.lower("repo").alias("project"), F.explode(markup.article_authors(F.col("wikitext"))).alias("n"))
    both = lambda name: F.explode(F.array(fold(name), first_last(name))).alias("name")
    mine = names.select("person_id", both(F.col("name")))
    return credited.select("project", both(F.col("n"))).where("name IS NOT NULL").distinct().join(mine, "name").select("person_id", "project")


def _by_package(inputs: Inputs, keys: DataFrame, packages: DataFrame | None) -> DataFrame:
    """(person_id, project) of packages that name the project, or are named like it."""
    from ..sources.packages import pypi_authors
    spelled = [inputs.repos.select("repo"), inputs.manual.select("repo"), _spelled(inputs.known.select("repo"), inputs)]
    guesses = reduce(DataFrame.unionByName, spelled).distinct().select(
        F.lower("repo").alias("project"), F.explode(urls.package_name_guesses(F.col("repo"))).alias("name"))
    probed = pypi_authors(inputs.package_docs).select("name", "kind", "key").join(keys, ["kind", "key"]).select(
        "person_id", "name").distinct().join(guesses, "name").select("person_id", "project")
    return probed if packages is None else probed.unionByName(
        packages.where("repo IS NOT NULL").select("person_id", F.lower("repo").alias("project")))


def team_mentions(inputs: Inputs, keys: DataFrame, posted: Postings) -> Teams:
    """The teams that CODEOWNERS files name, and the persons in them."""
    from .evidence import documents
    owners = documents.scoped_owners(documents.codeowner_entries(posted)).where("kind = 'team'")
    places = owners.select(F.lower("repo").alias("key"), F.lower("owner").alias("team")).distinct()
    members = inputs.teams.select(F.lower(F.concat(F.lit("@"), "org", F.lit("/"), "team")).alias("team"),
                                  F.lit("handle").alias("kind"), handle_key(F.col("login")).alias("key"))
    return Teams(places, members.join(keys, ["kind", "key"]).select("person_id", "team").distinct())


def mentions(inputs: Inputs, keys: DataFrame, posted: Postings, packages: DataFrame | None = None,
             teams: bool = True) -> DataFrame:
    """Distinct (person_id, key) of the persons that some table names with a project, its name in lower case.

    Without `teams` the members of teams are left to whoever asks for `team_mentions`.
    """
    names = people.names(keys)
    by_key = _by_key(inputs, posted).join(keys, ["kind", "key"]).select("person_id", "project")
    found = [by_key, _by_text(inputs, posted, names), _by_article(inputs, names), _by_package(inputs, keys, packages)]
    if teams:
        named = team_mentions(inputs, keys, posted)
        found.append(named.places.withColumnRenamed("key", "project").join(named.members, "team").select("person_id", "project"))
    return reduce(DataFrame.unionByName, found).select("person_id", F.col("project").alias("key")).distinct()
