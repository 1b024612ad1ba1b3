"""Evidence from role files: CODEOWNERS, OWNERS, MAINTAINERS, governance prose."""

from pyspark.sql import DataFrame, functions as F

from ... import fixed
from ...functions import urls
from ...functions.text import all_matches, fold, handle_key
from ...schemas import Inputs
from ..containment import contains_join
from ..postings import COUNCIL, MAINTAINER, Postings, first_existing, listed_keys  # noqa: F401
from .base import REPO, Context, emit, register


# --- CODEOWNERS ------------------------------------------------------------
def codeowner_entries(posted: Postings) -> DataFrame:
    """(forge, repo, path, line, pos, scope, owner, kind): every owner of every rule of
    the CODEOWNERS file that counts in each project."""
    return (posted.rows("codeowners").select(
        *REPO, "path", "line", "pos", "scope", F.col("key").alias("owner"), "kind")
        .join(first_existing(posted.places, fixed.CODEOWNERS_PATHS), [*REPO, "path"]))


def scoped_owners(entries: DataFrame) -> DataFrame:
    """Distinct (forge, repo, path, scope, owner) with the first place each occurs.

    One owner named in every rule of a section is one row from here on.
    """
    at = F.col("line").cast("bigint") * F.lit(1 << 20) + F.col("pos")
    return (entries.where("kind <> 'unknown'")
            .groupBy(*REPO, "path", "scope", "kind", F.col("owner"))
            .agg(F.min(at).alias("at")))


def codeowner_matches(owners: DataFrame, teams: DataFrame, keys: DataFrame) -> DataFrame:
    """(person, project, scope) with how the person is listed, first listing first."""
    direct = owners.where("kind <> 'team'").select(
        "*", F.when(F.col("kind") == "handle", handle_key(F.col("owner")))
              .otherwise(fold(F.col("owner"))).alias("key"),
        F.when(F.col("kind") == "handle", F.concat(
            F.lit("listed as "), "owner", F.lit(" in "), "path"))
         .otherwise(F.concat(F.lit("listed by email in "), "path")).alias("detail"))
    team = owners.where("kind = 'team'").select(
        *REPO, "path", "scope", "at", "owner",
        F.lower(F.regexp_extract("owner", fixed.TEAM_OWNER, 1)).alias("org"),
        F.lower(F.regexp_extract("owner", fixed.TEAM_OWNER, 2)).alias("team"))
    members = teams.select(F.lower("org").alias("org"), F.lower("team").alias("team"),
                           handle_key(F.col("login")).alias("key")).distinct()
    # Members meet the rules as candidates of the project: a team has far more members than a project has of them.
    mine = keys.where("kind = 'handle'").join(members, "key").select("person_id", *REPO, "project_url", "org", "team")
    by_team = team.join(mine, [*REPO, "org", "team"]).withColumn("detail", F.concat(
        F.lit("member of "), "owner", F.lit(" (CODEOWNERS in "), "path", F.lit(")")))
    cols = ["person_id", *REPO, "path", "scope", "project_url", "at", "detail"]
    listed = direct.join(keys, [*REPO, "kind", "key"]).select(cols).unionByName(by_team.select(cols))
    return (listed.groupBy("person_id", *REPO, "path", "scope", "project_url")
            .agg(F.min_by("detail", "at").alias("detail"), F.min("at").alias("at")))


@register("codeowners")
def codeowners(ctx: Context):
    """One row per owned scope; a copied, untrusted file counts for nothing."""
    owners = scoped_owners(codeowner_entries(ctx.postings))
    found = codeowner_matches(owners, ctx.inputs.teams, ctx.keys.where("trusted"))
    return emit(found, "codeowners", role="code_owner", seq=F.col("at"),
                url=urls.file_url(F.col("project_url"), F.col("path")), confidence=0.9,
                detail=F.col("detail"), qualifier=F.col("scope"))


# --- OWNERS and MAINTAINERS ------------------------------------------------
def owners_entries(posted: Postings, targets: DataFrame) -> DataFrame:
    """(forge, repo, path, prio, role, login): approvers and reviewers of OWNERS files.

    `targets` says which path, in which order, is an OWNERS file of a project.
    """
    return posted.rows("owners").join(targets, [*REPO, "path"]).select(
        *REPO, "path", "prio", "role", F.col("key").alias("login"))


def owners_targets(inputs: Inputs) -> DataFrame:
    """Paths of OWNERS files: those a curated convention names, else the root file."""
    from .. import registry
    conv = registry.for_candidates(
        inputs.role_conventions.where("extractor = 'maintainers' AND path <> ''"),
        inputs.known, inputs.known_aliases).select("key", "path", F.col("pos").alias("prio"))
    repos = inputs.files.select(*REPO, "path").withColumn("key", F.lower("repo"))
    curated = repos.join(conv, ["key", "path"]).select(*REPO, "path", "prio")
    root = (repos.where(F.col("path").isin(fixed.OWNERS_PATHS))
            .join(conv.select("key").distinct(), "key", "left_anti")
            .select(*REPO, "path", F.lit(0).alias("prio")))
    return curated.unionByName(root)


def owners_roles(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """The first OWNERS file that names the person decides; approver beats reviewer."""
    order = F.col("prio").cast("bigint") * 2 + F.when(F.col("role") == "maintainer", 0).otherwise(1)
    return (entries.join(keys.where("kind = 'handle'").withColumnRenamed("key", "login"),
                         [*REPO, "login"])
            .groupBy("person_id", *REPO, "project_url")
            .agg(F.min_by(F.struct("path", "role"), order).alias("b"))
            .select("person_id", *REPO, "project_url", "b.path", "b.role"))


def maintainer_entries(posted: Postings) -> DataFrame:
    """(forge, repo, path, line, kind, key): people of the first MAINTAINERS file."""
    return (posted.rows("maintainers").select(*REPO, "path", "line", "kind", "key")
            .join(first_existing(posted.places, fixed.MAINTAINERS_PATHS), [*REPO, "path"]))


@register("maintainers")
def maintainers(ctx: Context):
    """OWNERS approvers and reviewers; only without those, the MAINTAINERS file."""
    owned = owners_roles(owners_entries(ctx.postings, owners_targets(ctx.inputs)), ctx.keys)
    first = F.col("role") == "maintainer"
    from_owners = emit(
        owned, "maintainers", role=F.col("role"),
        url=urls.file_url(F.col("project_url"), F.col("path")),
        confidence=F.when(first, F.lit(0.85)).otherwise(0.8),
        detail=F.concat(F.when(first, "approver in ").otherwise("reviewer in "), "path"))
    # The first listed person that matches decides, by handle or e-mail before name.
    order = F.col("line").cast("bigint") * 2 + F.when(F.col("kind") == "name", 1).otherwise(0)
    listed = (maintainer_entries(ctx.postings).join(ctx.keys, [*REPO, "kind", "key"])
              .groupBy("person_id", *REPO, "project_url", "path").agg(F.min(order).alias("o"))
              .join(owned, ["person_id", *REPO], "left_anti"))
    by_name = F.col("o") % 2 == 1
    from_list = emit(
        listed, "maintainers", role="maintainer",
        url=urls.file_url(F.col("project_url"), F.col("path")),
        confidence=F.when(by_name, F.lit(0.5)).otherwise(0.85),
        detail=F.concat(F.when(by_name, "name listed in ").otherwise("listed in "), "path"))
    return from_owners.unionByName(from_list)


# --- governance ------------------------------------------------------------
def governance_windows(posted: Postings) -> DataFrame:
    """(forge, repo, path, line, window, council, maint): sliding windows of the first
    governance file of each project."""
    near = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) > 0
    return posted.rows("governance").select(
        *REPO, "path", "line", F.col("text").alias("window"), near(COUNCIL).alias("council"),
        near(MAINTAINER).alias("maint")).join(
        first_existing(posted.places, fixed.GOVERNANCE_PATHS), [*REPO, "path"])


def governance_matches(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """Best governance match of each person: highest confidence, then earliest window."""
    grade = F.when(F.col("council"), 70).when(F.col("maint"), 65).otherwise(45)
    by_handle = windows.select(
        *REPO, "path", "line", grade.alias("grade"), F.lit("handle").alias("kind"),
        F.explode(F.array_distinct(F.transform(
            all_matches(F.col("window"), fixed.MENTION), F.lower))).alias("key"))
    # Per handle one row: the strongest, earliest mention.
    code = lambda g, line, how: (F.col(g).cast("bigint") * (1 << 40)
                                 - F.col(line).cast("bigint") * 2 - how)
    handles = by_handle.groupBy(*REPO, "path", "kind", "key").agg(
        F.max(code("grade", "line", F.lit(0))).alias("code"))
    near = windows.where("council OR maint").select(
        *REPO, "path", "line", F.lower("window").alias("text"),
        F.when(F.col("council"), 45).otherwise(40).alias("grade"))
    wanted = keys.where("kind = 'name'").select(*REPO, F.col("key").alias("name")).distinct()
    named = contains_join(near, wanted, [*REPO, "path", "line", "grade"], on=REPO, min_len=4)
    names = named.groupBy(*REPO, "path", F.lit("name").alias("kind"), F.col("name").alias("key")).agg(
        F.max(code("grade", "line", F.lit(1))).alias("code"))
    best = (handles.unionByName(names).join(keys, [*REPO, "kind", "key"])
            .groupBy("person_id", *REPO, "project_url", "path").agg(F.max("code").alias("code")))
    grade = F.ceil(F.col("code") / F.lit(1 << 40)).cast("int")
    by_name = F.pmod(F.col("code"), F.lit(2)) == 1
    return best.withColumn("grade", grade).withColumn("by_name", by_name).drop("code")


@register("governance")
def governance(ctx: Context):
    found = governance_matches(governance_windows(ctx.postings), ctx.keys)
    g = F.col("grade")
    text = (F.when(g == 70, "handle near council keyword").when(g == 65, "handle near maintainer keyword")
             .when((g == 45) & F.col("by_name"), "name near council keyword")
             .when(g == 45, "handle in governance doc").otherwise("name near maintainer keyword"))
    return emit(found, "governance",
                role=F.when(g.isin(65, 40), "maintainer").otherwise("steering_council"),
                url=urls.file_url(F.col("project_url"), F.col("path")),
                confidence=F.when(g == 70, F.lit(0.7)).when(g == 65, 0.65)
                            .when(g == 45, 0.45).otherwise(0.4),
                detail=F.concat(text, F.lit(" ("), "path", F.lit(")")))
