"""The flagship query and the whole run."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import report
from ..operators.mentions import mentions, team_mentions
from ..operators.postings import EVIDENCE_PARSERS, index_files
from ..plans import run as plan
from ..plans.lineage import cut
from ..sources import packages as pkg
from . import decisions, documents as docs, feeds
from .base import BODIES, check, view
from .bindings import CFG
from .rosters import context
from .scoring import _O, _W, _tier

view("b_flag", """
SELECT c.person_id, c.repo, c.stars, c.forks, c.pushed_at, c.manual, c.override, c.stars AS pop,
       CASE WHEN c.own THEN 'author' ELSE 'core_contributor' END AS role,
       CASE WHEN c.own THEN CAST(0.9 AS DOUBLE) ELSE e.confidence END AS confidence,
       CASE WHEN c.own THEN CAST(0.86 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS w,
       concat_ws(', ', CASE WHEN c.own THEN 'Author' END, CASE WHEN e.rank IS NOT NULL THEN
         'Core contributor (#' || e.rank || '/' || CASE WHEN k.snapshot IS NOT NULL THEN '~' ||
           CAST(round_even(k.snapshot / pow(10, length(CAST(k.snapshot AS VARCHAR)) - 2), 0) AS BIGINT)
           * CAST(pow(10, length(CAST(k.snapshot AS VARCHAR)) - 2) AS BIGINT)
         ELSE CAST(e.n_contributors AS VARCHAR) END || ')' END) AS label
FROM (SELECT *, owns AND NOT is_fork AND commits IS NOT NULL AS own FROM b_cand) c
LEFT JOIN b_earned e ON e.person_id = c.person_id AND e.repo = c.repo
LEFT JOIN b_known k ON k.repo = c.repo WHERE c.own OR e.repo IS NOT NULL""")


@check("flagship_top_projects", f"""
SELECT person_id, position, '- ' || repo || ' (' || CASE WHEN stars >= 1000 THEN
         CAST(round_even(stars / 1000.0, 0) AS BIGINT) || 'k' ELSE CAST(stars AS VARCHAR) END || '★) — ' || label AS line
FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY log10(pop + 10) * w * confidence DESC, repo)
        AS position FROM (SELECT *, {_tier(50)} AS tier FROM b_flag) WHERE tier = 'primary')
WHERE position <= 10""")
def flagship_top_projects(t):
    """Top ten projects of every person, with role, rank and stars."""
    candidates = context(t).candidates
    ev = cut(plan.attribute(t.inputs, candidates, t.keys, None, CFG, only=["ownership", "contributors"]))
    records = plan.standing(ev, candidates, t.inputs, CFG)
    return report.highlights(records, ev, 10).select(
        "person_id", F.col("position").cast("bigint").alias("position"), "line")


def full_inputs(t):
    """The snapshot with rows for every evidence operator."""
    from ..sources import claims as src
    files, entries = docs.proposals(t)
    parts = t.known.select("repo", F.lit(0).alias("pos"), F.lit("lib").alias("path"),
                           F.lit("author").alias("role"), F.lit("Core").alias("label"))
    i = t.inputs
    made = dict(
        people=t.people, accounts=t.accounts, person_orgs=t.person_orgs, repos=i.repos, roster=i.roster,
        discovery_hits=i.discovery_hits, known=i.known, manual=i.manual, pull_requests=i.pull_requests,
        files=docs.all_files(t), dir_entries=entries, teams=docs.teams(t), releases=decisions.project_releases(t),
        commits=decisions.path_commits(t), pages=feeds.pages(t).drop("page_id"), role_sources=feeds.role_sources(t),
        discovered_sources=feeds.discovered_sources(t), curated_roles=feeds.curated_roles(t), subcomponents=parts,
        package_docs=feeds.package_docs(t), claims=src.read_claims(feeds.claim_docs(t)),
        founder_claims=src.founder_claims(feeds.founder_docs(t)), articles=feeds.articles(t))
    # A snapshot is a set of stored tables, not of views over other tables.
    return i.with_tables(**{name: cut(df) for name, df in made.items()})


def _of(name: str, source: str | None = None, role: str | None = None, detail: str = "detail", where: str = "TRUE") -> str:
    """The evidence of one operator, by the statement of its own check."""
    return (f"SELECT person_id, repo, {'source' if source is None else repr(source)} AS source, "
            f"{'role' if role is None else repr(role)} AS role, confidence, {detail} AS detail FROM ({BODIES[name]}) WHERE {where}")


_KNOWN = "repo IN (SELECT repo FROM b_known)"
view("b_run", "\nUNION ALL\n".join([
    _of("ownership_evidence", "ownership", detail="'owns the repository and commits to it (author/creator)'"),
    _of("codeowners_evidence", "codeowners", "code_owner"), _of("maintainers_evidence", "maintainers"),
    _of("manifest_evidence", "manifests"), _of("proposal_authorship", "enhancement_proposals", "standards_author"),
    _of("governance_evidence", "governance"), _of("contributor_evidence", "contributors", "core_contributor"),
    """SELECT person_id, repo, 'subcomponents', 'core_contributor', CAST(CASE WHEN n >= 50 THEN 0.85 WHEN n >= 15 THEN 0.7 ELSE 0.55 END AS DOUBLE),
         n || ' commits to Core' FROM (SELECT person_id, repo, max(n) AS n FROM (
           SELECT person_id, repo, login, count(DISTINCT sha) AS n FROM b_paths WHERE dir LIKE 'lib%' GROUP BY ALL) GROUP BY ALL)
       JOIN b_cand c USING (person_id, repo) WHERE n >= 5 AND c.known""",
    _of("credit_evidence", "authors"), _of("page_roles", "web_roles", where=_KNOWN), _of("discovered_page_roles", "web_roles_auto"),
    _of("package_evidence"), _of("curated_evidence", "curated", where=_KNOWN), _of("claim_evidence", "wikidata"),
    _of("article_evidence", "wikipedia_authors", "author"), _of("release_evidence", "release_manager", "release_manager"),
    _of("founder_evidence", "founders", "author", "CASE WHEN confidence < 0.7 THEN 'named as founder/creator by name' ELSE 'named as founder/creator' END")]))


def _attributed(t):
    """(evidence of all operators over the whole snapshot, candidates that it names, inputs)."""
    inputs = full_inputs(t)
    packages = pkg.person_packages(inputs.package_docs, t.people, t.keys)
    posted = index_files(inputs, CFG.proposals_per_series, only=EVIDENCE_PARSERS)
    candidates = t.candidates_among(mentions(inputs, t.keys, posted, packages, teams=False), team_mentions(inputs, t.keys, posted))
    return cut(plan.attribute(inputs, candidates, t.keys, packages, CFG, posted=posted)), candidates, inputs


@check("run_evidence", "SELECT person_id, repo, source, role, round(confidence, 6) AS confidence, detail FROM b_run")
def run_evidence(t):
    return _attributed(t)[0].select("person_id", "repo", "source", "role", F.round("confidence", 6).alias("confidence"),
                                    F.when(F.col("source") == "enhancement_proposals", docs.four_digits(F.col("detail")))
                                     .otherwise(F.col("detail")).alias("detail"))


view("b_run_best", f"""
SELECT person_id, repo, role, w, least(CAST(0.99 AS DOUBLE), confidence + CAST(0.05 AS DOUBLE) * (sources - 1)) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, repo ORDER BY w * confidence DESC, w DESC) AS n FROM (
    SELECT person_id, repo, role, {_W} AS w, confidence, sources
    FROM b_run JOIN (SELECT person_id, repo, role, count(DISTINCT source) AS sources FROM b_run GROUP BY ALL) USING (person_id, repo, role)))
WHERE n = 1""")
view("b_run_roles", f"""
SELECT person_id, repo, string_agg(role, ',' ORDER BY o) AS roles FROM (SELECT DISTINCT person_id, repo, role, {_O} AS o FROM b_run
  WHERE role NOT IN ({", ".join(map(repr, fixed.WEAK_ROLES))})) GROUP BY person_id, repo""")


@check("run_records", f"""
SELECT person_id, repo, role, roles, round(confidence, 9) AS confidence, round(log10(pop + 10) * w * confidence, 6) AS score, {_tier(50)} AS tier
FROM (SELECT b.*, r.roles, c.stars AS pop, c.forks, c.pushed_at, c.manual, c.override
      FROM b_run_best b JOIN b_run_roles r USING (person_id, repo) JOIN b_cand c USING (person_id, repo))""")
def run_records(t):
    """Records and tiers from the evidence of all operators."""
    found, candidates, inputs = _attributed(t)
    return plan.standing(found, candidates, inputs, CFG).select(
        "person_id", "repo", "role", F.array_join("roles", ",").alias("roles"), F.round("confidence", 9).alias("confidence"),
        F.round("score", 6).alias("score"), "tier")


@check("attribution_run")
def attribution_run(t):
    """All evidence operators over the whole snapshot, to tiered records."""
    out = plan.run(full_inputs(t), CFG)
    return out.records.select("person_id", "forge", "repo", "role", F.array_join("roles", ",").alias("roles"),
                              "confidence", "score", "contributions", "tier")
