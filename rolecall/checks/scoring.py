"""Checks of record scoring, tiers and reports, over evidence made of line items."""

from pyspark.sql import functions as F

from .. import fixed
from ..functions import display
from ..operators import report, scoring
from ..plans.lineage import cut
from .base import check, view
from .bindings import CFG
from .documents import cat, text

# Role of a line item by its line number.
ROLE_OF_LINE = ["author", "maintainer", "code_owner", "core_contributor", "contributor",
                "release_manager", "org_member"]

_W = "CASE role " + " ".join(f"WHEN '{r}' THEN CAST({w} AS DOUBLE)" for r, w in fixed.ROLE_WEIGHT.items()) + " END"
_O = "CASE role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(fixed.ROLE_DISPLAY_ORDER)) + " END"
_L = "CASE role " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in fixed.ROLE_LABEL.items()) + " END"

view("b_ev", f"""
SELECT *, {_W} AS w, {_O} AS o, role IN ('contributor', 'org_member') AS weak FROM (
  SELECT a.person_id, r.repo, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ord,
         ({ROLE_OF_LINE})[l_linenumber] AS role, 'src' || ((l_orderkey + l_suppkey) % 3) AS source,
         CAST(0.4 AS DOUBLE) + CAST(5 AS DOUBLE) * l_discount AS confidence,
         CASE WHEN l_partkey % 2 = 0 THEN 'q' || (l_partkey % 3) END AS qualifier,
         CASE WHEN l_linenumber = 4 THEN CAST(l_quantity AS BIGINT) END AS contributions,
         CASE WHEN l_linenumber = 4 THEN l_orderkey % 40 + 1 END AS rank,
         CASE WHEN l_linenumber = 4 THEN 40 + l_partkey END AS total,
         l_tax > 0.06 AS capped, l_tax < 0.03 AS approx,
         CASE WHEN l_linenumber = 6 THEN CAST(l_quantity AS BIGINT) END AS rel, l_quantity > 5 AS has_rel
  FROM lineitem JOIN b_repos r ON r.partkey = l_partkey // 20 JOIN b_acc a ON a.k = l_suppkey)""")
view("b_best", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, repo
  ORDER BY w * confidence DESC, w DESC, ord) AS n FROM b_ev) WHERE n = 1""")
view("b_rec0", """
SELECT b.person_id, b.repo, b.role, least(CAST(0.99 AS DOUBLE), b.confidence + CAST(0.05 AS DOUBLE) * (s.n - 1))
         AS confidence, b.w, g.contributions, g.roles, t.rank, t.total, t.capped, t.approx
FROM b_best b
JOIN (SELECT person_id, repo, role, count(DISTINCT source) AS n FROM b_ev GROUP BY 1, 2, 3) s
  USING (person_id, repo, role)
JOIN (SELECT person_id, repo, coalesce(max(contributions) FILTER (WHERE contributions > 0 AND qualifier IS NULL),
               max(contributions) FILTER (WHERE contributions > 0)) AS contributions,
             string_agg(DISTINCT CASE WHEN NOT weak THEN o || ':' || role END, ',') AS roles
      FROM b_ev GROUP BY 1, 2 HAVING bool_or(NOT weak)) g USING (person_id, repo)
LEFT JOIN (SELECT * FROM (SELECT person_id, repo, rank, total, capped, approx, row_number() OVER (
             PARTITION BY person_id, repo ORDER BY ord) AS n FROM b_ev WHERE rank > 0 AND total > 0) WHERE n = 1) t
  USING (person_id, repo)""")
view("b_rec", """
SELECT *, log10(pop + 10) * w * confidence AS score FROM (
  SELECT c.*, r.stars, r.forks, r.pushed_at, 'https://github.com/' || c.repo AS url,
         CASE WHEN r.partkey % 7 <> 0 THEN r.stars ELSE r.forks END AS pop,
         r.partkey % 41 = 0 AS manual, coalesce(k.override, FALSE) AS override
  FROM b_rec0 c JOIN b_repos r USING (repo) LEFT JOIN b_known k USING (repo))""")


def _tier(m: int) -> str:
    return f"""CASE
  WHEN manual OR pop >= {m} OR override OR (role IN ('steering_council', 'standards_author', 'maintainer')
       AND confidence >= 0.7 AND pop >= {max(10, m // 5)}) THEN 'primary'
  WHEN ((forks >= 5 OR pop >= {max(5, m // 5)}) AND coalesce(floor(
          (epoch(TIMESTAMP '2003-08-01') - epoch(pushed_at)) / 86400) <= 720, TRUE))
       OR (role = 'author' AND (pop >= 5 OR forks >= 3)) THEN 'secondary' ELSE 'dropped' END"""


view("b_tier", f"SELECT *, {_tier(50)} AS tier FROM b_rec")


def evidence(t):
    k = F.floor(F.col("l_partkey") / 20).cast("bigint")
    line = F.col("l_linenumber")
    only = lambda n, v: F.when(line == n, v)
    who = t.accounts.select(F.substring("login", 2, 20).cast("bigint").alias("l_suppkey"), "person_id")
    i = (t.lineitem.withColumn("partkey", k).join(t.part_names.select("partkey", "repo"), "partkey")
         .join(who, "l_suppkey"))
    return i.select(
        "person_id", F.lit("github").alias("forge"), "repo",
        ((F.col("l_orderkey") * 10 + line) * 100000 + F.col("l_suppkey")).alias("ord"),
        cat("src", text((F.col("l_orderkey") + F.col("l_suppkey")) % 3)).alias("source"),
        F.element_at(F.lit(ROLE_OF_LINE), line).alias("role"),
        cat("https://example.org/", text(F.col("l_orderkey"))).alias("url"),
        (F.lit(0.4) + F.lit(5.0) * F.col("l_discount")).alias("confidence"),
        cat("line ", text(line)).alias("detail"),
        F.when(F.col("l_partkey") % 2 == 0, cat("q", text(F.col("l_partkey") % 3))).alias("qualifier"),
        only(4, F.col("l_orderkey") % 40 + 1).alias("rank"), only(4, F.col("l_partkey") + 40).alias("n_contributors"),
        (F.col("l_tax") > 0.06).alias("capped"), (F.col("l_tax") < 0.03).alias("approx"),
        only(4, F.col("l_quantity").cast("bigint")).alias("contributions"),
        only(6, F.col("l_quantity").cast("bigint")).alias("releases_authored"),
        only(6, F.when(F.col("l_quantity") > 5, 100).cast("bigint")).alias("releases_total"))


def projects(t):
    """Project facts of every repository."""
    return t.part_repos.join(t.known.select("repo", "importance", F.col("min_stars_override").alias("override")),
                              "repo", "left").select(
        F.lit("github").alias("forge"), "repo", "stars", "forks", "pushed_at", (F.col("partkey") % 7 != 0).alias("has_stars"), "importance",
        F.coalesce("override", F.lit(False)).alias("override"), (F.col("partkey") % 41 == 0).alias("manual"),
        cat("https://github.com/", F.col("repo")).alias("project_url"))


def records(t, ev=None):
    ev = evidence(t) if ev is None else ev
    r = scoring.to_records(scoring.score_evidence(ev), projects(t))
    return scoring.split_tiers(r, CFG.min_stars, CFG.as_of)


@check("best_evidence", """
SELECT person_id, repo, role, confidence, source FROM b_best""")
def best_evidence(t):
    return scoring.best_evidence(evidence(t)).select("person_id", "repo", "role", "confidence", "source")


@check("record_confidence", """
SELECT person_id, repo, role, round(confidence, 9) AS confidence FROM b_rec0""")
def record_confidence(t):
    return scoring.score_evidence(evidence(t)).select(
        "person_id", "repo", "role", F.round("confidence", 9).alias("confidence"))


@check("contributor_standing", """
SELECT person_id, repo, contributions, rank, total AS n_contributors, capped, approx FROM b_rec0""")
def contributor_standing(t):
    return scoring.score_evidence(evidence(t)).select(
        "person_id", "repo", "contributions", "rank", "n_contributors", "capped", "approx")


@check("record_score", """
SELECT person_id, repo, pop AS popularity, round(score, 6) AS score FROM b_rec""")
def record_score(t):
    return records(t).select("person_id", "repo", "popularity", F.round("score", 6).alias("score"))


@check("role_lists", """
SELECT person_id, repo, (SELECT string_agg(substr(x, 3), ',' ORDER BY x) FROM (
  SELECT unnest(string_split(roles, ',')) AS x)) AS roles FROM b_rec0""")
def role_lists(t):
    return scoring.score_evidence(evidence(t)).select("person_id", "repo", F.array_join("roles", ",").alias("roles"))


@check("tier_split", "SELECT person_id, repo, tier FROM b_tier")
def tier_split(t):
    return records(t).select("person_id", "repo", "tier")


@check("resplit", f"SELECT person_id, repo, {_tier(500)} AS tier FROM b_rec")
def resplit(t):
    return scoring.resplit(records(t), 500, CFG.as_of).select("person_id", "repo", "tier")


@check("enrich_stars", """
SELECT person_id, repo, CASE WHEN stars < 100 THEN stars + 7 ELSE stars END AS stars,
       CASE WHEN stars < 100 THEN forks + 3 ELSE forks END AS forks FROM b_rec""")
def enrich_stars(t):
    r = records(t).withColumn("stars", F.when(F.col("stars") < 100, F.lit(0).cast("bigint")).otherwise(F.col("stars")))
    meta = t.part_repos.select(F.lit("github").alias("forge"), "repo", (F.col("stars") + 7).alias("stars"),
                               (F.col("forks") + 3).alias("forks"), F.lit(None).cast("timestamp").alias("pushed_at"))
    return scoring.enrich_stars(r, meta).select("person_id", "repo", "stars", "forks")


@check("top_n", """
SELECT * FROM (SELECT person_id, repo, role, row_number() OVER (
  PARTITION BY person_id ORDER BY score DESC, repo) AS position FROM b_tier WHERE tier = 'primary')
WHERE position <= 5""")
def top_n(t):
    return scoring.top_records(records(t).where("tier = 'primary'"), 5).select(
        "person_id", "repo", "role", F.col("position").cast("bigint").alias("position"))


@check("reach", """
SELECT person_id, count(*) AS projects, count(DISTINCT CASE WHEN lower(split_part(repo, '/', 1)) <> primary_login
         THEN split_part(repo, '/', 1) END) AS communities,
       CAST(sum(coalesce(contributions, 0)) AS BIGINT) AS total_commits
FROM b_tier JOIN b_people USING (person_id) WHERE tier <> 'dropped' GROUP BY person_id""")
def reach(t):
    return scoring.reach(records(t).where("tier <> 'dropped'"), t.people)


@check("record_dedupe", """
SELECT person_id, url, max(repo) AS repo FROM (
  SELECT person_id, 'https://example.org/' || split_part(repo, '/', 1) AS url, repo, row_number() OVER (
    PARTITION BY person_id, split_part(repo, '/', 1)
    ORDER BY CASE WHEN pop % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN pop % 2 = 0 THEN 'github' ELSE 'gitlab' END, repo) AS n
  FROM b_rec) WHERE n = 1 GROUP BY person_id, url""")
def record_dedupe(t):
    r = records(t).withColumn("forge", F.when(F.col("popularity") % 2 == 0, "github").otherwise("gitlab"))
    r = r.withColumn("url", cat("https://example.org/", F.substring_index("repo", "/", 1)))
    return scoring.dedupe_records(r, list(fixed.WEB_HOST)).select("person_id", "url", "repo")


# --- reports ---------------------------------------------------------------
_SUFFIX = """CASE WHEN rank IS NULL THEN '' ELSE ' (#' || rank || '/' || CASE WHEN approx THEN '~' || CASE
  WHEN total < 100 THEN total ELSE CAST(round_even(total / pow(10, length(CAST(total AS VARCHAR)) - 2), 0) AS BIGINT)
    * CAST(pow(10, length(CAST(total AS VARCHAR)) - 2) AS BIGINT) END
  ELSE total || CASE WHEN capped THEN '+' ELSE '' END END || ')' END"""
view("b_role_text", f"""
SELECT p.person_id, p.repo, p.role, p.o, {_L} || CASE
    WHEN role = 'release_manager' THEN CASE WHEN rel IS NULL THEN '' ELSE ' (' || rel || '/100)' END
    WHEN role = 'core_contributor' THEN {_SUFFIX}
    WHEN all_scoped THEN ' (' || quals || ')' ELSE '' END AS txt, {_SUFFIX} AS suffix
FROM (SELECT person_id, repo, role, max(o) AS o, bool_and(q IS NOT NULL) AS all_scoped,
             string_agg(q, ', ' ORDER BY first) AS quals, arg_min(rel, rel_at) AS rel
      FROM (SELECT person_id, repo, role, max(o) AS o, qualifier AS q, min(ord) AS first,
                   arg_min(rel, ord) FILTER (WHERE has_rel AND rel IS NOT NULL) AS rel,
                   min(ord) FILTER (WHERE has_rel AND rel IS NOT NULL) AS rel_at
            FROM b_ev WHERE NOT weak GROUP BY person_id, repo, role, qualifier) GROUP BY 1, 2, 3) p
JOIN b_rec0 USING (person_id, repo, role)
UNION ALL
SELECT p.person_id, p.repo, p.role, p.o, {_L.replace('CASE role', 'CASE p.role')} || CASE
    WHEN p.role = 'release_manager' THEN CASE WHEN rel IS NULL THEN '' ELSE ' (' || rel || '/100)' END
    WHEN p.role = 'core_contributor' THEN {_SUFFIX}
    WHEN all_scoped THEN ' (' || quals || ')' ELSE '' END, {_SUFFIX}
FROM (SELECT person_id, repo, role, max(o) AS o, bool_and(q IS NOT NULL) AS all_scoped,
             string_agg(q, ', ' ORDER BY first) AS quals, arg_min(rel, rel_at) AS rel
      FROM (SELECT person_id, repo, role, max(o) AS o, qualifier AS q, min(ord) AS first,
                   arg_min(rel, ord) FILTER (WHERE has_rel AND rel IS NOT NULL) AS rel,
                   min(ord) FILTER (WHERE has_rel AND rel IS NOT NULL) AS rel_at
            FROM b_ev WHERE NOT weak GROUP BY person_id, repo, role, qualifier) GROUP BY 1, 2, 3) p
JOIN b_rec0 r ON r.person_id = p.person_id AND r.repo = p.repo AND r.role <> p.role""")
view("b_label", """
SELECT person_id, repo, string_agg(txt, ', ' ORDER BY o) || CASE WHEN bool_or(role = 'core_contributor') THEN ''
  ELSE max(suffix) END AS label FROM b_role_text GROUP BY person_id, repo""")


@check("role_texts", "SELECT person_id, repo, role, txt AS text FROM b_role_text")
def role_texts(t):
    ev = cut(evidence(t))
    return report.role_texts(ev, records(t, ev)).select("person_id", "repo", "role", "text")


@check("report_lines", """
SELECT person_id, position, '- ' || repo || ' (' || CASE WHEN stars >= 1000 THEN
         CAST(round_even(stars / 1000.0, 0) AS BIGINT) || 'k' ELSE CAST(stars AS VARCHAR) END || '★) — ' || label AS line
FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, repo) AS position
      FROM b_tier WHERE tier = 'primary') JOIN b_label USING (person_id, repo) WHERE position <= 5""")
def report_lines(t):
    ev = cut(evidence(t))
    return report.highlights(records(t, ev), ev, 5).select(
        "person_id", F.col("position").cast("bigint").alias("position"), "line")


@check("report_empty", """
SELECT s_suppkey AS person_id, 's' || s_suppkey || ': no elevated roles found.' AS line FROM supplier
WHERE s_suppkey NOT IN (SELECT person_id FROM b_tier WHERE tier <> 'dropped')""")
def report_empty(t):
    k = F.col("s_suppkey")      # twice as many as there are people with accounts
    return report.empty_lines(records(t), t.supplier.select(k.alias("person_id"), t.login(k).alias("primary_login")))


@check("report_footer", """
SELECT person_id, primary_login || ' — top ' || least(p, 5) || ' highlights:' AS header,
       CASE WHEN p > 5 OR s > 0 THEN '…plus ' || concat_ws('; ',
         CASE WHEN p > 5 THEN (p - 5) || ' more elevated-role project(s)' END,
         CASE WHEN s > 0 THEN s || ' smaller but widely-used project(s) with a notable role' END) || '.' END AS extra,
       'Reach: ' || (p + s) || ' project(s) across ' || orgs || ' communities (distinct orgs).' AS reach
FROM (SELECT person_id, primary_login, count(*) FILTER (WHERE tier = 'primary') AS p,
             count(*) FILTER (WHERE tier = 'secondary') AS s, count(DISTINCT CASE
               WHEN lower(split_part(repo, '/', 1)) <> primary_login THEN split_part(repo, '/', 1) END) AS orgs
      FROM b_tier JOIN b_people USING (person_id) WHERE tier <> 'dropped' GROUP BY 1, 2)""")
def report_footer(t):
    return report.highlight_footer(records(t), t.people, 5)


view("b_doc", """
SELECT t.*, l.label, k.importance, s.w * s.confidence AS wc, s.source AS best_source, s.ord AS best_ord,
       CASE t.tier WHEN 'primary' THEN 1 ELSE 3 END AS section,
       (SELECT string_agg('"' || substr(x, 3) || '"', ',' ORDER BY x) FROM (SELECT unnest(string_split(t.roles, ',')) AS x)) AS names
FROM b_tier t JOIN b_label l USING (person_id, repo) JOIN b_best s USING (person_id, repo) LEFT JOIN b_known k USING (repo)
WHERE t.tier <> 'dropped'""")
view("b_shown", """
SELECT person_id, primary_login, count(d.repo) FILTER (WHERE tier = 'primary') AS p, count(d.repo) FILTER (WHERE tier = 'secondary') AS s
FROM b_people LEFT JOIN b_doc d USING (person_id) GROUP BY 1, 2""")
view("b_listed_items", """
SELECT e.*, d.section, d.score, 'https://example.org/' || (e.ord // 1000000) AS item_url, 'line ' || (e.ord // 100000 % 10) AS detail,
       row_number() OVER (PARTITION BY e.person_id, e.repo ORDER BY e.w DESC, e.confidence DESC, e.ord, md5(concat_ws('|',
         e.source, e.role, 'https://example.org/' || (e.ord // 1000000), 'line ' || (e.ord // 100000 % 10), e.qualifier))) AS place
FROM b_ev e JOIN b_doc d USING (person_id, repo)""")


def _json(value: str) -> str:
    return f"coalesce(to_json({value})::VARCHAR, 'null')"


_OBJECT = lambda **fields: "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items())
_PROJECT = _OBJECT(project=_json("repo"), url=_json("url"), role=_json("role"), roles="'[' || names || ']'",
                   confidence=_json("round(confidence, 2)"), stars="stars", forks="forks", importance=_json("importance"), score=_json("round(score, 3)"))
_ITEM = _OBJECT(source=_json("source"), role=_json("role"), url=_json("item_url"), confidence=_json("round(confidence, 2)"),
                detail=_json("detail"), qualifier=_json("qualifier"))


def _ordered(parts: list[str]) -> str:
    """Lines (person_id, section, score, repo, part, place, line) with their position in the report."""
    return f"""SELECT person_id, line, row_number() OVER (
  ORDER BY person_id, section, score DESC NULLS LAST, repo NULLS FIRST, part, place) AS position FROM ({" UNION ALL ".join(parts)})"""


@check("report_json", _ordered([
    f"""SELECT person_id, 0 AS section, NULL::DOUBLE AS score, NULL AS repo, 0 AS part, 0 AS place,
      {_OBJECT(user=_json("primary_login"), count="p")} || ',"projects":[' AS line FROM b_shown""",
    f"""SELECT person_id, section, score, repo, 0, 0, CASE WHEN row_number() OVER (PARTITION BY person_id, section ORDER BY score DESC, repo) = 1
      THEN '' ELSE ',' END || {_PROJECT} || ',"evidence":[' FROM b_doc""",
    f"SELECT person_id, section, score, repo, 1, place, CASE place WHEN 1 THEN '' ELSE ',' END || {_ITEM} || '}}' FROM b_listed_items",
    "SELECT person_id, section, score, repo, 2, 0, ']}' FROM b_doc",
    """SELECT person_id, 2, NULL, NULL, 0, 0, '],"secondary_count":' || s || ',"secondary":[' FROM b_shown""",
    "SELECT person_id, 4, NULL, NULL, 0, 0, ']}' FROM b_shown"]))
def report_json(t):
    """The lines of all documents, with their place in the whole report."""
    ev = cut(evidence(t))
    return report.numbered(report.report_json(records(t, ev), ev, t.people)).select("person_id", "line", "position")


_LINK = "'[' || repo || '](' || url || ')'"
_TWO = "printf('%.2f', confidence)"


@check("report_markdown", _ordered([
    """SELECT person_id, 0 AS section, NULL::DOUBLE AS score, NULL AS repo, 0 AS part, 0 AS place,
      '# Elevated-role record for `' || primary_login || '`' || chr(10) || chr(10) || p || ' project(s) where this user holds an elevated role (maintainer / code owner / steering council / standards author / core contributor)'
      || CASE WHEN s > 0 THEN ', plus **' || s || '** less-popular but widely-used and maintained project(s) with an elevated role.' ELSE '.' END || chr(10)
      || CASE WHEN p = 0 AND s = 0 THEN chr(10) || '_No elevated roles found._' ELSE '' END AS line FROM b_shown""",
    "SELECT person_id, 1, NULL, NULL, 0, 0, '| Project | Role | Stars | Confidence | Evidence |' || chr(10) || '|---|---|---:|---:|---|' FROM b_shown WHERE p > 0",
    f"""SELECT person_id, 2, score, repo, 0, 0, '| ' || {_LINK} || coalesce(' ·' || importance, '') || ' | ' || label || ' | ' || stars || ' | ' || {_TWO}
      || ' | [' || best_source || '](https://example.org/' || (best_ord // 1000000) || ') |' FROM b_doc WHERE section = 1""",
    "SELECT person_id, 3, NULL, NULL, 0, 0, chr(10) || '## Details' || chr(10) FROM b_shown WHERE p > 0",
    f"""SELECT person_id, 4, score, repo, 0, 0, '### ' || {_LINK} || ' — ' || label || chr(10) || 'Stars: ' || stars || ' · Forks: ' || forks || ' · Confidence: '
      || {_TWO} || coalesce(' · Importance: ' || importance, '') || chr(10) FROM b_doc WHERE section = 1""",
    f"""SELECT person_id, 4, score, repo, 1, place, '- **' || {_L} || '** (' || {_TWO} || ', via `' || source || '`): ' || detail || ' — [evidence]('
      || item_url || ')' FROM b_listed_items WHERE section = 1""",
    "SELECT person_id, 4, score, repo, 2, 0, '' FROM b_doc WHERE section = 1",
    """SELECT person_id, 5, NULL, NULL, 0, 0, '## Less-popular but widely-used & maintained (' || s || ')' || chr(10) || chr(10)
      || 'Below the adoption bar (stars), but actively maintained with real developer engagement (forks); the user holds an elevated role.' || chr(10) || chr(10)
      || '| Project | Role | Stars | Forks | Confidence |' || chr(10) || '|---|---|---:|---:|---:|' FROM b_shown WHERE s > 0""",
    f"SELECT person_id, 6, score, repo, 0, 0, '| ' || {_LINK} || ' | ' || label || ' | ' || stars || ' | ' || forks || ' | ' || {_TWO} || ' |' FROM b_doc WHERE section = 3"]))
def report_markdown(t):
    ev = cut(evidence(t))
    return report.numbered(report.report_markdown(records(t, ev), ev, t.people)).select("person_id", "line", "position")


@check("contributor_suffix", f"""
SELECT person_id, repo, {_SUFFIX} AS suffix FROM b_rec0""")
def contributor_suffix(t):
    return scoring.score_evidence(evidence(t)).select("person_id", "repo", display.contributor_suffix(
        F.col("rank"), F.col("n_contributors"), F.col("capped"), F.col("approx")).alias("suffix"))
