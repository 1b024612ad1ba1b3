"""Checks of the role-file operators."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..operators.containment import contains_join
from ..operators.postings import index_files
from ..operators.evidence import credits, documents as ev, manifests as mf, proposals as pr
from ..functions import documents as doc
from .base import check, view
from .rosters import context


def text(v):
    return v.cast("string") if hasattr(v, "cast") else F.lit(str(v))


def cat(*parts):
    return F.concat(*[p if hasattr(p, "cast") else F.lit(p) for p in parts])


def posted(t, files, only=None):
    return index_files(t.inputs.with_tables(files=files), only=only)


view("b_lines", r"""
SELECT r.repo, doc_id AS d, CAST(i - 1 AS BIGINT) AS i, regexp_replace(lower(x), '[^a-z]+', '_', 'g') AS w, x AS raw
FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM (
        SELECT doc_id, string_split(regexp_replace(text,
          '\r\n?|[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS ls
        FROM documents)) JOIN b_repos r ON r.partkey = doc_id""")

view("b_wlines", "SELECT repo, d, i, replace(w, '_', ' ') AS w, raw FROM b_lines")


def stripped(value: str) -> str:
    """SQL that takes all Unicode blanks off both ends."""
    blanks = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"regexp_replace({value}, '^{blanks}|{blanks}$', '', 'g')"


# --- CODEOWNERS ------------------------------------------------------------
view("b_co_lines", """
SELECT repo, i, prio, CASE
  WHEN i % 6 = 0 THEN '# ' || raw
  WHEN i % 11 = 7 THEN 'docs/Codeowners/ @s' || ((d + i) % (SELECT count(*) FROM supplier))
  WHEN i % 6 = 4 AND (d + i) % 2 = 0 THEN ''
  WHEN i % 7 = 3 THEN '* @s' || ((d + i) % (SELECT count(*) FROM supplier))
  WHEN i % 6 = 5 THEN '/' || w || '/ s' || ((d * 3 + i) % (SELECT count(*) FROM supplier))
       || '@example.com # note'
  ELSE '/' || w || '/ @s' || ((d + i + prio) % (SELECT count(*) FROM supplier)) || ' @brands/team' || (i % 3)
  END AS txt
FROM (SELECT *, d % 3 AS prio FROM b_lines
      UNION ALL SELECT *, 2 FROM b_lines WHERE d % 4 = 0 AND d % 3 <> 2)""")
view("b_co_rules", rf"""
SELECT repo, prio, i, string_split(rule, ' ')[1] AS pattern, string_split(rule, ' ')[2:] AS owners, section
FROM (SELECT repo, prio, i, txt, trim(split_part(txt, '#', 1)) AS rule, nullif(last_value(
          CASE WHEN trim(txt) = '' THEN '' WHEN txt LIKE '#%' THEN {stripped("ltrim(txt, '#')")} END IGNORE NULLS)
          OVER (PARTITION BY repo, prio ORDER BY i), '') AS section FROM b_co_lines)
WHERE txt NOT LIKE '#%' AND rule LIKE '% %'""")
view("b_teams", """
SELECT 'team' || (s_suppkey // 10 % 3) AS team, 's' || s_suppkey AS login FROM supplier
WHERE s_suppkey % 10 = 0""")
view("b_co_first", "SELECT repo, min(prio) AS prio FROM b_co_lines GROUP BY repo")


def codeowners_files(t) -> DataFrame:
    paths = F.lit(fixed.CODEOWNERS_PATHS)

    def line(prio):
        return lambda w, i, d, x: (
            F.when(i % 6 == 0, cat("# ", x))
             .when(i % 11 == 7, cat("docs/Codeowners/ @", t.login(t.someone(d + i))))
             .when((i % 6 == 4) & ((d + i) % 2 == 0), "")
             .when(i % 7 == 3, cat("* @", t.login(t.someone(d + i))))
             .when(i % 6 == 5, cat("/", w, "/ ", t.login(t.someone(d * 3 + i)), "@example.com # note"))
             .otherwise(cat("/", w, "/ @", t.login(t.someone(d + i + prio(d))), " @brands/team",
                            text(i % 3))))
    main = t.document_files(F.element_at(paths, (F.col("doc_id") % 3 + 1).cast("int")),
                            line(lambda d: d % 3), "_")
    more = t.document_files(F.when((F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 3 != 2),
                                   F.element_at(paths, 3)), line(lambda d: F.lit(2)), "_")
    return main.unionByName(more.where("path IS NOT NULL"))


def teams(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.where("s_suppkey % 10 = 0").select(
        F.lit("brands").alias("org"),
        cat("team", text(F.floor(k / 10).cast("bigint") % 3)).alias("team"), t.login(k).alias("login"))


_CO_PATH = "(['.github/CODEOWNERS', 'CODEOWNERS', 'docs/CODEOWNERS'])[prio + 1]"


@check("codeowners_rules", f"""
SELECT repo, {_CO_PATH} AS path, pattern, array_to_string(owners, ' ') AS owners, section
FROM b_co_rules""")
def codeowners_rules(t):
    return codeowners_files(t).select(
        "repo", "path", F.explode(doc.codeowner_rules(F.col("text"))).alias("r")).select(
        "repo", "path", "r.pattern", F.array_join("r.owners", " ").alias("owners"), "r.section")


view("b_co_listed", f"""
SELECT o.repo, {_CO_PATH} AS path, o.scope, o.i, o.pos, a.person_id, CASE
    WHEN o.owner LIKE '@%/%' THEN 'member of ' || o.owner || ' (CODEOWNERS in ' || {_CO_PATH} || ')'
    WHEN o.owner LIKE '@%' THEN 'listed as ' || o.owner || ' in ' || {_CO_PATH}
    ELSE 'listed by email in ' || {_CO_PATH} END AS detail
FROM (SELECT repo, prio, i, coalesce(section, nullif(pattern, '*')) AS scope,
             generate_subscripts(owners, 1) AS pos, unnest(owners) AS owner
      FROM b_co_rules JOIN b_co_first USING (repo, prio) WHERE pattern <> 'docs/Codeowners/') o
LEFT JOIN b_teams g ON o.owner = '@brands/' || g.team
JOIN b_acc a ON a.email = o.owner OR o.owner = '@' || a.login OR a.login = g.login""")


@check("codeowners_evidence", """
SELECT person_id, repo, path, qualifier, detail, CAST(0.9 AS DOUBLE) AS confidence FROM (
  SELECT l.person_id, l.repo, l.path, l.scope AS qualifier, l.detail, row_number() OVER (
           PARTITION BY l.person_id, l.repo, l.scope ORDER BY l.i, l.pos) AS n
  FROM b_co_listed l JOIN b_cand c ON c.person_id = l.person_id AND c.repo = l.repo AND c.trusted)
WHERE n = 1""")
def codeowners_evidence(t):
    found = ev.codeowners(context(t, files=codeowners_files(t), teams=teams(t)))
    return found.select("person_id", "repo", F.regexp_extract("url", "/blob/HEAD/(.*)$", 1).alias("path"),
                        "qualifier", "detail", "confidence")


# --- OWNERS and MAINTAINERS ------------------------------------------------
view("b_owners_lines", """
SELECT repo, i, CASE WHEN i % 8 = 0 THEN 'approvers:' WHEN i % 8 = 4 THEN 'reviewers:'
  WHEN i % 8 = 7 THEN '# ' || raw ELSE '  - s' || ((d + i) % (SELECT count(*) FROM supplier)) END AS txt
FROM b_wlines""")
view("b_owners", """
SELECT DISTINCT repo, key, login FROM (
  SELECT repo, txt, key, blk, max(blk) OVER (PARTITION BY repo, key) AS last, regexp_extract(txt, 's[0-9]+') AS login
  FROM (SELECT repo, txt, last_value(CASE WHEN txt LIKE '%s:' THEN txt END IGNORE NULLS) OVER w AS key,
               last_value(CASE WHEN txt LIKE '%s:' THEN i END IGNORE NULLS) OVER w AS blk
        FROM b_owners_lines WINDOW w AS (PARTITION BY repo ORDER BY i)))
WHERE blk = last AND txt LIKE '  - s%'""")
view("b_owners_ev", """
SELECT o.person_id, o.repo, CASE WHEN o.approver THEN 'maintainer' ELSE 'code_owner' END AS role
FROM (SELECT a.person_id, w.repo, bool_or(w.key = 'approvers:') AS approver
      FROM b_owners w JOIN b_acc a USING (login) GROUP BY a.person_id, w.repo) o
JOIN b_cand c USING (person_id, repo)""")
view("b_maint0", "SELECT *, (SELECT count(*) FROM supplier) AS n FROM b_wlines")
view("b_maint", """
SELECT repo, i, 'handle' AS kind, 's' || ((d + i) % n) AS key FROM b_maint0 WHERE i % 5 IN (1, 3)
UNION ALL SELECT repo, i, 'name', 'supplier no' || ((d * 3 + i) % n) FROM b_maint0 WHERE i % 5 IN (1, 2)
UNION ALL SELECT repo, i, 'email', 's' || ((d * 3 + i) % n) || '@example.com' FROM b_maint0 WHERE i % 5 = 2""")


def owners_files(t) -> DataFrame:
    return t.document_files(F.lit("OWNERS"), lambda w, i, d, x: (
        F.when(i % 8 == 0, "approvers:").when(i % 8 == 4, "reviewers:")
         .when(i % 8 == 7, cat("# ", x)).otherwise(cat("  - ", t.login(t.someone(d + i))))))


def maintainers_files(t) -> DataFrame:
    other = lambda d, i: text(t.someone(d * 3 + i))
    return t.document_files(F.lit("docs/MAINTAINERS.md"), lambda w, i, d, x: (
        F.when(i % 5 == 0, cat("# ", x))
         .when(i % 5 == 1, cat("- Supplier No", other(d, i), " (@", t.login(t.someone(d + i)), ")"))
         .when(i % 5 == 2, cat("Supplier No", other(d, i), " <s", other(d, i), "@example.com>"))
         .when(i % 5 == 3, cat("* ", w, " @", t.login(t.someone(d + i))))
         .otherwise(cat("| ", w, " |"))))


@check("maintainers_evidence", """
SELECT person_id, repo, role, CAST(CASE role WHEN 'maintainer' THEN 0.85 ELSE 0.8 END AS DOUBLE)
         AS confidence,
       CASE role WHEN 'maintainer' THEN 'approver in OWNERS' ELSE 'reviewer in OWNERS' END AS detail
FROM b_owners_ev
UNION ALL
SELECT person_id, repo, 'maintainer', CAST(CASE WHEN weak = 1 THEN 0.5 ELSE 0.85 END AS DOUBLE),
       CASE WHEN weak = 1 THEN 'name listed in ' ELSE 'listed in ' END || 'docs/MAINTAINERS.md'
FROM (SELECT a.person_id, m.repo, min(m.i * 2 + CASE m.kind WHEN 'name' THEN 1 ELSE 0 END) % 2 AS weak
      FROM b_maint m JOIN b_acc a ON m.key = CASE m.kind WHEN 'handle' THEN a.login
             WHEN 'name' THEN a.name ELSE a.email END
      JOIN b_cand c ON c.person_id = a.person_id AND c.repo = m.repo
      WHERE NOT EXISTS (SELECT 1 FROM b_owners_ev o WHERE o.person_id = a.person_id AND o.repo = m.repo)
      GROUP BY a.person_id, m.repo)""")
def maintainers_evidence(t):
    files = owners_files(t).unionByName(maintainers_files(t))
    return ev.maintainers(context(t, files=files)).select(
        "person_id", "repo", "role", "confidence", "detail")


# --- governance ------------------------------------------------------------
view("b_gov_lines", """
SELECT repo, i, CASE WHEN i % 9 = 0 THEN 'Steering Council' WHEN i % 9 = 3 THEN 'Maintainers ' || raw
  WHEN i % 9 IN (1, 4) THEN '- @s' || ((d + i) % (SELECT count(*) FROM supplier))
  WHEN i % 9 = 6 THEN 'Supplier No' || ((d * 5 + i) % (SELECT count(*) FROM supplier)) || ' ' || raw
  ELSE raw END AS txt FROM b_wlines""")
view("b_gov_windows", rf"""
SELECT repo, i, w, regexp_matches(w, '(?i)steering council|steering committee|technical (?:steering )?committee|\btsc\b|core team|council member|governing board|bdfl|project lead') AS council,
       regexp_matches(w, '(?i)maintainer|core developer|core contributor|lead') AS maint
FROM (SELECT repo, i, {stripped("(txt || coalesce(' ' || lead(txt, 1) OVER o, '') || coalesce(' ' || lead(txt, 2) OVER o, ''))")} AS w
      FROM b_gov_lines WINDOW o AS (PARTITION BY repo ORDER BY i)) WHERE w <> ''""")


def governance_files(t) -> DataFrame:
    return t.document_files(F.lit("docs/GOVERNANCE.md"), lambda w, i, d, x: (
        F.when(i % 9 == 0, "Steering Council").when(i % 9 == 3, cat("Maintainers ", x))
         .when((i % 9).isin(1, 4), cat("- @", t.login(t.someone(d + i))))
         .when(i % 9 == 6, cat("Supplier No", text(t.someone(d * 5 + i)), " ", x)).otherwise(x)))


@check("governance_windows", """
SELECT repo, i AS line, w AS "window", council, maint FROM b_gov_windows""")
def governance_windows(t):
    return ev.governance_windows(posted(t, governance_files(t), ["governance"])).select(
        "repo", F.col("line").cast("bigint").alias("line"), "window", "council", "maint")


@check("governance_evidence", r"""
SELECT person_id, repo, role, confidence, detail || ' (docs/GOVERNANCE.md)' AS detail FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, repo ORDER BY confidence DESC, i, how) AS n FROM (
    SELECT a.person_id, g.repo, g.i, 0 AS how,
           CASE WHEN NOT council AND maint THEN 'maintainer' ELSE 'steering_council' END AS role,
           CAST(CASE WHEN council THEN 0.7 WHEN maint THEN 0.65 ELSE 0.45 END AS DOUBLE) AS confidence,
           CASE WHEN council THEN 'handle near council keyword' WHEN maint
                THEN 'handle near maintainer keyword' ELSE 'handle in governance doc' END AS detail
    FROM (SELECT *, unnest(regexp_extract_all(w, '@([A-Za-z0-9-]+)', 1)) AS h FROM b_gov_windows) g
    JOIN b_acc a ON a.login = lower(g.h)
    UNION ALL
    SELECT a.person_id, g.repo, g.i, 1, CASE WHEN council THEN 'steering_council' ELSE 'maintainer' END,
           CAST(CASE WHEN council THEN 0.45 ELSE 0.4 END AS DOUBLE),
           CASE WHEN council THEN 'name near council keyword' ELSE 'name near maintainer keyword' END
    FROM b_gov_windows g JOIN b_cand c USING (repo) JOIN b_acc a ON a.person_id = c.person_id
    WHERE (council OR maint) AND contains(lower(g.w), a.name))
  JOIN b_cand c USING (person_id, repo)) WHERE n = 1""")
def governance_evidence(t):
    return ev.governance(context(t, files=governance_files(t))).select(
        "person_id", "repo", "role", "confidence", "detail")


# --- proposals -------------------------------------------------------------
view("b_prop", """
SELECT r.repo, r.partkey % 2 = 0 AS rst, d.doc_id AS d, d.doc_id % 10 = 0 AS is_dir,
       lpad(CAST(d.doc_id AS VARCHAR), 4, '0') AS num,
       (d.doc_id * 7) % (SELECT count(*) FROM supplier) AS x,
       (d.doc_id * 11 + 3) % (SELECT count(*) FROM supplier) AS y,
       (d.doc_id * 13 + 5) % (SELECT count(*) FROM supplier) AS z
FROM documents d JOIN b_repos r ON r.partkey = d.doc_id // 40""")
view("b_prop_people", """
SELECT repo, rst, d, is_dir, num, 'name' AS kind, 'supplier no' || x AS key FROM b_prop
UNION ALL SELECT repo, rst, d, is_dir, num, 'email', 's' || x || '@example.com' FROM b_prop WHERE d % 3 = 0
UNION ALL SELECT repo, rst, d, is_dir, num, 'handle', 's' || y FROM b_prop
UNION ALL SELECT repo, rst, d, is_dir, num, 'name', 'supplier no' || z FROM b_prop""")


#: Four digits number a document; what else its id has follows the name in letters, so that no two share a path.
_MORE = r"\+([a-j]+)"
_LETTERS = ("0123456789", "abcdefghij")


def four_digits(shown):
    """A path or text that names documents by their four digits alone, as the statements do."""
    return F.regexp_replace(shown, _MORE, "")


def doc_id_of(path):
    more = F.translate(F.regexp_extract(path, _MORE, 1), *reversed(_LETTERS))
    return F.concat(F.regexp_extract(path, "/([0-9]+)", 1), more).cast("bigint")


def proposals(t):
    """(files, dir_entries) of one proposal series per forty documents."""
    d = F.col("doc_id")
    x, y, z = (text(t.someone(v)) for v in (d * 7, d * 11 + 3, d * 13 + 5))
    email = F.when(d % 3 == 0, cat(" <s", x, "@example.com>")).otherwise("")
    rst = cat("Number: ", text(d), "\nAuthor: Supplier No", x, email, ",\n    @s", y,
              ",\n    Supplier No", z, "\nStatus: Draft\n\n", F.col("text"))
    yaml = cat("---\ntitle: ", text(d), "\nauthors:\n  - Supplier No", x, email, "\n  - \"(@s", y,
               ")\"\n  - Supplier No", z, "\nstatus: Draft\n---\n\n", F.col("text"))
    num = F.lpad(text(d), 4, "0")
    rest = F.translate(F.substring(text(d), F.lit(5), F.length(text(d))), *_LETTERS)
    more = F.when(rest != "", cat("+", rest)).otherwise("")
    is_rst = F.col("partkey") % 2 == 0
    ext = F.when(is_rst, ".rst").otherwise(".md")
    is_dir = d % 10 == 0
    df = t.spread("documents").join(t.part_names.select("partkey", "repo"),
                          F.floor(d / 40).cast("bigint") == F.col("partkey"))
    name = F.when(is_dir, cat(num, more)).otherwise(cat(num, "-x", more, ext))
    entries = df.select(F.lit("github").alias("forge"), "repo", F.lit("proposals").alias("dir"),
                        name.alias("name"), is_dir.alias("is_dir"))
    path = cat("proposals/", name, F.when(is_dir, F.when(is_rst, "/index.rst").otherwise("/README.md"))
               .otherwise(""))
    files = df.select(F.lit("github").alias("forge"), "repo", path.alias("path"),
                      F.when(is_rst, rst).otherwise(yaml).alias("text"))
    return files, entries


@check("proposal_dirs", """
SELECT repo, CASE WHEN count(*) FILTER (WHERE rst AND NOT is_dir) >= count(*) FILTER (WHERE NOT rst AND NOT is_dir)
       THEN 'rst' ELSE 'yaml' END AS header_format
FROM b_prop GROUP BY repo HAVING count(*) FILTER (WHERE NOT is_dir OR length(num) <= 4) >= 3""")
def proposal_dirs(t):
    return pr.proposal_dirs(proposals(t)[1]).select("repo", "header_format")


@check("proposal_headers", """
SELECT repo, d, kind, key FROM b_prop_people""")
def proposal_headers(t):
    files, _ = proposals(t)
    fmt = F.when(F.col("text").startswith("---"), "yaml").otherwise("rst")
    people = files.select("forge", "repo", doc_id_of(F.col("path")).alias("d"), F.explode(doc.proposal_authors(F.col("text"), fmt)).alias("p"))
    return ev.listed_keys(people, ["repo", "d"])


_PROP_DOC = """'proposals/' || num || CASE WHEN is_dir THEN CASE WHEN rst THEN '/index.rst' ELSE '/README.md' END
  ELSE '-x' || CASE WHEN rst THEN '.rst' ELSE '.md' END END"""


@check("proposal_authorship", f"""
SELECT person_id, repo, docs, CAST(CASE WHEN docs = 1 AND weak THEN 0.5 ELSE 0.85 END AS DOUBLE) AS confidence,
       first AS path, 'author of ' || docs || ' proposal(s): ' || listed ||
       CASE WHEN docs > 5 THEN ' (+' || (docs - 5) || ' more)' ELSE '' END AS detail
FROM (SELECT person_id, repo, count(*) AS docs, bool_or(weak) AS weak,
             min(doc) FILTER (WHERE n = 1) AS first,
             string_agg(CASE WHEN n <= 5 THEN split_part(doc, '/', -1) END, ', ' ORDER BY n) AS listed
      FROM (SELECT *, row_number() OVER (PARTITION BY person_id, repo ORDER BY sortname) AS n
            FROM (SELECT a.person_id, p.repo, p.d, {_PROP_DOC} AS doc,
                         num || CASE WHEN is_dir THEN '' ELSE '-x' END AS sortname,
                         bool_and(p.kind = 'name') AS weak
                  FROM b_prop_people p JOIN b_acc a ON p.key = CASE p.kind WHEN 'handle' THEN a.login
                       WHEN 'name' THEN a.name ELSE a.email END
                  JOIN b_cand c ON c.person_id = a.person_id AND c.repo = p.repo
                  WHERE p.repo IN (SELECT repo FROM b_prop GROUP BY repo HAVING count(*) FILTER (
                          WHERE NOT is_dir OR length(num) <= 4) >= 3)
                  GROUP BY ALL)) GROUP BY person_id, repo)""")
def proposal_authorship(t):
    files, entries = proposals(t)
    found = pr.enhancement_proposals(context(t, files=files, dir_entries=entries))
    return found.select("person_id", "repo", F.regexp_extract("detail", "of ([0-9]+) ", 1).cast("bigint")
                        .alias("docs"), "confidence",
                        four_digits(F.regexp_extract("url", "/blob/HEAD/(.*)$", 1)).alias("path"),
                        four_digits(F.col("detail")).alias("detail"))


# --- credits ---------------------------------------------------------------
view("b_credit_lines", f"""
SELECT repo, i, prio, {stripped("txt")} AS txt FROM (SELECT repo, i, CASE d % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 11 END AS prio, CASE
  WHEN i % 8 = 0 THEN '* Supplier No' || ((d + i) % n) || ' for core ' || raw
  WHEN i % 8 = 4 THEN '* Supplier No' || ((d * 3 + i) % n) || ' ' || raw
  WHEN i % 4 = 1 THEN '@s' || ((d * 5 + i) % n) || ' for core, ' || raw ELSE raw END AS txt
FROM (SELECT *, (SELECT count(*) FROM supplier) AS n FROM b_wlines))""")


def credit_files(t) -> DataFrame:
    d_ = F.col("doc_id") % 3
    path = F.when(d_ == 0, "AUTHORS").when(d_ == 1, "THANKS.txt").otherwise("CONTRIBUTORS.md")
    who = lambda v: text(t.someone(v))
    return t.document_files(path, lambda w, i, d, x: (
        F.when(i % 8 == 0, cat("* Supplier No", who(d + i), " for core ", x))
         .when(i % 8 == 4, cat("* Supplier No", who(d * 3 + i), " ", x))
         .when(i % 4 == 1, cat("@s", who(d * 5 + i), " for core, ", x)).otherwise(x)))


view("b_credit", r"""
SELECT * FROM (
  SELECT h.*, c.trusted, c.commits, c.known, row_number() OVER (
    PARTITION BY person_id, repo ORDER BY prio, CASE WHEN strong THEN '' ELSE name END, i) AS n
  FROM (SELECT a.person_id, l.repo, l.prio, l.i, l.txt, TRUE AS strong, a.name
        FROM (SELECT *, unnest(regexp_extract_all(txt, '@([A-Za-z0-9-]+)', 1)) AS h FROM b_credit_lines) l
        JOIN b_acc a ON a.login = lower(l.h)
        UNION ALL
        SELECT a.person_id, l.repo, l.prio, l.i, l.txt, FALSE, a.name
        FROM b_credit_lines l JOIN b_cand c USING (repo) JOIN b_acc a ON a.person_id = c.person_id
        WHERE contains(lower(l.txt), a.name)) h JOIN b_cand c USING (person_id, repo))
WHERE n = 1 AND (strong OR trusted)""")


@check("credit_evidence", r"""
SELECT person_id, repo, 'core_contributor' AS role, CAST(CASE WHEN strong THEN 0.7 ELSE 0.5 END AS DOUBLE)
         AS confidence, NULL AS qualifier, 'credited in ' || (['AUTHORS', 'THANKS.txt', 'CONTRIBUTORS.md'])[prio // 5 + 1]
       || ': “' || q || '”' AS detail
FROM (SELECT *, CASE WHEN length(txt) > 60 THEN left(txt, 60) || '…' ELSE txt END AS q
      FROM b_credit) WHERE commits >= 10
UNION ALL
SELECT person_id, repo, 'author', CAST(CASE WHEN strong THEN 0.8 ELSE 0.65 END AS DOUBLE), 'Core',
       'credited for Core in ' || (['AUTHORS', 'THANKS.txt', 'CONTRIBUTORS.md'])[prio // 5 + 1] || ': “' || q || '”'
FROM (SELECT *, CASE WHEN length(txt) > 60 THEN left(txt, 60) || '…' ELSE txt END AS q
      FROM b_credit) WHERE known AND regexp_matches(lower(txt), '(^|[^\p{L}\p{N}_.])core($|[^\p{L}\p{N}_.])')""")
def credit_evidence(t):
    parts = t.known.select("repo", F.lit(0).alias("pos"), F.lit("core").alias("path"),
                           F.lit("author").alias("role"), F.lit("Core").alias("label"))
    found = credits.authors(context(t, files=credit_files(t), subcomponents=parts))
    return found.select("person_id", "repo", "role", "confidence", "qualifier", "detail")


@check("contained_passages", r"""
SELECT DISTINCT d.doc_id, n.name FROM documents d JOIN (
  SELECT DISTINCT trim(lower(unnest(string_split(text, '.')))) AS name FROM benchmark) n
ON length(n.name) >= 6 AND contains(lower(d.text), n.name)""")
def contained_passages(t):
    names = t.benchmark.select(F.explode(F.split(F.lower("text"), r"\.")).alias("name")).select(
        F.trim("name").alias("name"))
    texts = t.spread("documents").select("doc_id", F.lower("text").alias("text"))
    return contains_join(texts, names, ["doc_id"])


# --- manifests -------------------------------------------------------------
view("b_mf", """
SELECT repo, partkey % 6 AS m, (partkey * 3) % (SELECT count(*) FROM supplier) AS x,
       (partkey * 5 + 1) % (SELECT count(*) FROM supplier) AS y FROM b_repos""")
view("b_mf_people", """
SELECT repo, m, 'author' AS role, 'name' AS kind, 'supplier no' || x AS key FROM b_mf
UNION ALL SELECT repo, m, 'author', 'email', 's' || x || '@example.com' FROM b_mf WHERE m <> 1
UNION ALL SELECT repo, m, 'maintainer', 'name', 'supplier no' || y FROM b_mf WHERE m IN (0, 2, 3)
UNION ALL SELECT repo, m, 'maintainer', 'email', 's' || y || '@example.com' FROM b_mf WHERE m = 1""")


def manifest_files(t) -> DataFrame:
    k = F.col("partkey")
    x, y = text(t.someone(k * 3)), text(t.someone(k * 5 + 1))
    nx, ny = cat("Supplier No", x), cat("Supplier No", y)
    ex, ey = cat("s", x, "@example.com"), cat("s", y, "@example.com")
    texts = [
        cat('[project]\nname = "p"\nauthors = [{name = "', nx, '", email = "', ex,
            '"}]\nmaintainers = [{name = "', ny, '"}]\n'),
        cat("[metadata]\nname = p\nauthor = ", nx, ", Someone Else\nmaintainer_email = ", ey,
            "\n[options]\nauthor = Nobody Else\n"),
        cat('setup(name="p", author="', nx, "\", author_email='", ex, '\', maintainer = "', ny, '")\n'),
        cat('{"name": "p", "author": "', nx, " <", ex, '> (https://x.y)", "maintainers": [{"name": "',
            ny, '"}]}'),
        cat('[package]\nname = "p"\nauthors = ["', nx, " <", ex, '>"]\n'),
        cat('{"authors": [{"name": "', nx, '", "email": "', ex, '"}]}'),
    ]
    m = (k % 6 + 1).cast("int")
    return t.part_names.select(F.lit("github").alias("forge"), "repo",
                               F.element_at(F.lit(fixed.MANIFEST_PATHS), m).alias("path"),
                               F.element_at(F.array(*texts), m).alias("text"))


@check("manifest_people", """
SELECT repo, role, kind, key FROM b_mf_people
UNION ALL SELECT repo, 'author', 'name', 'someone else' FROM b_mf WHERE m = 1""")
def manifest_people(t):
    people = mf.manifest_people(manifest_files(t))
    return ev.listed_keys(people, ["repo", "role"])


@check("manifest_evidence", """
SELECT person_id, repo, role, CAST(CASE WHEN com THEN 0.8 WHEN how = 'email' THEN 0.75 ELSE 0.45 END AS DOUBLE)
         AS confidence, role || ' ' || how || ' in ' || (['pyproject.toml', 'setup.cfg', 'setup.py',
         'package.json', 'Cargo.toml', 'composer.json'])[m + 1]
       || CASE WHEN com THEN ', corroborated by commits' ELSE '' END AS detail
FROM (SELECT a.person_id, p.repo, p.role, p.m, min(p.kind) AS how, bool_or(c.commits IS NOT NULL) AS com
      FROM b_mf_people p JOIN b_acc a ON p.key = CASE p.kind WHEN 'name' THEN a.name ELSE a.email END
      JOIN b_cand c ON c.person_id = a.person_id AND c.repo = p.repo GROUP BY 1, 2, 3, 4)""")
def manifest_evidence(t):
    return mf.manifests(context(t, files=manifest_files(t))).select(
        "person_id", "repo", "role", "confidence", "detail")


def all_files(t) -> DataFrame:
    """Every kind of role file, for whole-run checks."""
    return reduce(DataFrame.unionByName, [
        codeowners_files(t), owners_files(t), maintainers_files(t), governance_files(t),
        credit_files(t), manifest_files(t), proposals(t)[0]])
