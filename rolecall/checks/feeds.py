"""Checks of pages, packages, claims, articles and curated rows."""

from pyspark.sql import functions as F

from ..functions import markup
from ..operators.evidence import feeds as ev, pages as pg
from ..sources import claims as src, hosts, packages as pkg
from .base import check, view
from .bindings import ALL_CURATED
from .documents import cat, text
from .rosters import context

ENTITIES = markup.ENTITIES

# --- pages -----------------------------------------------------------------
view("b_pages", """
SELECT page_id, url || '#' || page_id AS url, html || '<ul><li><a href="https://GitHub.com/S' ||
  (page_id * 7 % n) || '">x</a></li><li>Supplier&nbsp;No' || (page_id * 11 % n) || ' &amp; co</li></ul>' AS html
FROM pages, (SELECT count(*) AS n FROM supplier)""")
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_text(col: str) -> str:
    out = f"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    for name, char in [*ENTITIES.items(), ("&amp;", "&")]:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"lower(regexp_replace({out}, '{_BLANK}', ' ', 'g'))"


view("b_page_text", f"SELECT page_id, url, {_sql_text('html')} AS txt FROM b_pages")
view("b_rs", """
SELECT k.repo, p.url, CASE p.page_id % 3 WHEN 0 THEN 'maintainer' WHEN 1 THEN 'steering_council'
       ELSE 'code_owner' END AS role, CASE WHEN p.page_id % 2 = 0 THEN 'Team page' END AS label
FROM b_repos k JOIN b_pages p ON p.page_id % (SELECT count(*) FROM part) = k.partkey""")


def pages(t):
    k = F.col("page_id")
    extra = cat('<ul><li><a href="https://GitHub.com/S', text(t.someone(k * 7)),
                '">x</a></li><li>Supplier&nbsp;No', text(t.someone(k * 11)), " &amp; co</li></ul>")
    return t.spread("pages").select("page_id", cat(F.col("url"), "#", text(k)).alias("url"),
                          cat(F.col("html"), extra).alias("html"))


def role_sources(t):
    n = t.part.agg(F.count(F.lit(1)).alias("n")).scalar()
    m = F.col("page_id") % 3
    return pages(t).withColumn("partkey", F.pmod("page_id", n)).join(t.part_names.select("partkey", "repo"), "partkey").select(
        "repo", F.col("page_id").cast("int").alias("pos"), "url",
        F.when(m == 0, "maintainer").when(m == 1, "steering_council").otherwise("code_owner").alias("role"),
        F.when(F.col("page_id") % 2 == 0, "Team page").alias("label"))


@check("page_handles", r"""
SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '(?i)github\.com/([A-Za-z0-9-]+)', 1))) AS handle
FROM b_pages""")
def page_handles(t):
    return pages(t).select("page_id", F.explode(markup.page_handles(F.col("html"))).alias("handle"))


@check("page_text", "SELECT page_id, txt FROM b_page_text")
def page_text(t):
    return pages(t).select("page_id", markup.page_text(F.col("html")).alias("txt"))


def _page_sql(strong: str, weak: str, tail: str, sources: str, where: str) -> str:
    return f"""
SELECT person_id, repo, url, role, CAST(CASE WHEN strong THEN {strong} ELSE {weak} END AS DOUBLE) AS confidence,
       CASE WHEN strong THEN 'listed by GitHub handle on ' ELSE 'listed by name on ' END || label || '{tail}' AS detail
FROM (SELECT c.person_id, c.repo, s.url, s.role, s.label, bool_or(lower(p.html) LIKE '%github.com/' || a.login || '"%')
               AS strong
      FROM ({sources}) s JOIN b_pages p USING (url) JOIN b_page_text x USING (url)
      JOIN b_cand c ON c.repo = s.repo JOIN b_acc a ON a.person_id = c.person_id
      WHERE ({where}) AND (lower(p.html) LIKE '%github.com/' || a.login || '"%'
         OR (s.role <> 'steering_council' AND contains(x.txt, a.name))) GROUP BY ALL)"""


@check("page_roles", _page_sql(
    "0.9", "0.75", "", "SELECT repo, url, role, coalesce(label, 'project role page') AS label FROM b_rs", "TRUE"), "AllCurated", ALL_CURATED)
def page_roles(t):
    ctx = context(t, pages=pages(t).drop("page_id"), role_sources=role_sources(t))
    return pg.web_roles(ctx).select("person_id", "repo", "url", "role", "confidence", "detail")


def discovered_sources(t):
    p = pages(t)
    return t.part_names.select("repo", F.floor(F.col("partkey") / 8).cast("bigint").alias("page_id")).join(
        p, "page_id").select("repo", F.col("page_id").cast("int").alias("pos"), "url", F.when(
            F.col("page_id") % 4 == 0, "Steering group").otherwise("Core team").alias("role"),
        F.lit(None).cast("string").alias("label"))


@check("discovered_page_roles", _page_sql(
    "0.85", "0.6", " (web-search discovered)",
    "SELECT r.repo, p.url, CASE WHEN p.page_id % 4 = 0 THEN 'steering_council' ELSE 'maintainer' END AS role, "
    "'discovered role page' AS label FROM b_repos r JOIN b_pages p ON p.page_id = r.partkey // 8 "
    "WHERE r.repo NOT IN (SELECT repo FROM b_rs JOIN b_known USING (repo))", "c.notable"))
def discovered_page_roles(t):
    p, found = pages(t), discovered_sources(t)
    ctx = context(t, pages=p.drop("page_id"), role_sources=role_sources(t), discovered_sources=found)
    return pg.web_roles_auto(ctx).select("person_id", "repo", "url", "role", "confidence", "detail")


# --- packages --------------------------------------------------------------
view("b_pk", """
SELECT r.*, n, h, (partkey * 3) % h AS x, CASE WHEN partkey % 3 = 0 THEN (partkey * 3) % h
       ELSE (partkey * 5 + 2) % n END AS who
FROM b_repos r, (SELECT count(*) AS n, count(*) // 2 AS h FROM supplier)""")
view("b_pk_refs", """
SELECT x AS person_id, 'npm' AS registry, 'pkg' || partkey AS name, repo, who % h = x AS author
FROM b_pk WHERE partkey % 4 IN (0, 3)
UNION ALL SELECT x, 'crates', 'pkg' || partkey, repo, FALSE FROM b_pk WHERE partkey % 4 = 1""")


def package_docs(t):
    k = F.col("partkey")
    half = F.floor(t.n_suppliers / 2).cast("bigint")
    x = F.pmod(k * 3, half)
    who = F.when(k % 3 == 0, x).otherwise(t.someone(k * 5 + 2))
    git = cat("git+https://github.com/", F.col("repo"), ".git")
    author = cat('"author": {"name": "Supplier No', text(who), '"}')
    npm = lambda body: cat('{"objects": [{"package": {"name": "pkg', text(k), '", ', body, ", ", author, "}}]}")
    m = k % 4
    pypi_home = F.when(k % 8 == 6, "https://github.com/else/where").otherwise(
        cat("https://github.com/", F.col("repo")))
    return t.part_names.select(
        F.when(m.isin(0, 3), "npm").when(m == 1, "crates").otherwise("pypi").alias("registry"),
        t.login(x).alias("login"),
        F.when(m == 0, npm(cat('"repository": {"type": "git", "url": "', git, '"}')))
         .when(m == 3, npm(cat('"links": {"repository": "', git, '"}')))
         .when(m == 1, cat('{"crates": [{"name": "pkg', text(k), '", "repository": "', git, '"}]}'))
         .otherwise(cat('{"info": {"name": "part', text(k), '", "author": "Supplier No', text(who),
                        '", "home_page": "', pypi_home, '", "project_urls": {"Docs": "https://d.io"}}}'))
         .alias("payload"))


@check("package_listing", "SELECT person_id, registry, name, repo, author AS author_match FROM b_pk_refs")
def package_listing(t):
    return pkg.person_packages(package_docs(t), t.people, t.keys).select(
        "person_id", "registry", "name", "repo", "author_match")


@check("package_evidence", """
SELECT p.person_id, p.repo, p.registry AS source, CASE WHEN author THEN 'author' ELSE 'maintainer' END AS role,
       round(CAST(CASE p.registry WHEN 'crates' THEN 0.85 WHEN 'npm' THEN 0.78 ELSE 0.8 END
             + CASE WHEN author THEN 0.05 ELSE 0 END AS DOUBLE), 6) AS confidence,
       CASE p.registry WHEN 'crates' THEN 'crates.io' WHEN 'npm' THEN 'npm' ELSE 'PyPI' END
       || CASE WHEN author THEN ' author' ELSE ' maintainer' END || ' of package “' || p.name || '”' AS detail
FROM (SELECT * FROM b_pk_refs
      UNION ALL SELECT a.person_id, 'pypi', 'part' || k.partkey, k.repo, TRUE FROM b_pk k
                JOIN b_acc a ON a.k = k.who WHERE k.partkey % 4 = 2 AND k.partkey % 8 <> 6) p
JOIN b_cand c USING (person_id, repo)""")
def package_evidence(t):
    docs = package_docs(t)
    ctx = context(t, pkg.person_packages(docs, t.people, t.keys), package_docs=docs)
    return ev.packages(ctx).select("person_id", "repo", "source", "role",
                                   F.round("confidence", 6).alias("confidence"), "detail")


# --- claims ----------------------------------------------------------------
view("b_claims", """
SELECT repo, 'P170' AS property, 's' || (partkey * 3 % n) AS handle, 'http://www.wikidata.org/entity/Q' || partkey
         AS item FROM b_pk
UNION ALL SELECT repo, CASE WHEN partkey % 2 = 0 THEN 'P178' ELSE 'P999' END, 's' || (partkey * 7 % n),
         'http://www.wikidata.org/entity/Q' || partkey FROM b_pk""")


def claim_docs(t):
    k = F.col("partkey")
    b = lambda who, prop: cat(
        '{"gh": {"value": "S', text(who), '"}, "prop": {"value": "http://www.wikidata.org/prop/direct/', prop,
        '"}, "item": {"value": "http://www.wikidata.org/entity/Q', text(k), '"}}')
    return t.part_names.select("repo", cat(
        '{"results": {"bindings": [', b(t.someone(k * 3), "P170"), ", ",
        b(t.someone(k * 7), F.when(k % 2 == 0, "P178").otherwise("P999")),
        ', {"gh": {"value": "x"}}]}}').alias("payload"))


@check("read_claims", "SELECT repo, property, handle, item FROM b_claims")
def read_claims(t):
    return src.read_claims(claim_docs(t))


@check("claim_evidence", """
SELECT DISTINCT c.person_id, c.repo, CASE property WHEN 'P178' THEN 'maintainer' ELSE 'author' END AS role,
       CAST(CASE property WHEN 'P178' THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence,
       CASE property WHEN 'P178' THEN 'developer' ELSE 'creator' END || ' of the project (Wikidata)' AS detail
FROM b_claims l JOIN b_acc a ON a.login = l.handle
JOIN b_cand c ON c.person_id = a.person_id AND c.repo = l.repo AND c.notable WHERE property <> 'P999'""")
def claim_evidence(t):
    return ev.wikidata(context(t, claims=src.read_claims(claim_docs(t)))).select(
        "person_id", "repo", "role", "confidence", "detail")


# --- articles --------------------------------------------------------------
view("b_art_names", """
SELECT repo, partkey, 'Supplier No' || (partkey * 3 % n) AS name, FALSE AS relaxed FROM b_pk
UNION ALL SELECT repo, partkey, 'Supplier No' || (partkey * 5 % n), FALSE FROM b_pk
UNION ALL SELECT repo, partkey, 'Supplier No' || (partkey * 7 % n), FALSE FROM b_pk
UNION ALL SELECT repo, partkey, 'Supplier Q. No' || (partkey * 11 % n), TRUE FROM b_pk""")


def articles(t):
    k = F.col("partkey")
    who = lambda f: cat("Supplier No", text(t.someone(k * f)))
    wikitext = cat("{{Infobox software\n| name = Part\n| Author = [[", who(3), "]], [[X|", who(5),
                   "]]<ref name=a>r, s</ref><br/>The Dev Team\n| genre = x\n}}\n'''Part''' was initially created by ",
                   who(7), " in 2001; later re-founded by Supplier Q. No", text(t.someone(k * 11)), " again. ",
                   F.coalesce("text", F.lit("")))
    docs = t.spread("documents").select(F.col("doc_id").alias("partkey"), "text")
    return t.part_names.join(docs, "partkey", "left").select(
        "repo", cat("Part ", text(k), " (software)").alias("title"), wikitext.alias("wikitext"))


@check("article_authors", "SELECT DISTINCT repo, name FROM b_art_names")
def article_authors(t):
    return articles(t).select("repo", F.explode(markup.article_authors(F.col("wikitext"))).alias("name"))


@check("article_evidence", """
SELECT person_id, repo, CAST(0.6 AS DOUBLE) AS confidence,
       'https://en.wikipedia.org/wiki/Part_' || partkey || '_%28software%29' AS url,
       'credited as an original author in the “Part ' || partkey || ' (software)” Wikipedia article' ||
       CASE WHEN bool_and(relaxed) THEN ' (name + contribution)' ELSE '' END AS detail
FROM (SELECT c.person_id, c.repo, n.partkey, n.relaxed FROM b_art_names n JOIN b_cand c USING (repo)
      JOIN b_acc a ON a.person_id = c.person_id AND a.name = lower(replace(n.name, 'Q. ', ''))
      WHERE c.notable AND (NOT n.relaxed OR c.genuine OR c.commits IS NOT NULL))
GROUP BY person_id, repo, partkey""")
def article_evidence(t):
    return ev.wikipedia_authors(context(t, articles=articles(t))).select(
        "person_id", "repo", "confidence", "url", "detail")


@check("article_titles", """
SELECT repo, 'Part ' || partkey || ' (C++) é' AS title FROM b_repos WHERE partkey % 5 <> 1""")
def article_titles(t):
    k = F.col("partkey")
    url = F.when(k % 5 == 1, "https://example.org/x").otherwise(
        cat("https://en.wikipedia.org/wiki/Part_", text(k), "_(C%2B+)_%C3%A9"))
    return src.read_article_titles(t.part_names.select("repo", cat(
        '{"results": {"bindings": [{"article": {"value": "https://x.org/none"}}, {"article": {"value": "', url,
        '"}}]}}').alias("payload")))


# --- founders and curated roles ----------------------------------------------
@check("founder_evidence", """
SELECT person_id, repo, CAST(CASE WHEN o % 2 = 1 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS confidence FROM (
  SELECT c.person_id, c.repo, min(f.o) AS o FROM (
    SELECT repo, 's' || (partkey * 3 % n) AS login, NULL AS name, 0 AS o FROM b_pk
    UNION ALL SELECT repo, NULL, 'supplier no' || (partkey * 5 % n), 1 FROM b_pk
    UNION ALL SELECT repo, 's' || (partkey * 9 % n), NULL, 2 FROM b_pk) f
  JOIN b_acc a ON a.login = f.login OR a.name = f.name
  JOIN b_cand c ON c.person_id = a.person_id AND c.repo = f.repo AND c.notable GROUP BY 1, 2)""")
def founder_evidence(t):
    return ev.founders(context(t, founder_claims=src.founder_claims(founder_docs(t)))).select(
        "person_id", "repo", "confidence")


def founder_docs(t):
    k = F.col("partkey")
    claim = lambda pos, handle, name: F.struct(
        F.lit(pos).alias("pos"), handle.alias("handle"), name.alias("name"))
    null = F.lit(None).cast("string")
    return t.part_names.select("repo", F.explode(F.array(
        claim(0, cat("@S", text(t.someone(k * 3))), cat("Supplier No", text(t.someone(k * 5)))),
        claim(1, cat("s", text(t.someone(k * 9))), null))).alias("c")).select(
        "repo", "c.handle", "c.name", null.alias("url"), "c.pos")


@check("curated_evidence", """
SELECT c.person_id, c.repo, 'author' AS role, CAST(0.95 AS DOUBLE) AS confidence, 'curated: author' AS detail
FROM b_cand c JOIN b_repos r USING (repo) JOIN b_acc a ON a.person_id = c.person_id
 AND a.k = r.partkey * 3 % (SELECT count(*) FROM supplier)""", "AllCurated", ALL_CURATED)
def curated_evidence(t):
    return ev.curated(context(t, curated_roles=curated_roles(t))).select("person_id", "repo", "role", "confidence", "detail")


def curated_roles(t):
    k = F.col("partkey")
    return t.part_names.select(
        "repo", F.lit(0).alias("pos"), cat("@S", text(t.someone(k * 3))).alias("login"),
        F.lit("author").alias("role"), F.lit("").alias("url"), F.lit(None).cast("string").alias("label"))


# --- host payloads -----------------------------------------------------------
@check("host_payloads", """
SELECT CASE m WHEN 0 THEN 'github' WHEN 1 THEN 'github' WHEN 2 THEN 'gitlab' WHEN 3 THEN 'codeberg'
         WHEN 4 THEN 'gitee' WHEN 5 THEN 'bitbucket' ELSE 'cgit' END AS forge, repo,
       CASE WHEN m = 0 AND partkey % 4 = 0 THEN NULL WHEN m IN (5, 6) THEN 0 ELSE stars END AS stars,
       CASE WHEN m = 0 AND partkey % 4 = 0 THEN NULL WHEN m = 6 THEN 0 ELSE forks END AS forks,
       m <> 6 AND is_fork AS is_fork, m <> 6 AND is_private AS is_private,
       CASE WHEN m IN (0, 1) THEN parent END AS parent
FROM (SELECT *, partkey % 7 AS m FROM b_repos)""")
def host_payloads(t):
    p = t.part_repos
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    s, f, r = text(F.col("stars")), text(F.col("forks")), F.col("repo")
    up = lambda field: F.when(F.col("parent").isNotNull(), cat(
        ', "parent": {"', field, '": "', F.col("parent"), '"}')).otherwise("")
    gone = F.when(F.col("partkey") % 4 == 0, "null").otherwise(s)
    rest = lambda stars, extra="": cat('{"full_name": "', r, '", "', stars, '": ', s, ', "forks_count": ', f,
                                       ', "fork": ', flag("is_fork"), ', "private": ', flag("is_private"), extra, "}")
    shapes = {
        "github_graphql": cat('{"nameWithOwner": "', r, '", "stargazerCount": ', gone, ', "forkCount": ', f,
                              ', "isFork": ', flag("is_fork"), ', "isPrivate": ', flag("is_private"),
                              up("nameWithOwner"), "}"),
        "github": rest("stargazers_count", up("full_name")),
        "gitlab": cat('{"path_with_namespace": "', r, '", "star_count": ', s, ', "forks_count": ', f,
                      F.when(F.col("is_fork"), ', "forked_from_project": {"id": 1}').otherwise(""),
                      ', "visibility": "', F.when(F.col("is_private"), "internal").otherwise("public"), '"}'),
        "codeberg": rest("stars_count"), "gitee": rest("stargazers_count"),
        "bitbucket": cat('{"full_name": "', r, '", "parent": ', F.when(F.col("is_fork"), '{"x": 1}').otherwise("null"),
                         ', "is_private": ', flag("is_private"), ', "watchers": ', f, "}"),
        "cgit": cat('{"full_name": "', r, '"}'),
    }
    out = None
    for i, (shape, payload) in enumerate(shapes.items()):
        part = hosts.normalise(p.where(F.col("partkey") % 7 == i).select(payload.alias("payload")), shape)
        out = part if out is None else out.unionByName(part)
    return out.select("forge", "repo", "stars", "forks", "is_fork", "is_private", "parent")
