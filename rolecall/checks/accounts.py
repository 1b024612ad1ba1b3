"""Checks of account linking and name resolution, over customers and orders."""

from pyspark.sql import functions as F

from ..operators import accounts as ac
from .base import check, view
from .documents import cat, text

# Host of an account, by its number modulo five.
HOSTS = ["github", "gitlab", "codeberg", "gitee", "bitbucket"]
WEB = ["github.com", "gitlab.com", "codeberg.org", "gitee.com", "bitbucket.org"]

view("b_links", f"""
SELECT ({HOSTS})[o_custkey % 5 + 1] AS forge, 'c' || o_custkey AS login,
       ({HOSTS})[dst % 5 + 1] AS to_forge, 'c' || dst AS to_login
FROM (SELECT DISTINCT o_custkey, (o_orderkey * 7919 + 13) % (SELECT count(*) FROM customer) AS dst FROM orders)""")
view("b_sites", """
SELECT DISTINCT CASE WHEN o_orderkey // 40 % 2 = 0 THEN o_orderkey // 5 ELSE 1000000000 + o_orderkey // 8 END AS site,
       o_custkey AS k FROM orders""")


def _host(k, values=HOSTS):
    return F.element_at(F.lit(values), (k % 5 + 1).cast("int"))


def profile_links(t):
    n = t.customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    src, dst = F.col("o_custkey"), F.pmod(F.col("o_orderkey") * 7919 + 13, n)
    direct = t.orders.select(_host(src).alias("forge"), cat("C", text(src)).alias("login"),
                             cat("https://", _host(dst, WEB), "/C", text(dst)).alias("url"))
    own = t.orders.select(
        _host(src).alias("forge"), cat("c", text(src)).alias("login"),
        cat("https://site.example/", text(_site())).alias("url"))
    return direct.unionByName(own).distinct()


def _site():
    o = F.col("o_orderkey")
    div = lambda v, d: F.floor(v / d).cast("bigint")
    return F.when(div(o, 40) % 2 == 0, div(o, 5)).otherwise(F.lit(1000000000) + div(o, 8))


def site_pages(t):
    """One page per site; a site lists the customers of five or eight orders."""
    url = cat("https://", _host(F.col("o_custkey"), WEB), "/c", text(F.col("o_custkey")))
    return t.orders.groupBy(_site().alias("site")).agg(
        F.array_join(F.array_sort(F.collect_set(cat("<a href='", url, "'>me</a>"))), "\n").alias("html")).select(
        cat("https://site.example/", text(F.col("site"))).alias("url"), "html")


def customer_accounts(t):
    k = F.col("c_custkey")
    return t.customer.select(
        F.lit(None).cast("bigint").alias("person_id"), _host(k).alias("forge"), cat("c", text(k)).alias("login"),
        cat("Customer ", F.initcap("c_mktsegment"), " N", text(k % 200)).alias("name"),
        F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("bio"),
        F.lit(None).cast("string").alias("website"))


@check("profile_edges", "SELECT * FROM b_links")
def profile_edges(t):
    return ac.profile_edges(profile_links(t))


@check("mutual_links", """
SELECT a.* FROM b_links a JOIN b_links b ON a.forge = b.to_forge AND a.login = b.to_login
 AND a.to_forge = b.forge AND a.to_login = b.login""")
def mutual_links(t):
    return ac.mutual_links(ac.profile_edges(profile_links(t)))


@check("hub_accounts", f"""
SELECT 'https://site.example/' || site AS url, ({HOSTS})[k % 5 + 1] AS forge, 'c' || k AS login FROM b_sites
""")
def hub_accounts(t):
    return ac.hub_accounts(site_pages(t)).select("url", F.explode("accounts").alias("a")).select(
        "url", "a.forge", "a.login")


view("b_conf", f"SELECT c_custkey AS person_id, ({HOSTS})[c_custkey % 5 + 1] AS forge, 'c' || c_custkey AS login FROM customer")
view("b_named", f"""
SELECT ({HOSTS})[c_custkey % 5 + 1] AS forge, 'c' || c_custkey AS login,
       lower('Customer ' || c_mktsegment || ' N' || (c_custkey % 200)) AS name FROM customer""")
view("b_onsite", """
SELECT 'https://site.example/' || s.site AS url, s.site, ({h})[s.k % 5 + 1] AS forge, 'c' || s.k AS login
FROM b_sites s""".replace("{h}", str(HOSTS)))
view("b_mysites", f"""
SELECT DISTINCT o_custkey AS person_id, CASE WHEN o_orderkey // 40 % 2 = 0 THEN o_orderkey // 5
  ELSE 1000000000 + o_orderkey // 8 END AS site FROM orders""")


@check("identity_round", """
SELECT c.person_id, a.to_forge AS forge, a.to_login AS login FROM b_conf c
JOIN b_links a USING (forge, login)
JOIN b_links b ON b.forge = a.to_forge AND b.login = a.to_login AND b.to_forge = c.forge AND b.to_login = c.login
WHERE a.to_login <> c.login
UNION
SELECT c.person_id, s.forge, s.login FROM b_conf c JOIN b_mysites m USING (person_id)
JOIN b_onsite s USING (site) JOIN b_onsite own ON own.site = s.site AND own.login = c.login
JOIN b_named x ON x.login = s.login JOIN b_named y ON y.login = c.login AND y.name = x.name
WHERE s.login <> c.login""")
def identity_round(t):
    links, pages = profile_links(t), site_pages(t)
    hubs = ac.hub_accounts(pages)
    listed = hubs.select("url", F.explode("accounts").alias("a")).select("url", "a.forge", "a.login")
    anchors = customer_accounts(t).select(
        F.substring("login", 2, 20).cast("bigint").alias("person_id"), "forge", "login")
    return ac.closure_round(anchors, ac.profile_edges(links), ac.hub_links(links, hubs), listed,
                            customer_accounts(t))


def _closure_sql(rounds: int = 24) -> str:
    """The rounds one after the other, each over all accounts confirmed before it.

    Of numbers: an account is its customer's, a person the customer it began with.
    """
    parts = ["""links AS MATERIALIZED (SELECT DISTINCT o_custkey AS a, (o_orderkey * 7919 + 13) % (SELECT count(*) FROM customer) AS b FROM orders),
sites AS MATERIALIZED (SELECT DISTINCT CASE WHEN o_orderkey // 40 % 2 = 0 THEN o_orderkey // 5 ELSE 1000000000 + o_orderkey // 8 END AS site, o_custkey AS k FROM orders),
named AS MATERIALIZED (SELECT c_custkey AS k, c_mktsegment || (c_custkey % 200) AS name FROM customer),
c0 AS MATERIALIZED (SELECT c_custkey AS p, c_custkey AS k, 0 AS round FROM customer)"""]
    for r in range(1, rounds + 1):
        c = f"c{r - 1}"
        # A site names all its customers' accounts, and all of them link to it.
        parts.append(f"""c{r} AS MATERIALIZED (SELECT * FROM {c} UNION ALL SELECT p, k, {r} FROM (
  SELECT * FROM (SELECT c.p, l.b AS k FROM {c} c JOIN links l ON l.a = c.k INTERSECT SELECT c.p, l.a FROM {c} c JOIN links l ON l.b = c.k)
  UNION SELECT DISTINCT o.p, o.k FROM (SELECT DISTINCT c.p, t.k, n.name FROM {c} c JOIN sites s ON s.k = c.k JOIN sites t ON t.site = s.site JOIN named n ON n.k = t.k) o
    JOIN (SELECT DISTINCT c.p, n.name FROM {c} c JOIN named n ON n.k = c.k) m ON m.p = o.p AND m.name = o.name
  EXCEPT SELECT p, k FROM {c}))""")
    return f"""WITH {", ".join(parts)}
SELECT p AS person_id, ({HOSTS})[k % 5 + 1] AS forge, 'c' || k AS login, round::INTEGER AS round FROM c{rounds}"""


@check("identity_closure", _closure_sql())
def identity_closure(t):
    anchors = customer_accounts(t).select(
        F.substring("login", 2, 20).cast("bigint").alias("person_id"), "forge", "login")
    return ac.resolve_accounts(anchors, profile_links(t), site_pages(t), customer_accounts(t))


# --- names -----------------------------------------------------------------
view("b_queries", """
SELECT DISTINCT c_mktsegment || ' n' || (c_custkey % 200) AS query FROM customer
UNION SELECT 'Ghost N' || c_custkey FROM customer""")
view("b_search", """
SELECT q.query, 'c' || c.c_custkey AS login FROM b_queries q JOIN customer c
ON lower(q.query) = lower(c.c_mktsegment) || ' n' || (c.c_custkey % 200)""")


def queries(t):
    k = F.col("c_custkey")
    known = t.customer.select(cat(F.col("c_mktsegment"), " n", text(k % 200)).alias("query"))
    ghosts = t.customer.select(cat("Ghost N", text(k)).alias("query"))
    return known.unionByName(ghosts).distinct()


@check("search_accounts", "SELECT query, login FROM b_search")
def search_accounts(t):
    return ac.search_accounts(queries(t), customer_accounts(t)).select("query", "login")


@check("first_accounts", """
SELECT query, login FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY login) AS n FROM b_search)
WHERE n <= 2""")
def first_accounts(t):
    return ac.search_accounts(queries(t), customer_accounts(t), 2).select("query", "login")


@check("resolve_names", """
SELECT q.query, CASE WHEN n = 1 THEN one WHEN n IS NULL AND q.query LIKE 'Ghost%' AND k % 2 = 0 THEN 'g' || k END AS login,
       coalesce(n, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END) AS n_candidates
FROM (SELECT *, CAST(regexp_extract(query, '([0-9]+)$', 1) AS BIGINT) AS k FROM b_queries) q
LEFT JOIN (SELECT query, count(*) AS n, min(login) AS one FROM b_search GROUP BY query) s USING (query)""")
def resolve_names(t):
    k = F.col("c_custkey")
    claims = t.customer.select(cat("ghost n", text(k)).alias("name"), F.explode(F.array(
        cat("g", text(k)), cat("g", text(F.when(k % 2 == 0, k).otherwise(k + 1))))).alias("login"))
    return ac.resolve_names(queries(t), customer_accounts(t), claims)
