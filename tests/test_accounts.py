"""Account linking and name resolution."""

import pytest

import rolecall.checks.accounts  # registers its queries
from rolecall.checks.base import QUERIES
from rolecall.operators import accounts as ac

URL = {"github": "https://github.com/", "gitlab": "https://gitlab.com/", "codeberg": "https://codeberg.org/"}


def resolve(spark, links, pages=(), names=(), **kw):
    anchors = spark.createDataFrame([(1, "github", "Jane")], "person_id bigint, forge string, login string")
    l = spark.createDataFrame([(f, u, URL[x] + y if x in URL else x + y) for f, u, x, y in links],
                              "forge string, login string, url string")
    p = spark.createDataFrame(list(pages), "url string, html string") if pages else spark.createDataFrame(
        [], "url string, html string")
    a = spark.createDataFrame(list(names) or [("github", "none", None)], "forge string, login string, name string")
    out = ac.resolve_accounts(anchors, l, p, a, **kw)
    return {(r.forge, r.login) for r in out.collect()}


G, L, C = "github", "gitlab", "codeberg"


def test_mutual_links_confirm(spark):
    assert resolve(spark, [(G, "jane", L, "jdoe"), (L, "jdoe", G, "JANE")]) == {(G, "jane"), (L, "jdoe")}


def test_one_way_link_does_not(spark):
    assert resolve(spark, [(G, "jane", L, "jdoe")]) == {(G, "jane")}


def test_transitive(spark):
    got = resolve(spark, [(G, "jane", L, "jdoe"), (L, "jdoe", G, "jane"), (L, "jdoe", C, "jd"), (C, "jd", L, "jdoe")])
    assert got == {(G, "jane"), (L, "jdoe"), (C, "jd")}


HUB = "https://jane.example/"


def page(*accounts):
    return [(HUB, " ".join(f'<a href="{URL[f]}{u}">x</a>' for f, u in accounts))]


def test_hub_accepts_same_login_or_same_name(spark):
    links = [(G, "jane", HUB, "")]
    assert resolve(spark, links, page((G, "jane"), (L, "Jane"), (C, "other"))) == {(G, "jane"), (L, "jane")}
    names = [(G, "jane", "Jane Doe"), (C, "other", " jane doe ")]
    assert resolve(spark, links, page((G, "jane"), (C, "other")), names) == {(G, "jane"), (C, "other")}


def test_hub_must_list_a_confirmed_account(spark):
    links = [(G, "jane", HUB, "")]
    assert resolve(spark, links, page((L, "jane"), (C, "jane"))) == {(G, "jane")}
    farm = page((G, "jane"), (L, "jane"), *[(C, f"u{i}") for i in range(9)])
    assert resolve(spark, links, farm) == {(G, "jane"), (L, "jane")}
    assert resolve(spark, links, farm, max_hub_accounts=6) == {(G, "jane")}


def test_cap_stops_a_chain(spark):
    chain = []
    prev = (G, "jane")
    for i in range(12):
        nxt = (L, f"u{i}")
        chain += [(*prev, *nxt), (*nxt, *prev)]
        prev = nxt
    assert len(resolve(spark, chain)) == 13
    assert len(resolve(spark, chain, max_accounts=3)) == 3


def test_registered_closure_is_the_fixpoint(spark, tmp_path):
    n, hosts = 30, ["github", "gitlab", "codeberg", "gitee", "bitbucket"]
    orders = [(o, o * 37 % 101 % n + 1) for o in range(1, 160)]
    segment = {k: "ABC"[k % 3] if k > 4 else "SAME" for k in range(1, n + 1)}
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(list(segment.items()), "c_custkey bigint, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    edges = {(k, (o * 7919 + 13) % n) for o, k in orders}
    sites = {}
    for o, k in orders:
        sites.setdefault(o // 5 if o // 40 % 2 == 0 else 10**9 + o // 8, set()).add(k)
    name = {k: (s, k % 200) for k, s in segment.items()}
    want = set()
    for person in segment:
        mine, new, r = set(), {person}, 0
        while new:
            want |= {(person, hosts[k % 5], f"c{k}", r) for k in new}
            mine, r = mine | new, r + 1
            out, into = {b for a, b in edges if a in mine}, {a for a, b in edges if b in mine}
            named = {k for s in sites.values() if s & mine for k in s if name[k] in {name[m] for m in mine if m in name}}
            new = ((out & into) | named) - mine
    got = {tuple(x) for x in QUERIES["identity_closure"](spark, str(tmp_path)).select("person_id", "forge", "login", "round").collect()}
    assert max(sum(w[0] == p for w in want) for p in segment) > 8
    assert got == want


@pytest.mark.parametrize("query, login, n", [
    ("Jane Roe", "jroe", 1), ("john smith", None, 2), ("No Body", None, 0), ("Wiki Person", "wp", 1),
    ("Two Wikis", None, 2)])
def test_resolve_names(spark, query, login, n):
    a = spark.createDataFrame([("jroe", "Jane Q. Roe", None), ("js1", "John Smith", None), ("js2", "Smith John", None)],
                              "login string, name string, bio string")
    c = spark.createDataFrame([("wiki person", "wp"), ("Two Wikis", "a"), ("two wikis", "b"), ("Jane Roe", "zz")],
                              "name string, login string")
    q = spark.createDataFrame([(query,)], "query string")
    r = ac.resolve_names(q, a, c).first()
    assert (r.login, r.n_candidates) == (login, n)


def test_a_site_is_asked_by_key(spark):
    """Rows follow a person's keys, not the accounts a site lists beside them."""
    listed = spark.createDataFrame([("u", "gitlab", "jane"), ("u", "gitlab", "other"), *[("u", "codeberg", f"x{i}") for i in range(50)]],
                                   "url string, forge string, login string")
    names = spark.createDataFrame([("github", "jane", "Jane Doe"), ("gitlab", "other", "Jane Doe")], "forge string, login string, name string")
    mine = spark.createDataFrame([(1, "github", "jane")], "person_id bigint, forge string, login string")
    asked = ac._asked(spark.createDataFrame([(1, "u")], "person_id bigint, url string"), ac._own_keys(mine, names))
    assert sorted((r.url, r.kind, r.key) for r in asked.collect()) == [("u", "login", "jane"), ("u", "name", "Jane Doe")]
    assert sorted(tuple(r) for r in ac._agreed(asked, ac._site_keys(listed, names)).collect()) == [(1, "gitlab", "jane"), (1, "gitlab", "other")]
