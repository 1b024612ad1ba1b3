"""Column expressions on small literals."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions import display, documents as doc, markup, people as ppl, roles, text, urls


@pytest.mark.parametrize("raw, key", [("@@Jane", "jane"), ("Jane-D", "jane-d"), ("", None), ("@", None)])
def test_handle_key(one, raw, key):
    assert one(text.handle_key, raw) == key


def test_fold_strips_every_kind_of_blank(one):
    assert one(text.fold, " \t Jane DOE  \n") == "jane doe"
    assert one(text.fold, "  \t") is None


@pytest.mark.parametrize("query, name, ok", [
    ("Jane Roe", "Jane Q. Roe", True), ("roe jane", "Jane Roe", True),
    ("Jane Roe", "Jane Doe", False), ("Jane Roe", None, False), ("", "Jane", False)])
def test_name_matches(one, query, name, ok):
    assert one(text.name_matches, query, name) is ok


def test_first_last_ignores_the_middle(one):
    assert one(text.first_last, "Travis E. Oliphant") == "travis oliphant"
    assert one(text.first_last, "Madonna") is None


@pytest.mark.parametrize("commits, rank, conf", [
    (100, 40, 0.8), (99, 40, 0.6), (25, 90, 0.6), (24, 10, 0.8), (10, 10, 0.8),
    (11, 17, None), (9, 1, None), (2, 1, None)])
def test_contributor_confidence(one, commits, rank, conf):
    assert one(roles.contributor_confidence, commits, rank) == conf


@pytest.mark.parametrize("n, conf", [(80, .85), (50, .85), (20, .7), (6, .55), (3, None)])
def test_path_confidence(one, n, conf):
    assert one(roles.path_confidence, n) == conf


@pytest.mark.parametrize("mine, total, conf", [(1, 10, None), (2, 100, .56), (88, 100, .86), (10, 10, .9)])
def test_release_confidence(one, mine, total, conf):
    assert one(roles.release_confidence, mine, total) == conf


def test_source_bits(one):
    mask = roles.bits("history", "org-repo")
    assert one(roles.source_labels, mask) == ["history", "org-repo"]
    assert one(roles.is_genuine, mask) and not one(roles.is_speculative, mask)
    assert one(roles.is_speculative, roles.bits("org-repo", "registry"))
    assert not one(roles.is_speculative, 0)
    assert one(roles.source_bit, "search:OWNERS") == roles.bits("search:OWNERS")
    assert one(roles.source_bit, "no such source") == 0


@pytest.mark.parametrize("url, repo", [
    ("https://github.com/o/r", "o/r"), ("git+https://github.com/o/r.git", "o/r"),
    ("git@github.com:o/r.git", "o/r"), ("https://github.com/o/r/tree/main", "o/r"),
    ("https://GitHub.com/o/r", "o/r"), ("https://github.com/sponsors/x", None),
    ("https://gitlab.com/o/r", None), (None, None), ("", None)])
def test_github_repo(one, url, repo):
    assert one(urls.github_repo, url) == repo


@pytest.mark.parametrize("url, got", [
    ("https://github.com/jane", ("github", "jane")), ("https://www.github.com/Jane/", ("github", "Jane")),
    ("https://gitlab.com/jane?tab=x", ("gitlab", "jane")), ("https://github.com/o/r", None),
    ("https://github.com/sponsors", None), ("https://example.org/jane", None),
    ("https://codeberg.org/x.git", None)])
def test_profile_of(one, url, got):
    v = one(urls.profile_of, url)
    assert (v and (v["forge"], v["login"])) == got


def test_readme_links_and_guesses(one):
    t = "see github.com/a/b. and https://github.com/topics/x and (github.com/c/d/issues)"
    assert one(urls.readme_repo_links, t) == ["a/b", "c/d"]
    assert one(urls.package_name_guesses, "o/My_Pkg") == ["My_Pkg", "my_pkg", "my-pkg"]
    assert one(urls.extract_urls, "x (https://a.b/c) 'http://d.e'") == ["https://a.b/c", "http://d.e"]


def test_page_text_and_handles(one):
    html = '<p>Ronja&nbsp;Weberson &amp; <a href="https://GitHub.com/Ronja">x</a>&#233;&#x1F600;&lt;</p>'
    assert one(markup.page_text, html) == " ronja weberson & x é\U0001F600< "
    assert one(markup.page_handles, html) == ["ronja"]


def test_infobox_authors(one):
    t = ("{{Infobox software\n| name = X\n| author = [[Travis Oliphant]], [[A|Ronja Weberson]]<br/>"
         "Eric Jones<ref name=a>z, y</ref> and The Community Project\n| genre = y\n}}")
    assert one(markup.infobox_authors, t) == ["Travis Oliphant", "Ronja Weberson", "Eric Jones"]
    assert one(markup.infobox_authors, "no box") == []


def test_prose_founders(one):
    t = "'''X''' was originally started by [[Travis Oliphant]] in 2012. Jane Q. Roe created it, the Core Team built it."
    assert one(markup.prose_founders, t) == ["Travis Oliphant", "Jane Q. Roe"]


CODEOWNERS = """# Sparse Tensors
/aten/sparse/ @ronja @org/sparse-team
/torch/sparse/ ronja@example.com  # inline
\t
* @lead
# Docs
docs/ # nobody
docs2/ @Doc-Writer
"""


def test_codeowner_rules(one, spark):
    rules = spark.createDataFrame([(CODEOWNERS,)], "t string").select(
        F.inline(doc.codeowner_rules(F.col("t")))).collect()
    assert [(r.pattern, r.owners, r.section) for r in rules] == [
        ("/aten/sparse/", ["@ronja", "@org/sparse-team"], "Sparse Tensors"),
        ("/torch/sparse/", ["ronja@example.com"], "Sparse Tensors"),
        ("*", ["@lead"], None), ("docs2/", ["@Doc-Writer"], "Docs")]
    assert one(lambda t: doc.all_owners(doc.codeowner_rules(t)), "a @x @y\nb @y @z") == ["@x", "@y", "@z"]
    assert one(doc.rule_scope, "*", None) is None
    assert one(doc.rule_scope, "src/", None) == "src/"
    assert one(doc.rule_scope, "src/", "Core") == "Core"
    assert one(doc.owns_ownership_file, "/.github/codeowners")
    assert not one(doc.owns_ownership_file, "/src/")


@pytest.mark.parametrize("owner, kind", [
    ("@jane", "handle"), ("@o/t.x", "team"), ("j@x.org", "email"), ("jane", "unknown")])
def test_owner_kind(one, owner, kind):
    assert one(doc.owner_kind, owner) == kind


def test_owners_lists(one):
    t = "approvers:\n  - alice\n  - '@x'\nreviewers :\n- @bob\napprovers:\n  - carol\n"
    assert one(lambda c: doc.owners_list(c, "approvers"), t) == ["carol"]
    assert one(lambda c: doc.owners_list(c, "reviewers"), t) == ["bob"]
    assert one(lambda c: doc.owners_list(c, "approvers"), "x") == []


@pytest.mark.parametrize("line, want", [
    ("Jane Doe <jane@x.org> (@jane)", ("Jane Doe", "jane@x.org", "jane")),
    ("- Jane Doe @jane", ("Jane Doe", None, "jane")),
    ("* **Jane Doe** jane@x.org", ("Jane Doe", "jane@x.org", None)),
    ("# heading", None), ("=====", None), ("| a | b |", None), ("Word", None), ("", None),
    ("---", None), ("Jane Doe", ("Jane Doe", None, None))])
def test_maintainer_lines(one, line, want):
    p = one(ppl.from_maintainer_line, line)
    assert (p and (p["name"], p["email"], p["handle"])) == want


@pytest.mark.parametrize("s, want", [
    ("Jane Doe <j@x.org> (https://x)", ("Jane Doe", "j@x.org")), ("Jane", ("Jane", None)),
    ("<j@x.org>", (None, "j@x.org")), ("a <b> c", ("a <b> c", None))])
def test_person_string(one, s, want):
    p = one(ppl.from_person_string, s)
    assert (p["name"], p["email"]) == want


def test_zip_names_emails(one):
    got = one(ppl.zip_names_emails, "A B; C D", "a@x")
    assert [(p.name, p.email) for p in got] == [("A B", "a@x"), ("C D", None)]
    assert [(p.name, p.email) for p in one(ppl.zip_names_emails, None, "a@x, b@x")] == [
        (None, "a@x"), (None, "b@x")]
    assert one(ppl.zip_names_emails, None, None) == []


MAIL_HEADER = """Number: 41
Author: Mira Tolland <mira@quarry.example>,
    Osei Lindqvist
Subject: Longer names for short things

    Author: Indented Prose
"""
FIELD_LIST = """Naming of wells
---------------

:Subject: wells
:Author: Pell Oduya <pell@well.example>
"""
FRONT_MATTER = """---
author:
  - Tamsin Groll (@tgroll)
  - 'Ivo Hartz <ivo@hartz.example>'
number: 7
---
author: someone below the line
"""


def authors(one, t, fmt):
    return [(p.name, p.email, p.handle) for p in one(doc.proposal_authors, t, fmt)]


def test_proposal_authors(one):
    assert authors(one, MAIL_HEADER, "rst") == [
        ("Mira Tolland", "mira@quarry.example", None), ("Osei Lindqvist", None, None)]
    assert authors(one, FIELD_LIST, "rst") == [("Pell Oduya", "pell@well.example", None)]
    assert authors(one, FRONT_MATTER, "yaml") == [
        ("Tamsin Groll", None, "tgroll"), ("Ivo Hartz", "ivo@hartz.example", None)]
    assert authors(one, "---\nauthors: [A B, 'C D']\n---\n", "yaml") == [
        ("A B", None, None), ("C D", None, None)]
    assert authors(one, "---\nAuthor: A B; C D\n...\n", "yaml") == [("A B", None, None), ("C D", None, None)]
    assert authors(one, "no header", "rst") == [] and authors(one, "x: y", "yaml") == []
    assert authors(one, "Author:\nAuthors: Z Y\n", "rst") == [("Z Y", None, None)]
    assert authors(one, "Author: A A\nAuthor: B B\n", "rst") == [("B B", None, None)]
    assert authors(one, "\n" * 150 + "Author: A A\n", "rst") == [("A A", None, None)]
    long = "".join(f"Field {i}: x\n" for i in range(200))
    assert authors(one, long + "Author: A A\n\nProse begins here.\n\nAuthor: B B\n", "rst") == [("A A", None, None)]
    assert authors(one, "Number: 1\n\nAuthor: A A\n", "rst") == [("A A", None, None)]


def test_line_windows(one):
    assert one(doc.line_windows, "a\nb\nc\nd") == ["a b c", "b c d", "c d", "d"]


@pytest.mark.parametrize("n, s", [(32000, "32k"), (1500, "2k"), (2500, "2k"), (999, "999")])
def test_human_stars(one, n, s):
    assert one(display.human_stars, n) == s


@pytest.mark.parametrize("n, s", [
    (6835, "~6800"), (2097, "~2100"), (637, "~640"), (251, "~250"), (99, "~99"), (1250, "~1200")])
def test_approx_count(one, n, s):
    assert one(display.approx_count, n) == s


@pytest.mark.parametrize("args, s", [
    ((8, 2097, False, True), " (#8/~2100)"), ((8, 200, True, False), " (#8/200+)"),
    ((8, 53, False, False), " (#8/53)"), ((None, 53, False, False), "")])
def test_contributor_suffix(one, args, s):
    rank = 0 if args[0] is None else args[0]
    got = one(lambda r, n, c, a: display.contributor_suffix(F.nullif(r, F.lit(0)), n, c, a), rank, *args[1:])
    assert got == s


def test_is_maintained(one):
    ok = lambda ts: one(lambda c: roles.is_maintained(c.cast("timestamp"), "2003-08-01 00:00:00"), ts)
    assert ok(None) and ok("2001-08-11 00:00:00") and ok("2001-08-10 12:00:00")
    assert not ok("2001-08-10 00:00:00")


def test_snippet(one):
    assert one(display.snippet, "x" * 61) == "x" * 60 + "…"
    assert one(display.snippet, "x" * 60) == "x" * 60


def test_percent(one):
    assert one(text.percent_decode, "C%2B%2B+x%zz") == "C%2B%2B+x%zz"
    assert one(text.percent_decode, "C%2B%2B+x_%C3%A9") == "C+++x_é"
    assert one(text.percent_encode_path, "A_(b)/é~*") == "A_%28b%29/%C3%A9~%2A"
