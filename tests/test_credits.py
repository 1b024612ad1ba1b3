"""Labels of parts in credit lines, against the regular expression that defines them."""

import re

from rolecall.operators.accounts import search_accounts
from rolecall.operators.evidence.credits import label_credits

LINES = ["Ann for core, docs", "hardcore work", "core.api and more", "the CORE", r"a \E in the quote", "x-y and z", "ax x x", "f2py (f2py.)", "Ünïcode core", "écore",
         "C++ and c++11", "node.js, not node", "", "core", "a.core", "core.", "two  blanks", "(core)"]
LABELS = ["core", "Core", r"\E", "x-y", "x x", "f2py", "c++", "node.js", "node", "two  blanks", "ünïcode", "(core)", "+", "."]


def test_labels_match_their_definition(spark):
    found = spark.createDataFrame([("r", i, x) for i, x in enumerate(LINES)], "known_repo string, n int, credit string")
    parts = spark.createDataFrame([("r", "author", x, i) for i, x in enumerate(LABELS)] + [("other", "author", "core", 0)],
                                  "known_repo string, role string, label string, pos int")
    got = {(r.credit, r.label) for r in label_credits(found, parts).collect()}
    assert got == {(x, y) for x in LINES for y in LABELS if re.search(rf"(?<![\w.]){re.escape(y.lower())}(?![\w.])", x.lower())}
    assert "regexp_like" not in label_credits(found, parts)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_names_of_two_common_words(spark):
    firsts, lasts = ["john", "mary", "li"], ["smith", "jones", "wu"]
    names = [(f"u{i}", f"{firsts[i % 3]} {'q. ' if i % 5 == 0 else ''}{lasts[i // 3 % 3]}", None) for i in range(300)]
    accounts = spark.createDataFrame(names + [("one", "John", None), ("twice", "john john smith", None)], "login string, name string, bio string")
    asked = ["John Smith", "smith john", "li wu", "nobody smith", "john john", "john q smith"]
    queries = spark.createDataFrame([(x,) for x in asked], "query string")
    words = lambda x: set(re.split(r"[\s.]+", x.lower())) - {""}
    want = {(q, u) for q in asked for u, n, _ in [*names, ("one", "John", None), ("twice", "john john smith", None)] if words(q) <= words(n)}
    assert {(r["query"], r["login"]) for r in search_accounts(queries, accounts).collect()} == want
