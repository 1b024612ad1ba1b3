"""The index of role files, over several runs."""

from rolecall import Inputs
from rolecall.operators import postings as ps
from rolecall.schemas import INPUT_DDL

FILES = {("a/a", "CODEOWNERS"): "# Core\n/x @ann b@c.d\n", ("fork/a", "CODEOWNERS"): "# Core\n/x @ann b@c.d\n", ("a/a", "docs/AUTHORS"): "Ann Lee\n\nBo\n",
         ("a/a", "OWNERS"): "approvers:\n- ann\n", ("a/a", "conf/who.txt"): "approvers:\n- bo\n", ("a/a", "setup.py"): 'setup(author="Ann Lee")',
         ("a/a", "README.md"): "nobody asks for this"}


def inputs(spark, files):
    table = lambda name, rows: spark.createDataFrame(rows, INPUT_DDL[name])
    return Inputs.of(spark, files=table("files", [("github", r, p, t) for (r, p), t in files.items()]),
                     known=table("known", [("a/a", None, None, None, None, False, None)]),
                     role_conventions=table("role_conventions", [("a/a", 0, "maintainers", None, "conf/who.txt", None)]))


def listed(posted, *parsers):
    return sorted((r.repo, r.path, r.kind, r.key, r.scope) for r in posted.rows(*parsers).collect())


def test_a_content_is_parsed_once(spark, tmp_path, monkeypatch):
    seen = []
    for name, parse in ps.PARSERS.items():
        monkeypatch.setitem(ps.PARSERS, name, lambda f, name=name, parse=parse: seen.append((name, f.count())) or parse(f))
    store = str(tmp_path / "store")
    posted = ps.index_files(inputs(spark, FILES), store=store)
    assert dict(seen) == {"codeowners": 1, "credits": 1, "manifest setup.py": 1, "owners": 3, "words": 2}
    assert listed(posted, "codeowners") == [(r, "CODEOWNERS", k, o, "Core") for r in ("a/a", "fork/a") for k, o in (("email", "b@c.d"), ("handle", "@ann"))]
    assert listed(posted, "owners") == [("a/a", "OWNERS", "handle", "ann", None), ("a/a", "conf/who.txt", "handle", "bo", None)]
    assert [r.text for r in posted.rows("credits").orderBy("line").collect()] == ["Ann Lee", "Bo"]
    assert listed(posted, "manifest setup.py") == [("a/a", "setup.py", "name", "ann lee", None)]

    seen.clear()                                            # nothing new: nothing is parsed
    again = ps.index_files(inputs(spark, FILES), store=store)
    assert not seen and listed(again, "codeowners") == listed(posted, "codeowners")
    changed = FILES | {("fork/a", "CODEOWNERS"): "* @bo\n"}
    assert listed(ps.index_files(inputs(spark, changed), store=store), "codeowners")[-1] == ("fork/a", "CODEOWNERS", "handle", "@bo", None)
    assert seen == [("codeowners", 1), ("owners", 1), ("words", 1)]


def test_a_run_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    with monkeypatch.context() as m:
        m.setitem(ps.PARSERS, "words", lambda f: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            ps.index_files(inputs(spark, FILES), store=store)
        except RuntimeError:
            pass
    (tmp_path / "store" / "posts" / "run=half").mkdir(parents=True)
    assert len(listed(ps.index_files(inputs(spark, FILES), store=store), "words")) > 0


def test_no_files(spark):
    empty = ps.index_files(inputs(spark, {("a/a", "README.md"): "x"}))
    assert empty.rows("codeowners").isEmpty() and ps.Postings.empty(spark).rows("owners").isEmpty()


def test_postings_of_other_keys_are_dropped(spark):
    posted = ps.index_files(inputs(spark, FILES))
    all_ = [r.key for r in posted.rows("words").collect()]
    ann = [r.key for r in posted.naming(spark.createDataFrame([("ann",)], "key string")).rows("words").collect()]
    assert "ann" in ann and ann.count("ann") == all_.count("ann") and len(ann) < len(all_)


def test_only_the_parsers_asked_for_read_a_file(spark):
    """A governance file is also searched for logins: who wants its windows need not pay for its words."""
    files = inputs(spark, {("a/a", "GOVERNANCE.md"): "Steering Council\n- @ann\n", ("a/a", "CODEOWNERS"): "/x @ann\n"})
    every, some = ps.index_files(files), ps.index_files(files, only=["governance"])
    assert {r.parser for r in every.posts.collect()} == {"governance", "words", "codeowners"}
    assert {r.parser for r in some.posts.collect()} == {r.parser for r in some.places.collect()} == {"governance"}
    assert listed(some, "governance") == listed(every, "governance") and listed(some, "governance")
