"""The tables that the checks make of the driver's."""

import pytest

from rolecall.checks import documents as docs
from rolecall.checks.bindings import Tables
from rolecall.operators.evidence import proposals as pr
from rolecall.operators.postings import index_files
from rolecall.schemas import Inputs


@pytest.fixture
def many_digits(spark, tmp_path):
    """Documents whose ids share their first four digits, in one series; every person is a candidate."""
    ids = [*range(123_400, 123_440)]
    spark.createDataFrame([(i, "words") for i in ids], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(123_400 // 40, "Brand#1")], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(7)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    return Tables(spark, str(tmp_path)), ids


def test_proposals_have_paths_of_their_own(many_digits):
    t, ids = many_digits
    files, entries = docs.proposals(t)
    assert files.select("path").distinct().count() == entries.select("name").distinct().count() == len(ids)
    listed = pr.proposal_dirs(entries).collect()
    assert len(listed) == 1


def test_proposal_headers_name_the_document(many_digits):
    t, ids = many_digits
    got = {(r.d, r.key) for r in docs.proposal_headers(t).where("kind = 'handle'").collect()}
    assert got == {(d, f"s{(d * 11 + 3) % 7}") for d in ids}


def test_authorship_counts_documents_with_equal_digits(many_digits):
    t, ids = many_digits
    people = [(i, "github", f"s{i}") for i in range(7)]
    spark = t.spark
    keys = spark.createDataFrame([(p, f, r.repo, "https://github.com/x", "handle", k) for p, f, k in people
                                  for r in t.part_names.collect()],
                                 "person_id bigint, forge string, repo string, project_url string, kind string, key string")
    files, entries = docs.proposals(t)
    inputs = Inputs.of(spark, files=files, dir_entries=entries)
    found = pr.proposal_authorship(pr.series_docs(inputs), index_files(inputs), keys)
    got = {r.person_id: (r.docs, r.shown) for r in found.select(
        "person_id", "docs", docs.four_digits(found["detail"]).alias("shown")).collect()}
    for p in range(7):
        mine = [d for d in ids if (d * 11 + 3) % 7 == p]
        names = sorted(("1234" if d % 10 == 0 else "1234-x") for d in mine)
        shown = ", ".join(("index.rst" if ext == "rst" else "README.md") if n == "1234" else f"{n}.{ext}"
                          for n in names[:5] for ext in ["md" if (123_400 // 40) % 2 else "rst"])
        assert got[p] == (len(mine), f"author of {len(mine)} proposal(s): {shown}"
                          + (f" (+{len(mine) - 5} more)" if len(mine) > 5 else ""))
