"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import collections
import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecall.llm import queries

from .test_operators import ODD, DOCS, brute_components, brute_leaks, tokens

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations", "embeddings")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(map(rounded, r)) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op1_') else 'documents'}.parquet")
    key = source.columns[0]
    got = sorted(r[0] for r in df.select(key).collect())
    if not name.startswith("op7_"):
        assert got == sorted(r[0] for r in source.select(key).collect())
    if "held_out" in df.columns:
        folds, left = {"op3": (5, 1), "op6": (4, 2), "op9": (3, 1)}[name[:3]]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left) for r in df.select("doc_id", "held_out").collect())


def found_leaks(docs, items):
    """By brute force, where a document and an item share a shingle at all."""
    def shingles(text):
        w = (text or "").lower().split()
        return set(zip(*[w[k:] for k in range(5)]))

    out = {}
    own = [(item, shingles(item[1])) for item in items]
    for doc in docs:
        mine = shingles(doc[1])
        out |= brute_leaks([doc], [item for item, s in own if s & mine])
    return out


def test_leaks_of_the_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.QUERIES["op7_benchmark_leaks"](spark, SF).collect()}
    assert got == found_leaks(docs, items)


def test_pipeline_stages_decide_as_defined(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([r for r in ODD if r[0] is not None and r[0] != 5], DOCS).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_copies", "benchmark", "tokens"]
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, function(spark, docs, SF).cache()
        old, new = [tuple(r)[:5] for r in before.collect()], [tuple(r)[:5] for r in docs.collect()]
        assert not collections.Counter(new) - collections.Counter(old)
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "language_id":
            gone = collections.Counter(old) - collections.Counter(new)
            assert {r[0] for r in gone} >= {10_001, 10_002, 10_003, 10_004} and sum(gone.values()) < 0.05 * len(old)
        elif name == "near_copies":
            groups = brute_components([r[:2] for r in old], 5, 4, 5)
            assert sorted(r[0] for r in new) == sorted(set(groups.values()))
        elif name == "benchmark":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {i for i, _ in found_leaks([r[:2] for r in old], items)}
            assert sorted(r[0] for r in new) == sorted(r[0] for r in old if r[0] not in leaked)
        elif name == "tokens":
            assert len(new) == len(old) and docs.filter("not round_trip").isEmpty()


def test_pipeline_runs_on_empty_documents(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_are_judged_by_text_not_by_id(spark):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(5, text(1)), (5, text(2)), (7, text(1)), (None, text(1)), (None, text(3)), (None, text(3)), (3, text(2)), (9, None), (9, None), (8, ""), (8, text(4)), (8, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect())
    assert got == collections.Counter([(5, text(1)), (3, text(2)), (None, text(3)), (9, None), (9, None), (8, ""), (8, text(4))])


def test_a_run_leaves_only_its_results(spark, tmp_path):
    from rolecall.llm import stages
    before = set(os.listdir(stages.shared_folder(spark).removeprefix("file:")))
    out = stages.finished(lambda: stages.stage(spark.range(5), "inner").filter("id > 1"), "outer")
    assert [r.id for r in out.orderBy("id").collect()] == [2, 3, 4]
    assert [x.split("-")[1] for x in set(os.listdir(stages.shared_folder(spark).removeprefix("file:"))) - before] == ["outer"]
