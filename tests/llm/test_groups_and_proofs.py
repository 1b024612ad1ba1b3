"""Centroid clustering, SimHash anchors and the dataset manifest: against brute force, and on odd rows."""

import hashlib
import math
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolecall.llm import anchors, centroids, manifest, queries

from .test_operators import DOCS, ODD, tokens


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# centroid clustering

VECTORS = "vec_id long, embedding array<float>, cluster string"


def brute_clusters(rows, k, rounds, dims, scale=4, seed=2):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    own = [v for _, v in kept[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        best = [min(range(len(own)), key=lambda c: (apart(v, own[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(own)):
                if mine := [v for (_, v), b in zip(kept, best) if b == c]:
                    own[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    out = [(i, b, apart(v, own[b])) for (i, v), b in zip(kept, best)]
    of = lambda c: sum(d for _, b, d in out if b == c)
    return sorted(((i, b, d, of(b), sum(x[2] for x in out), list(own[b])) for i, b, d in out), key=repr)


def clustered(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    out = centroids.cluster(df, centroids.CentroidSettings(k, rounds, dims, 4), "t")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 3) * 2) / 4]) for i in range(120)]  # many ties
    odd = [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 0.0, 0.0]), (205, [0.0, float("-inf"), 0.0]),
           (None, [5.0, 5.0, 5.0]), (None, [-0.1, 0.1, 0.0]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0])]
    for k, rounds in ((1, 2), (6, 4), (40, 1)):
        assert clustered(spark, rows + odd, k, rounds, 3) == brute_clusters(rows + odd, k, rounds, 3)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0])]
    assert clustered(spark, rows, 40, 3, 2) == brute_clusters(rows, 40, 3, 2)
    assert clustered(spark, [(1, None)], 40, 3, 2) == []


def test_the_nearest_of_large_integers_is_exact():
    rng = np.random.default_rng(3)
    points = rng.integers(-centroids.LARGEST, centroids.LARGEST, (9, 64), endpoint=True)
    points[0], points[1] = centroids.LARGEST, -centroids.LARGEST
    points[5] = points[4]
    vectors = np.concatenate([points, rng.integers(-centroids.LARGEST, centroids.LARGEST, (200, 64))])
    exact = [min(range(9), key=lambda c: (sum((int(x) - int(y)) ** 2 for x, y in zip(v, points[c])), c)) for v in vectors]
    assert centroids.nearest(vectors, *centroids.bisectors(points)).tolist() == exact


# SimHash anchors

def brute_print(text, width=3, seed=42):
    w = tokens(text)
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, threshold=2):
    """The smallest id that each row with an id reaches, by rows with the same id too."""
    nodes = [(i, p) for i, p in rows if i is not None]
    label = list(range(len(nodes)))
    for a, b in combinations(range(len(nodes)), 2):
        if (nodes[a][1] ^ nodes[b][1]).bit_count() <= threshold or nodes[a][0] == nodes[b][0]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(nodes, label):
        least[x] = min(i, least.get(x, i))
    return {node: least[x] for node, x in zip(nodes, label)}


def test_anchors_cover_every_near_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        which, cells = anchors.anchors(y, 2)
        visited = set(zip(which.tolist(), cells.tolist()))
        assert len(visited) == len(cells)
        assert all((k, c) in visited for k, c in enumerate(anchors.home(x).tolist()))


def test_fingerprints_match_brute_force(monkeypatch):
    texts = ["", " \t\n", "One", "one two", "A b\x0bC", "Ä é 日本 words Words WORDS", "a b c " * 40, "x" * 3000 + " y z w"]
    own = [anchors.fingerprint(t.encode(), anchors.AnchorSettings()) for t in texts]
    assert own == [brute_print(t) for t in texts]
    monkeypatch.setattr(anchors, "_PIECE", 5)
    assert own == [anchors.fingerprint(t.encode(), anchors.AnchorSettings()) for t in texts]


@pytest.mark.parametrize("block", [4096, 6])
def test_links_join_what_brute_force_joins(spark, block):
    rng = np.random.default_rng(block)
    prints = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)] + [0, 3, 7, 15]
    for _ in range(240):  # chains and dense groups around a few
        x = prints[int(rng.integers(0, 12))] if rng.random() < 0.5 else prints[-1]
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = anchors.links(df, anchors.AnchorSettings(block=block), "t")
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    want = brute_groups(list(zip(signed, prints)))
    got = {p: p for p in signed}
    root = lambda x: x if got[x] == x else root(got[x])
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        got[b] = a
    assert {node[0]: least for node, least in want.items()} == {p: root(p) for p in signed}


def test_near_copies_of_documents(spark, odd, none):
    rows = [(r[0], r[1]) for r in ODD] + [(20, "b"), (21, "b"), (21, "quite another text than that of row 21"), (22, "quite another text than that of row 21"), (None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, print string")
    out = anchors.near_copies(df, name="t")
    assert out.columns == ["doc_id", "print", "component_id"]
    prints = [(i, brute_print(t)) for i, t in rows]
    groups = brute_groups(prints)
    want = sorted(((i, p, None if i is None else groups[i, p]) for i, p in prints), key=repr)
    assert sorted(((r.doc_id, r.print % 2**64, r.component_id) for r in out.collect()), key=repr) == want
    assert anchors.near_copies(none).isEmpty()


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, brute_print(t)) for i, t in docs]
    groups = brute_groups(prints)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op12_simhash_anchors"](spark, sf).collect()}
    assert got == {(i, f"{p:016x}", groups[i, p]) for i, p in prints}
    assert len({c for *_, c in got}) < len(got)


# manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_leaf(row):
    i, text, lang, source, n = row
    return H(*map(field, (i, source, lang, n, text)))


def brute_tree(leaves, arity):
    """The levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[k : k + arity]) for k in range(0, len(x), arity)])
    return levels


def brute_path(levels, pos, arity):
    out = []
    for x in levels[:-1]:
        first = pos // arity * arity
        out.append(("".join(x[first:pos]), "".join(x[pos + 1 : first + arity])))
        pos //= arity
    return out


def brute_manifest(rows, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, sorted_rows = {}, {}
    for s in names:
        sorted_rows[s] = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = brute_tree([brute_leaf(r) for r in sorted_rows[s]], arity)
    over = brute_tree([trees[s][-1][0] for s in names], arity) if names else [[]]
    out = []
    for g, s in enumerate(names):
        for k, r in enumerate(sorted_rows[s]):
            path = brute_path(trees[s], k, arity) + brute_path(over, g, arity)
            after = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                after = (r[0], r[1].replace("\n", ""), *r[2:])
            d = brute_leaf(after)
            for left, right in path:
                d = H(left, d, right)
            root = over[-1][0]
            out.append((r[0], brute_leaf(r), trees[s][-1][0], root, H(*[a + b for a, b in path]), d, d == root))
    return sorted(out, key=repr)


def written(spark, tmp_path, rows, name):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS + ", leaf string, grp string")
    df.write.parquet(str(tmp_path / name / "documents.parquet"))
    return str(tmp_path / name)


def proved(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_manifest_matches_brute_force(spark, tmp_path):
    many = [(i, f"line\n{i}\n" if i % 3 else None, "en", f"s{i % 7 if i % 2 else 0}", i) for i in range(300)]
    cases = {"odd": ODD + [(30, "a\nb", None, None, None), (30, "a\nb", None, None, None), (31, "c\n", "é", "é", 2), (None, None, None, None, None)],
             "many": many, "one": many[:1], "two": many[1:3]}
    for name, rows in cases.items():
        sf = written(spark, tmp_path, rows, name)
        assert proved(queries.QUERIES["op13_dataset_manifest"](spark, sf)) == brute_manifest(rows), name
    assert queries.QUERIES["op13_dataset_manifest"](spark, written(spark, tmp_path, [], "none")).isEmpty()


@pytest.mark.parametrize("arity, every", [(2, 1), (2, 4), (3, 2), (5, 3)])
def test_proofs_of_other_shapes(spark, arity, every):
    rows = [(i, str(i), None, "hot" if i < 90 else f"s{i // 4}", 0) for i in range(130)]
    settings = manifest.ManifestSettings(arity=arity, every=every)
    built = manifest.build(spark.createDataFrame(rows, DOCS), F.col("doc_id"), settings, "t")
    got = manifest.proofs(built, settings, "t").select("item", "leaf", "subroot", F.lit(built.root), manifest.siblings(F.col("path")), manifest.fold(F.col("leaf"), F.col("path")))
    want = sorted((x[:5] + (x[3],) for x in brute_manifest(rows, arity)), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_a_hot_source_is_not_held_by_one_task(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("lang"),
                                      F.lit("hot").alias("source"), F.lit(1).alias("n_chars"))
    built = manifest.build(rows, F.col("doc_id"), name="t")
    sizes = [len(r.kids) for r in built.groups.blocks[0].select("kids").collect()]
    assert max(sizes) == 27 and sum(sizes) == 20_000 and len(built.groups.blocks) == 4
