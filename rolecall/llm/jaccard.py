"""N-gram Jaccard join by PartEnum signatures, exact for every threshold `numerator / denominator`.

Sets of word shingles fall into bands of sizes. In a band, sets within the threshold differ in at most k elements
(the Hamming distance the threshold allows at the band's largest size). The hashed domain is split into rows of
`parts` parts; with more than k / 2 rows, some row differs in at most one element, and there the subset of all
parts but one is equal in both sets. Every such subset of every row gives one signature, so each link shares one.
A set also signs in the next band when a larger set of that band could reach it.

A subset of fewer than `thin` elements says little and is shared by many sets. A set leaves its thin subsets out
when its other rows alone are still more than half of the differences any partner may have: some row without a
thin subset then differs in at most one element, so no link is lost. Spare rows make that the usual case; where it
does not hold, the thin subsets stay.

Equal sets are one class before anything is compared. Within a signature, every class is first compared with the
smallest one (linear in the group); groups that then still span several components are compared in blocks of
bounded size, each block pair in one task, which reports a spanning forest and never all pairs. Tallies of 256 cells
rule out most partners beforehand, so only sets that may link are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import NOT_SPACE, Words, chunks, mix, shingle_sets
from .stages import components, small, stage, text_batches


@dataclass(frozen=True)
class JaccardSettings:
    width: int = 5
    numerator: int = 4
    denominator: int = 5
    parts: int = 3
    band: float = 1.4
    thin: int = 1
    spare: float = 0.08
    block: int = 400_000  # shingles of one side of a block pair
    broadcast_rows: int = 1_000_000


@lru_cache
def bands(settings: JaccardSettings, largest: int) -> tuple[tuple[int, int, int], ...]:
    """(smallest size, largest size, rows) of each band up to that of `largest`; 0 rows: only equal sets link."""
    out, low = [], 1
    while not out or out[-1][1] < largest:
        high = max(low, low * settings.denominator // settings.numerator, int(low * settings.band))
        k = 2 * high * (settings.denominator - settings.numerator) // (settings.denominator + settings.numerator)
        rows = k // 2 + 1
        out.append((low, high, rows + (1 + int(rows * settings.spare) if rows > 4 else 0) if k else 0))
        low = high + 1
    return tuple(out)


def signatures(shingles: np.ndarray, settings: JaccardSettings) -> np.ndarray:
    """The signatures of one set."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    num, den, parts = settings.numerator, settings.denominator, settings.parts
    table = bands(settings, n * den // num + 1)
    own = next(i for i, b in enumerate(table) if b[1] >= n)
    x = np.sort(mix(shingles, 5))
    place, sums = x >> np.uint64(32), np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x, 6))])
    out = []
    for i in (own, own + 1):
        low, high, rows = table[i] if i < len(table) else (n + 1, 0, 0)
        if not rows or n * den < num * low:
            continue
        cells = rows * parts
        edges = np.searchsorted((place * np.uint64(cells)) >> np.uint64(32), np.arange(cells + 1, dtype=np.uint64))
        count = np.diff(edges).reshape(rows, parts)
        total = (sums[edges[1:]] - sums[edges[:-1]]).reshape(rows, parts)
        count = count.sum(axis=1, keepdims=True) - count
        rest = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
        sig = mix(rest + mix(np.arange(cells, dtype=np.uint64) + np.uint64(i << 40), 7).reshape(rows, parts))
        weak = count < settings.thin
        most = min(high, n * den // num)  # of a partner
        differ = (n + most) * (den - num) // (den + num)
        if weak.any() and 2 * (rows - int(weak.any(axis=1).sum())) > differ:
            sig = sig[~weak]
        out.append(sig.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _key(shingles: np.ndarray, salt: int) -> int:
    return int(mix(np.array([mix(shingles, salt).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64), salt)[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, offsets in chunks(batch.column("text")):
        for k, s in enumerate(shingle_sets(Words(data, offsets, NOT_SPACE), width)):
            yield first + k, s


_KEYS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def _keyed(settings: JaccardSettings):
    def run(batches):
        for batch in batches:
            rows = [(len(s), _key(s, 11), _key(s, 12)) if len(s) else (0, None, None) for _, s in _sets(batch, settings.width)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], schema=_KEYS)
    return run


def _signed(settings: JaccardSettings):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sigs, keys = [], []
            for _, s in _sets(batch, settings.width):
                if not len(s) or (key := _key(s, 11)) in seen:
                    continue  # copies within a task sign once: they are one class anyway
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                own = signatures(s, settings)
                sigs.append(own)
                keys.append(np.full(len(own), key, np.int64))
                if sum(map(len, sigs[-64:])) > 400_000 or len(sigs) > 4000:
                    yield _pairs(sigs, keys)
                    sigs, keys = [], []
            if sigs:
                yield _pairs(sigs, keys)
    return run


def _pairs(sigs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "k1"])


def _fetched(settings: JaccardSettings):
    kinds = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("tally", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "k1", "k2"))
            out, values, size = [], [], 0
            for i, s in _sets(batch, settings.width):
                if len(s) and _key(s, 11) == k1[i] and _key(s, 12) == k2[i]:
                    out.append(ids[i])
                    values.append(s.view(np.int64))
                    size += len(s)
                if size > 1_000_000:
                    yield _listed(out, values, kinds)
                    out, values, size = [], [], 0
            if out:
                yield _listed(out, values, kinds)
    return run


def _listed(ids, values, kinds) -> pa.RecordBatch:
    lengths = np.array([len(v) for v in values], np.int64)
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(lengths), pa.array([tally(v) for v in values], pa.binary()),
                                       pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(values)))], schema=kinds)


def tally(shingles: np.ndarray) -> bytes:
    """How many elements fall into each of 256 cells (255 at most): two sets differ in at least as many elements as
    their tallies do, which rules most pairs out before any set is moved."""
    cells = (mix(shingles.view(np.uint64), 9) & np.uint64(255)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=256), 255).astype(np.uint8).tobytes()


def _may_differ(a: np.ndarray, b: np.ndarray, settings: JaccardSettings) -> np.ndarray:
    """In how many elements sets of the sizes `a` and `b` within the threshold may differ."""
    return (a + b) * (settings.denominator - settings.numerator) // (settings.denominator + settings.numerator)


def _tallies(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)


def _plausible(settings: JaccardSettings):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            apart = np.abs(_tallies(batch.column("t_a")) - _tallies(batch.column("t_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= _may_differ(n_a, n_b, settings)))
    return run


def _partnered(settings: JaccardSettings):
    """Of each block pair, the members with a partner of another component whose tally is near enough."""
    names = ["sig", "low", "high", "rep", "comp", "side"]

    def kept(group: pa.Table) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        n, comp, side = (group.column(c).to_numpy() for c in ("n", "comp", "side"))
        t = _tallies(group.column("tally").combine_chunks())
        good = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            other = (comp[i + 1 :] != comp[i]) & ((side[i] < 0) | (side[i + 1 :] != side[i]))
            if good[i] and not (other & ~good[i + 1 :]).any():
                continue
            at = np.flatnonzero(other)
            near = np.abs(t[i + 1 + at] - t[i]).sum(axis=1) <= _may_differ(n[i], n[i + 1 + at], settings)
            good[i + 1 + at[near]] = True
            good[i] |= near.any()
        out = group.select(names).filter(pa.array(good)).to_batches()
        return out[0] if out else None

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the block pair at hand; a block bounds it
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names[:3]], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if held and tuple(keys[a]) != last:
                    if (out := kept(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held and (out := kept(pa.Table.from_batches(held))) is not None:
            yield out
    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (u := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up.setdefault(u, u)
            x = u
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def forest_links(reps: np.ndarray, comps: np.ndarray, side: np.ndarray, values: np.ndarray, places: np.ndarray,
                 settings: JaccardSettings) -> list[tuple[int, int]]:
    """Links that join the sets of one block pair as far as they can be joined (no pair of one component).

    `side` is 0 or 1 for the two blocks, and only sets of different sides are compared; -1: all with all. An
    inverted index counts the overlaps of one set with all others at once.
    """
    m = len(reps)
    size = np.diff(places)
    owner = np.repeat(np.arange(m), size)
    element = np.unique(values, return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    posted, starts = owner[order], np.searchsorted(element[order], np.arange(element.max() + 2 if len(element) else 1))
    forest, links = _Forest(), []
    for a in range(m):
        mine = forest.root(int(comps[a]))
        other = np.array([forest.root(int(c)) != mine for c in comps[a + 1 :]], bool)
        if side[a] >= 0:
            other &= side[a + 1 :] != side[a]
        if not other.any():
            continue
        e = element[places[a] : places[a + 1]]
        begin, length = starts[e], starts[e + 1] - starts[e]
        hits = posted[np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())]
        shared = np.bincount(hits, minlength=m)[a + 1 :]
        good = other & (shared * settings.denominator >= settings.numerator * (size[a] + size[a + 1 :] - shared))
        for b in np.flatnonzero(good) + a + 1:
            if forest.join(int(comps[a]), int(comps[b])):
                links.append((int(reps[a]), int(reps[b])))
    return links


def _blocked(settings: JaccardSettings):
    def run(batches):
        group: list[tuple] = []
        key = None

        def done() -> list[tuple[int, int]]:
            reps = np.array([g[0] for g in group])
            comps = np.array([g[1] for g in group])
            side = np.array([g[2] for g in group])
            places = np.concatenate([[0], np.cumsum([len(g[3]) for g in group])])
            return forest_links(reps, comps, side, np.concatenate([g[3] for g in group]), places, settings)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sig", "low", "high", "rep", "comp", "side")]
            lists = batch.column("shingles")
            places, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            links: list[tuple[int, int]] = []
            for i, (*own, rep, comp, side) in enumerate(zip(*columns)):
                if own != key:
                    if len(group) > 1:
                        links += done()
                    group, key = [], own
                group.append((rep, comp, side, values[places[i] : places[i + 1]].copy()))
            yield _linked(links)
        if len(group) > 1:
            yield _linked(done())
    return run


def _linked(links) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_copies(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), name: str = "jaccard") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs` (doc_id, text).

    Words are runs between ASCII white space with A-Z lower-cased; a text of fewer than `width` words is one
    shingle; null texts and texts without words are empty sets that link with nothing (component_id is their own
    doc_id). component_id is the smallest doc_id reachable by links; rows that repeat a doc_id are one node with
    the links of all of them. Rows with a null doc_id are counted but not compared (component_id null).
    """
    text_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stage(text.mapInArrow(_keyed(settings), "doc_id long, n_shingles long, k1 long, k2 long"), f"{name}-keys")
    classes = stage(keys.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2")
                    .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), f"{name}-classes")
    sig = Window.partitionBy("sig")
    members = stage(text.filter("doc_id is not null and text is not null").select("text")
                    .mapInArrow(_signed(settings), "sig long, k1 long")
                    .select("sig", "k1", F.min("k1").over(sig).alias("leader"), F.max("k1").over(sig).alias("last"))
                    .filter("leader < last").select("sig", "k1", "leader"), f"{name}-members")
    wanted = stage(classes.join(members.select("k1").distinct(), "k1"), f"{name}-wanted")
    sets = stage(text.join(small(wanted.select(F.col("rep").alias("doc_id"), "k1", "k2"), settings.broadcast_rows), "doc_id")
                 .mapInArrow(_fetched(settings), "rep long, n long, tally binary, shingles array<bigint>")
                 .dropDuplicates(["rep", "shingles"]), f"{name}-sets")

    pairs = members.filter("k1 <> leader").select("leader", "k1").distinct()
    to = wanted.select("k1", "rep", "n")
    pairs = (pairs.join(to.toDF("k1", "b", "n_b"), "k1").join(to.toDF("leader", "a", "n_a"), "leader")
             .filter(F.least("n_a", "n_b") * settings.denominator >= F.greatest("n_a", "n_b") * settings.numerator)
             .filter("a <> b").select("a", "b", "n_a", "n_b"))
    tallies = sets.select("rep", "tally")
    pairs = stage(pairs.join(tallies.toDF("b", "t_b"), "b").join(tallies.toDF("a", "t_a"), "a").mapInArrow(_plausible(settings), "a long, b long"),
                  f"{name}-pairs")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    star = stage(pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b")
                 .join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
                 .filter(shared * settings.denominator
                         >= (F.size("s_a") + F.size("s_b") - shared) * settings.numerator)
                 .select("a", "b"), f"{name}-star")
    first = components(star, f"{name}-first")

    left = (members.select("sig", "k1").distinct().join(to, "k1")
            .join(first.withColumnRenamed("node", "rep"), "rep", "left")
            .select("sig", "rep", "n", F.coalesce("component", "rep").alias("comp"))
            .withColumns({"lo": F.min("comp").over(sig), "hi": F.max("comp").over(sig)}).filter("lo < hi"))
    left = stage(left.select("sig", "rep", "n", "comp"), f"{name}-left")
    # of signatures with the same members, one is enough
    alike = (left.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum("rep").alias("s"),
                                     F.sum("n").alias("total"))
             .groupBy("m", "x", "s", "total").agg(F.min("sig").alias("sig")).select("sig", "total"))
    blocks = F.ceil(F.col("total") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    side = F.when(F.col("own") == F.col("with"), -1).when(F.col("own") < F.col("with"), 0).otherwise(1)
    placed = (left.join(alike, "sig").withColumn("blocks", blocks).withColumn("own", own)
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("sig", "rep", "comp", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
                      side.alias("side")))
    groups = ["sig", "low", "high"]
    placed = stage(placed.join(sets.select("rep", "n", "tally"), "rep").repartition(*groups).sortWithinPartitions(*groups, "rep")
                   .mapInArrow(_partnered(settings), "sig long, low int, high int, rep long, comp long, side int"), f"{name}-placed")
    # a set is moved once for its cluster of possible partners, not once for each signature
    linked = placed.select("rep", F.min("rep").over(Window.partitionBy(*groups)).alias("with")).distinct()
    cluster = stage(components(linked.select(F.col("rep").alias("a"), F.col("with").alias("b")), f"{name}-near")
                    .join(placed.select("rep", "comp").distinct().withColumnRenamed("rep", "node"), "node")
                    .join(wanted.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node"), f"{name}-cluster")
    sizes = cluster.groupBy("component").agg(F.sum("n").alias("total"))
    dealt = (cluster.join(sizes, "component").select(F.col("component").alias("sig"), F.col("node").alias("rep"), "comp", blocks.alias("blocks"))
             .withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("sig", "rep", "comp", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), side.alias("side")))
    rest = stage(dealt.join(sets.select("rep", "shingles"), "rep").select(*groups, "rep", "comp", "side", "shingles")
                 .repartition(*groups).sortWithinPartitions(*groups, "rep").mapInArrow(_blocked(settings), "a long, b long"), f"{name}-rest")

    final = components(star.union(rest).distinct(), f"{name}-all")
    return (keys.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
            .join(final.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
