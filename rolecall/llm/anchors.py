"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: two words of the perfect binary Golay code of length 23, side by side,
over the lower 46 bits. Every 23-bit half lies within distance 3 of exactly one Golay word, so the code covers with
radius 3 + 3, and the two nearest words make a fingerprint's home anchor. When fingerprints differ in at most t bits,
each lies within radius plus threshold of the other's home: within 3 + a in one half and 3 + b in the other, a + b <= t.
So every fingerprint is replicated to all such anchors, and a link is always seen at the home of either end.

Of the two homes at which a linked pair meets, the smaller one decides: a visitor need not go to anchors beyond its own
home. Visits to anchors that are nobody's home are dropped. Per anchor, homes are compared with all members, and links
that join what is not yet joined are reported: a spanning forest, never all pairs. An anchor with very many members is
dealt once more: of six parts of the 64 bits, t differing bits leave 6 - t alike, so members meet in one of the choices
of parts; what is still large is compared in pairs of blocks of bounded size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import components, small, stage, text_batches

_LENGTH, _RADIUS = 23, 3
_GOLAY = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code
_HALF = (1 << _LENGTH) - 1
_PIECE = 1 << 20  # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class AnchorSettings:
    width: int = 3
    seed: int = 42
    threshold: int = 2
    block: int = 4096  # members of one side that are compared in a task
    parts: int = 6
    broadcast_rows: int = 1_000_000


def _pieces(text: bytes):
    """The text in pieces that end at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes, settings: AnchorSettings) -> int:
    """The bits set in over half of the hashes of the word shingles of an UTF-8 text; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    width, tail = settings.width, []

    def count(grams: list[bytes]) -> None:
        nonlocal ones, n
        h = np.array([xxhash.xxh64_intdigest(g, settings.seed) for g in grams], np.uint64)
        ones = ones + np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)

    for piece in _pieces(text):
        words = tail + piece.lower().split()
        tail = words[max(0, len(words) - width + 1) :]
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        count([joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])
    if not n and tail:
        count([b" ".join(tail)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little") if n else 0


def _printed(settings: AnchorSettings):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes(), settings) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])
    return run


def _remainder(word: int) -> int:
    for bit in range(_LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= _GOLAY << (bit - 11)
    return word


@lru_cache
def _code(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the lower and of the upper bits of a word; for each remainder the errors of weight up to `most`
    that explain it, lightest first, and where those of each weight beyond the radius begin."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    single = [_remainder(1 << b) for b in range(_LENGTH)]
    errors: list[list[list[int]]] = [[[] for _ in range(most - _RADIUS + 1)] for _ in range(1 << 11)]
    for weight in range(most + 1):
        for bits in combinations(range(_LENGTH), weight):
            rest = word = 0
            for b in bits:
                rest ^= single[b]
                word |= 1 << b
            errors[rest][max(0, weight - _RADIUS)].append(word)
    classes = most - _RADIUS + 1
    flat = np.array([e for own in errors for part in own for e in part], np.int64)
    edges = np.concatenate([[0], np.cumsum([len(part) for own in errors for part in own])])
    starts = edges[np.arange(1 << 11)[:, None] * classes + np.arange(classes + 1)]
    return low, high, flat, starts


def _errors(half: np.ndarray, most: int):
    low, high, flat, starts = _code(most)
    rest = low[half & 0xFFF] ^ high[half >> 12]
    return flat, starts[rest]


def home(prints: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    out = np.zeros(len(prints), np.int64)
    for shift in (0, _LENGTH):
        half = ((prints >> np.uint64(shift)) & np.uint64(_HALF)).astype(np.int64)
        flat, starts = _errors(half, _RADIUS)
        out |= (half ^ flat[starts[:, 0]]) << shift
    return out


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of every anchor within covering radius plus `threshold`, its home included."""
    halves = [((prints >> np.uint64(s)) & np.uint64(_HALF)).astype(np.int64) for s in (0, _LENGTH)]
    (flat, one), (_, two) = (_errors(h, _RADIUS + threshold) for h in halves)
    which, found = [], []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            n_a, n_b = one[:, a + 1] - one[:, a], two[:, b + 1] - two[:, b]
            n = n_a * n_b
            index = np.repeat(np.arange(len(prints)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = halves[0][index] ^ flat[one[index, a] + k // n_b[index]]
            second = halves[1][index] ^ flat[two[index, b] + k % n_b[index]]
            which.append(index)
            found.append(first | second << _LENGTH)
    return np.concatenate(which), np.concatenate(found)


def _placed(threshold: int, homes_only: bool):
    def run(batches):
        for batch in batches:
            column = batch.column("print").to_numpy()
            for at in range(0, len(column), 4096):
                own = column[at : at + 4096]
                mine = home(own.view(np.uint64))
                if homes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(mine)], ["cell"])
                    continue
                which, cells = anchors(own.view(np.uint64), threshold)
                near = cells <= mine[which]
                which, cells = which[near], cells[near]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(own[which]), pa.array(cells == mine[which])], ["cell", "print", "home"])
    return run


def forest(prints: np.ndarray, homes: np.ndarray, sides: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of one group that join its members as far as links with a home can: of each set of joined members one tree.

    Members of different sides are compared, or all with all where `sides` is negative."""
    label = np.arange(len(prints))
    links = []
    for i in np.flatnonzero(homes):
        near = np.bitwise_count(prints ^ prints[i]) <= threshold
        if sides[i] >= 0:
            near &= sides != sides[i]
        for k in np.flatnonzero(near & (label != label[i])):
            if label[k] != label[i]:
                links.append((int(prints[i].view(np.int64)), int(prints[k].view(np.int64))))
                label[label == label[k]] = label[i]
    return links


def _compared(threshold: int):
    names = ["cell", "low", "high"]

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the group at hand; a block bounds it
        last = None

        def done() -> pa.RecordBatch:
            group = pa.Table.from_batches(held).combine_chunks()
            prints, homes, sides = (group.column(c).to_numpy() for c in ("print", "home", "side"))
            links = forest(prints.view(np.uint64), homes, sides, threshold) if len(prints) > 1 else []
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if held and tuple(keys[a]) != last:
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held:
            yield done()
    return run


def _masks(parts: int, threshold: int) -> list[int]:
    """As signed longs, the bits of every choice of `parts - threshold` of the parts of a fingerprint."""
    edges = [64 * i // parts for i in range(parts + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:])]
    masks = [sum(own[i] for i in choice) for choice in combinations(range(parts), parts - threshold)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, settings: AnchorSettings, name: str) -> DataFrame:
    """(a, b): fingerprints at most `threshold` bits apart of the distinct ones in `prints` (print: long), as many as
    join all that links can join."""
    homes = stage(prints.select("print").mapInArrow(_placed(settings.threshold, True), "cell long").distinct(), f"{name}-homes")
    members = stage(prints.select("print").mapInArrow(_placed(settings.threshold, False), "cell long, print long, home boolean")
                    .join(small(homes, settings.broadcast_rows), "cell", "left_semi"), f"{name}-members")

    def sized(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).filter("n > 1 and any").select("cell", "n")
        return rows.join(small(stage(cells, f"{name}-cells"), settings.broadcast_rows), "cell")

    whole = sized(members)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask")) for i, m in enumerate(_masks(settings.parts, settings.threshold))]))
    finer = stage(whole.filter(F.col("n") > settings.block).withColumn("c", choice)
                  .select(F.xxhash64("cell", "c.i", F.col("print").bitwiseAND(F.col("c.mask"))).alias("cell"), "print", "home"), f"{name}-finer")
    blocks = F.ceil(F.col("n") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("print", F.lit(3)), F.col("blocks")).cast("int")
    side = F.when(F.col("own") == F.col("with"), -1).when(F.col("own") < F.col("with"), 0).otherwise(1)
    groups = ["cell", "low", "high"]
    dealt = (whole.filter(F.col("n") <= settings.block).unionByName(sized(finer))
             .withColumn("blocks", blocks).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), side.alias("side"), "print", "home"))
    return stage(dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_compared(settings.threshold), "a long, b long").distinct(), f"{name}-links")


def near_copies(docs: DataFrame, settings: AnchorSettings = AnchorSettings(), name: str = "anchors") -> DataFrame:
    """(doc_id, print, component_id) of each row of `docs` (doc_id, text); other columns are not looked at.

    Words are runs between ASCII white space with A-Z lower-cased; a text of fewer than `width` words is one shingle;
    null texts and texts without words have the fingerprint 0, which links like any other. component_id is the smallest
    doc_id reachable by links; rows that repeat a doc_id are one node with the links of all of them. Rows with a null
    doc_id get a fingerprint but are not compared (component_id null).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_batches(docs.sparkSession)
    prints = stage(rows.mapInArrow(_printed(settings), "doc_id long, print long"), f"{name}-prints")
    named = prints.filter("doc_id is not null")
    classes = stage(named.groupBy("print").agg(F.min("doc_id").alias("rep")), f"{name}-classes")
    found = links(classes, settings, name)
    # an id with several texts joins their classes
    several = named.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).filter("a <> z").select("doc_id")
    alike = named.join(several, "doc_id").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    ends = (found.join(classes.select(F.col("print").alias("a"), F.col("rep").alias("x")), "a")
            .join(classes.select(F.col("print").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = components(ends.unionByName(alike), f"{name}-all")
    named_classes = stage(classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                          .select("print", F.coalesce("component", "rep").alias("component_id")), f"{name}-named")
    return (prints.join(small(named_classes, settings.broadcast_rows), "print", "left")
            .select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
