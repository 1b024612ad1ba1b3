"""Benchmark decontamination, in native DataFrame operations: SimHash of item-sized windows, multi-index Hamming
blocks, exact verification by weighted shingles.

Texts and items are words (lower case, split at ASCII white space) and shingles of `width` words (an item of fewer
words is one shingle of its own length). The weight of a shingle is how often it occurs, and the similarity of a
window and an item is the sum of the smaller weights over the sum of the larger ones.

A window of an item's size can only be similar if few of the item's shingle occurrences are missing, so one of any
(missing + 1) must be there: the item's rarest ones are its anchors. There are some more of them than a window of the
full size can miss, so such a window holds several. Every window of a text that holds so many is fingerprinted, at
whichever places they stand, as shingles count without their order; a text shorter than the item is one window with
one anchor or more. Windows with the same shingles are fingerprinted once, however many texts hold them, and meet the
items whose anchors they hold, no others.
Fingerprints are 64-bit SimHashes; cut into radius + 1 blocks, any two of distance `radius` or less agree in a block,
so joining on (size, block) finds all of them. With radius 20 a pair at similarity 0.8 lies within it in more than
99.9 % of cases (binomial, 64 bits at an angle of 0.15 pi), pairs of higher similarity more often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import finished, let, small, stage

_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class ContaminationSettings:
    width: int = 5
    numerator: int = 4
    denominator: int = 5
    radius: int = 20
    broadcast_rows: int = 500_000
    run: int = 64  # starts whose shingles are hashed together


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null and blank ones."""
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def shingles(words_: Column, width: int) -> Column:
    """Hashes of the shingles of `width` words; none for fewer words."""
    return F.when(F.size(words_) >= width, F.transform(
        F.sequence(F.lit(0), F.size(words_) - width), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(width)], F.lit(width)))
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(values: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set where it is set in more than half of them."""
    bits = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda b: F.aggregate(
        values, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int")) * 2 > F.size(values))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")))


def blocks(fingerprint: Column, radius: int) -> Column:
    """array<struct<block, value>>: the fingerprint's bits in radius + 1 blocks of nearly equal width."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences in `a` and `b`."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _items(benchmark: DataFrame, settings: ContaminationSettings) -> DataFrame:
    """(item_id, n, k, grams) of each distinct item with words."""
    sized = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
             .filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(settings.width))))
    grams = F.lit(None).cast("array<bigint>")
    for k in range(1, settings.width + 1):
        grams = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(grams)
    return sized.select("item_id", F.size("w").alias("n"), "k", grams.alias("grams")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, settings: ContaminationSettings = ContaminationSettings(), name: str = "leaks") -> DataFrame:
    """(text_1, text_2, item_id, start, n_words, similarity): for each distinct text of `docs` and item of
    `benchmark` (item_id, text) with a window at the threshold or above, the most similar window (the first of
    equals). text_1 and text_2 hash the text; `text_keys` gives them for a row. Null and blank texts and items match
    nothing; items with a null id count as any other.
    """
    num, den = settings.numerator, settings.denominator
    item = ["n", "k", "i1", "i2"]  # ids may repeat, and one id may have several texts
    items = stage(_items(benchmark, settings).withColumns({"i1": F.xxhash64("grams", F.lit(1)), "i2": F.xxhash64("grams", F.lit(2))}), f"{name}-items")
    single = items.select(*item, F.size("grams").alias("m"), F.posexplode("grams").alias("o", "h")).distinct()
    seen = single.withColumn("holders", F.count("*").over(Window.partitionBy("h", "k")))
    place = F.row_number().over(Window.partitionBy("i1", "i2", "n", "k").orderBy("holders", "h", "o"))
    # a window with as many shingles misses at most m * (den - num) / (den + num); a shorter text m * (den - num) / den
    chosen, missing = (lambda m: F.floor(m * (den - num) / den) + 1), (lambda m: F.floor(m * (den - num) / (den + num)))
    anchors = stage(seen.withColumn("place", place).filter(F.col("place") <= chosen(F.col("m"))).select("h", *item).distinct(), f"{name}-anchors")
    widths = sorted(r.k for r in anchors.select("k").distinct().collect())  # at most `width` of them
    keyed = docs.filter("text is not null").select(*text_keys(), words(F.col("text")).alias("w"))
    parts = [keyed.select("text_1", "text_2", F.size("w").alias("size"), F.lit(k).alias("k"), F.posexplode(shingles(F.col("w"), k)).alias("p", "h"))
             for k in widths]
    if not parts:
        parts = [keyed.filter(F.lit(False)).select("text_1", "text_2", F.size("w").alias("size"), F.lit(0).alias("k"), F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("h"))]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    hits = hits.join(small(anchors, settings.broadcast_rows), ["h", "k"])
    hits = stage(hits.select("text_1", "text_2", "size", *item, "p").distinct(), f"{name}-hits")

    # windows with hits i to i + least - 1, but without hit i - 1, start after hit i - 1 and at hit i at the latest
    m, last = F.col("n") - F.col("k") + 1, F.greatest(F.col("size") - F.col("n"), F.lit(0))
    least = F.when(F.col("size") < F.col("n"), 1).otherwise(chosen(m) - missing(m)).cast("int")
    begin = F.when(F.col("size") < F.col("n"), F.lit(0)).otherwise(
        F.greatest(F.get("ps", F.col("i") + F.col("least") - 1) - m + 1, F.coalesce(F.get("ps", F.col("i") - 1) + 1, F.lit(0)), F.lit(0)))
    end = F.when(F.col("size") < F.col("n"), F.lit(0)).otherwise(F.least("p", last))
    spots = (hits.groupBy("text_1", "text_2", "size", *item).agg(F.array_sort(F.collect_list("p")).alias("ps"))
             .select("*", least.alias("least"), F.posexplode("ps").alias("i", "p"))
             .filter((F.col("i") + F.col("least") <= F.size("ps")) & ((F.col("size") >= F.col("n")) | (F.col("i") == 0)))
             .select("text_1", "text_2", *item, begin.alias("begin"), end.alias("end")).filter("begin <= end")
             .select("text_1", "text_2", *item, F.explode(F.sequence("begin", "end")).alias("start")))
    runs = stage(spots.groupBy("text_1", "text_2", *item, F.floor(F.col("start") / settings.run).alias("run"))
                 .agg(F.array_sort(F.collect_list("start")).alias("starts")).drop("run"), f"{name}-runs")
    holders = stage(runs.select("text_1", "text_2").distinct(), f"{name}-holders")
    held = (docs.filter("text is not null").select(*text_keys(), "text").join(small(holders, settings.broadcast_rows), ["text_1", "text_2"])
            .dropDuplicates(["text_1", "text_2"]).withColumn("w", words(F.col("text"))))

    def grams_of(w: Column) -> Column:
        grams = F.lit(None).cast("array<bigint>")
        for k in widths:
            grams = F.when(F.col("k") == k, shingles(w, k)).otherwise(grams)
        return grams

    first, final = F.get("starts", F.lit(0)), F.element_at("starts", -1)
    windows = stage(runs.join(held.select("text_1", "text_2", "w"), ["text_1", "text_2"])
                    .select("text_1", "text_2", *item, "starts", first.alias("first"), let(F.slice("w", first + 1, final - first + F.col("n")), grams_of).alias("all"))
                    .select("text_1", "text_2", *item, "first", "all", F.explode("starts").alias("start"))
                    .select("text_1", "text_2", "start", *item, F.slice("all", F.col("start") - F.col("first") + 1, m).alias("grams")).filter(F.size("grams") > 0)
                    .withColumns({"g1": F.xxhash64("grams", F.lit(1)), "g2": F.xxhash64("grams", F.lit(2))}), f"{name}-windows")

    kinds = ["n", "k", "g1", "g2"]
    prints = stage(windows.select(*kinds, "grams").dropDuplicates(kinds).withColumn("print", simhash(F.col("grams"))), f"{name}-prints")
    cut = blocks(F.col("print"), settings.radius), blocks(F.col("item_print"), settings.radius)
    theirs = stage(items.select(*item, "grams").dropDuplicates(item).select(*item, simhash(F.col("grams")).alias("item_print")), f"{name}-item-prints")
    # only windows with anchors of an item meet its blocks
    mine = windows.select(*item, "g1", "g2").distinct().join(prints.select(*kinds, "print"), kinds)
    near = (mine.select(*item, "g1", "g2", "print", F.explode(cut[0]).alias("b")).select(*item, "g1", "g2", "print", "b.block", "b.value")
            .join(theirs.select(*item, "item_print", F.explode(cut[1]).alias("b")).select(*item, "item_print", "b.block", "b.value"), [*item, "block", "value"])
            .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= settings.radius)
            .select(*item, "g1", "g2").distinct())
    shared = shared_weight(F.col("grams"), F.col("item_grams"))
    both = F.size("grams") + F.size("item_grams")
    exact = (near.join(prints.select(*kinds, "grams"), kinds)
             .join(items.select("item_id", *item, F.col("grams").alias("item_grams")), item)
             .select(*kinds, "item_id", both.alias("both"), shared.alias("shared"))
             .filter(F.col("shared") * den >= num * (F.col("both") - F.col("shared")))
             .select(*kinds, "item_id", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity")))
    found = exact.distinct().join(windows.select("text_1", "text_2", "start", *kinds).distinct(), kinds)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n"))
    return (found.groupBy("text_1", "text_2", "item_id").agg(best.alias("best"))
            .select("text_1", "text_2", "item_id", (-F.col("best.before")).alias("start"), F.col("best.n").alias("n_words"), "best.similarity"))


def text_keys() -> list[Column]:
    """Two hashes of the column `text`."""
    return [F.xxhash64("text", F.lit(1)).alias("text_1"), F.xxhash64("text", F.lit(2)).alias("text_2")]


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: ContaminationSettings = ContaminationSettings(), name: str = "leaks") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of every row of `docs` (doc_id, text) that holds an item."""
    found = stage(leaks(docs, benchmark, settings, name), f"{name}-found")
    return (docs.select("doc_id", *text_keys()).join(small(found, settings.broadcast_rows), ["text_1", "text_2"])
            .select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: ContaminationSettings = ContaminationSettings(), name: str = "leaks") -> DataFrame:
    """The rows of `docs` that hold no item of `benchmark`, with all their columns."""
    found = finished(lambda: leaks(docs, benchmark, settings, name).select("text_1", "text_2").distinct(), f"{name}-found")
    keyed = docs.withColumns({"_text_1": F.xxhash64("text", F.lit(1)), "_text_2": F.xxhash64("text", F.lit(2))})
    other = small(found.toDF("_text_1", "_text_2"), settings.broadcast_rows)
    return keyed.join(other, ["_text_1", "_text_2"], "left_anti").select(*docs.columns)
