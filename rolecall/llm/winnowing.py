"""Document fingerprints by winnowing, in native column expressions.

Every `gram` consecutive code points are hashed; of every `window` consecutive hashes the least is selected, the
rightmost of equal ones, with its place. Two texts that share a run of at least `gram + window - 1` code points
therefore share a selected hash, and nothing shorter than `gram` ever matches. A text with fewer hashes than a
window selects its least one; a text shorter than `gram` is hashed whole; an empty text selects nothing.

A selected hash and its place travel as one long: 35 bits of hash above 28 bits of the reversed place, so that the
least long is the least hash at the rightmost place. Texts may hold up to 2^28 - 1 code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import let

_PLACE = 28
_LAST = (1 << _PLACE) - 1


@dataclass(frozen=True)
class WinnowSettings:
    gram: int = 12
    window: int = 16


_HASH = ((1 << 35) - 1) << _PLACE


def _packed(value: Column, reversed_place: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit(_HASH)).bitwiseOR(reversed_place)


def _least_of(values: Column, window: int) -> Column:
    """The minimum of every `window` consecutive values: minima of up to four runs that cover a longer one, again."""
    def one_pass(shifts: list[int]):
        return lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - (shifts[-1] + 1)),
                                     lambda i: F.least(*[F.get(v, i + k) if k else F.get(v, i) for k in shifts]))

    done = 1
    while done < window:
        shifts = sorted({min(done * j, window - done) for j in range(4)})
        values = let(values, one_pass(shifts))
        done += shifts[-1]
    return values


def minima(text: Column, offset: Column, settings: WinnowSettings) -> Column:
    """The packed minimum of each window of `text`, with places counted from `offset`.

    With `offset` 0 a text shorter than one window follows the rules for short texts; else it has no window.
    """
    g, w = settings.gram, settings.window
    empty = F.array().cast("array<bigint>")

    def of(t: Column) -> Column:
        grams = F.length(t) - (g - 1)
        reversed_places = F.sequence((F.lit(_LAST - 1) - offset).cast("long"), (F.lit(_LAST) - offset - grams).cast("long"), F.lit(-1).cast("long"))
        hashes = let(F.encode(t, "UTF-32"), lambda b: F.transform(
            reversed_places, lambda p, i: _packed(F.substr(b, i * 4 + 1, F.lit(4 * g)), p)))
        few = (F.when((grams >= 1) & (offset == 0), F.array(F.array_min(hashes)))
               .when((F.length(t) > 0) & (offset == 0), F.array(_packed(F.encode(t, "UTF-32"), F.lit(_LAST - 1).cast("long")))).otherwise(empty))
        return F.when(grams >= w, _least_of(hashes, w)).otherwise(few)

    return let(text, of)


def fingerprint(text: Column, settings: WinnowSettings = WinnowSettings()) -> Column:
    """The selected hashes of a text with their places, packed; a null text counts as empty."""
    return F.array_distinct(minima(F.coalesce(text, F.lit("")), F.lit(0), settings))


def places(packed: Column) -> Column:
    """array<struct<hash, place>> of a fingerprint, places counted from 1."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, _PLACE).alias("hash"),
                                                  (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int").alias("place")))


def hashes(packed: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, _PLACE)))


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes of two arrays of distinct hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        let(shared, lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)).cast("double")))


def digest(packed: Column) -> Column:
    """128 bits of a fingerprint, in hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(packed, F.lit(k))), 16, "0") for k in (1, 2)]))


def _buckets(docs: DataFrame, parts: int) -> tuple[list[list[int]], list[int]]:
    marks = docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [0]
    marks = sorted(set(marks))
    size = max(1, math.isqrt(len(marks)))
    runs = [marks[i : i + size] for i in range(0, len(marks), size)]
    return runs, [r[0] for r in runs]


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """Rows of `docs` (doc_id, text; no null text) beside their successors, and the window that orders them.

    Rows are dealt into buckets of neighbouring ids by approximate quantiles (four buckets for each shuffle
    partition; the marks are all the driver sees). The rows with the least id of a bucket are also sent, as guests,
    to the end of the bucket before it (of the first one: to the last), so one shuffle of the texts is enough.
    A null id comes before all others, equal ids go by text.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")))
    runs, heads = _buckets(docs, max(2, parts))
    key = F.col("key")
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in runs])
    coarse = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in heads]), lambda m: m < key))
    bucket = let(coarse, lambda c: F.when(c == 0, F.lit(0)).otherwise(
        (c - 1) * len(runs[0]) + F.size(F.filter(F.element_at(fine, F.greatest(c, F.lit(1))), lambda m: m < key)))).cast("int")
    placed = docs.withColumn("bucket", bucket)
    least = placed.groupBy("bucket").agg(F.min("key").alias("key"))
    order = Window.orderBy("bucket")  # one row for each bucket
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    # as many rows as buckets, a fixed multiple of the shuffle partitions: that bound allows the broadcast
    guests = F.broadcast(least.select("key", before.alias("guest_of")))
    rows = (placed.join(guests, "key", "left")
            .withColumn("seat", F.explode(F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))
                                          .otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")),
                                                             F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))))))
            .select("doc_id", "key", "text", F.col("seat.bucket").alias("bucket"), F.col("seat.guest").alias("guest")))
    window = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return rows.withColumn("next_text", F.lead("text").over(window)), window


def edits(docs: DataFrame, settings: WinnowSettings = WinnowSettings()) -> DataFrame:
    """For each row of `docs` (doc_id, text) its fingerprint, that of its edited text (the last floor(n/2) code points
    replaced by as many of the next row's first, or all it has) and of the next row.

    (doc_id, n_chars, edited_sha256, packed, edited_packed, next_hashes). The windows that lie whole in the kept
    half are taken over from the text, not worked out again. Null texts count as empty; one row is its own next.
    """
    rows, window = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    kept = n - cut
    inner = F.greatest(kept - (settings.gram + settings.window - 2), F.lit(0))
    rows = rows.withColumns({
        "n": n, "inner": inner, "all": minima(F.col("text"), F.lit(0), settings),
        "edited": F.concat(F.substr("text", F.lit(1), kept), F.coalesce(F.substr("next_text", F.lit(1), cut), F.lit("")))})
    rest = minima(F.substr("edited", F.col("inner") + 1), F.col("inner"), settings)
    rows = rows.select(
        "doc_id", "key", "text", "bucket", "guest", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_distinct("all").alias("packed"),
        F.array_distinct(F.concat(F.slice("all", F.lit(1), F.col("inner")), rest)).alias("edited_packed"))
    return (rows.withColumn("next_hashes", hashes(F.lead("packed").over(window))).filter(~F.col("guest"))
            .select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "packed", "edited_packed", "next_hashes"))
