"""Which names occur as substrings of which texts, without comparing all pairs.

A substring test is no equi-join, and comparing every name with every text of a
project would emit all pairs of the group.  Instead a name stands for one short gram
that every text containing it must hold, and grams are equi-joined:

* around each blank of a name, up to three characters before and eight after it;
* of a name without blanks, each run of `min_len` characters.

Any of a name's grams would do, so where a name has several their postings in the texts are
counted first, in one hash aggregate, and it takes its rarest; a name with a gram no text holds
is nowhere.  Texts are cut into grams of the lengths that names have (at most 25 kinds), and
grams of texts never leave their stage unless some name wants them: the wanted
ones are a bit table of fixed size, which is what bounds its broadcast.  A posting carries
as many characters around its gram as the longest name has, so a pair is verified where it
meets and the text is not looked up again.  Adaptive execution splits the postings of a
gram that stays frequent.  The result is exact.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import all_matches, let

_SIDE, _AFTER = 3, 8
#: Characters before and after a blank that a gram may have; 0, 0 is a run.
_KINDS = [(0, 0), *((a, b) for a in range(1, _SIDE + 1) for b in range(1, _AFTER + 1))]
#: Bits of the table of wanted grams, as a power of two: 131,072 rows of 64 at most.
_BITS = 23


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, first, n))


def _gram_key(on: list[Column], kind: str, *parts: Column) -> Column:
    return F.xxhash64(*on, F.lit(kind), *parts)


def name_grams(name: Column, min_len: int, on: list[Column]) -> Column:
    """array<struct<key, before, after, a, b>>: each gram of a name, the name around it, and how many
    characters of the gram stand before and after a blank (0, 0: a run)."""
    tagged = lambda key, before, after, a, b: F.struct(
        key.alias("key"), before.alias("before"), after.alias("after"), a.alias("a"), b.alias("b"))

    def at_blank(toks, k):
        before, after = _joined(toks, F.lit(1), k), _joined(toks, k + 1, F.size(toks))
        a, b = F.least(F.length(before), F.lit(_SIDE)), F.least(F.length(after), F.lit(_AFTER))
        return tagged(_gram_key(on, "blank", a, F.right(before, F.lit(_SIDE)), F.left(after, F.lit(_AFTER))),
                      before, after, a, b)

    blanks = let(F.split(name, " "), lambda toks: F.when(
        F.size(toks) > 1, F.transform(F.sequence(F.lit(1), F.size(toks) - 1),
                                      lambda k: at_blank(toks, k))))
    runs = F.transform(all_matches(name, r"(?=([^ ]{%d}))" % min_len), lambda gram, o: tagged(
        _gram_key(on, "run", gram), F.substring(name, F.lit(1), o), F.substring(name, o + 1, F.length(name)),
        F.lit(0), F.lit(0)))
    return F.when(name.contains(" "), blanks).otherwise(runs)


#: Stands before the first character of a text, where a gram wants more of them than there are.
_PAD = "\0"
#: Least number of characters that a window has of its own.
_OWN = 512


def windows(texts: DataFrame, ids: list[str], text: str, margin: int, gram: int) -> DataFrame:
    """(ids, _w, _piece): overlapping windows of each text, whose length does not depend on the text's, with `margin`
    characters before and after those that are the window's own, and the piece that holds the grams (of up to `gram`
    characters) that begin in its own.

    Grams of a text are rows, so what stands beside them has to be short: a text that followed each of its
    grams would be copied as often as it is long.
    """
    own = max(_OWN, margin)
    found = all_matches(F.concat(F.lit(_PAD * margin), F.col(text)), r"(?s)(?=(.{1,%d})).{1,%d}" % (own + 2 * margin, own))
    cut = texts.select(*ids, F.posexplode(found).alias("_i", "_c")).where(F.length("_c") > margin)
    first = F.col("_i") == 0
    w = F.when(first, F.substring("_c", margin + 1, own + margin)).otherwise(F.col("_c"))
    begin = F.when(first, 1).otherwise(margin - _SIDE + 1)
    return cut.select(*ids, w.alias("_w"), begin.alias("_b")).select(
        *ids, "_w", F.substring(F.col("_w"), F.col("_b"), F.lit(own + gram)).alias("_piece"))


def only_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` (a hash) may be a key of `wanted`; all that are, and few others.

    The wanted keys are bits of a table of fixed size, which bounds what is broadcast.
    """
    slot = F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    bits = (wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("_word"))
            .agg(F.bit_or(one).alias("_bits")))
    return (rows.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(bits), "_word")
            .where(F.getbit("_bits", slot.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_word", "_bits"))


def postings(texts: DataFrame, wanted: DataFrame, ids: list[str], text: str, min_len: int,
             on: list[str], reach: int | None = None, kinds: list[tuple[int, int]] = _KINDS,
             edges: tuple[str, str] = (".", ".")) -> DataFrame:
    """(ids, key) of every wanted gram of the texts; with `reach`, distinct and with a `_window` that holds as many
    characters of the text before and after it.  `wanted` has the column key, of these `kinds` (a, b), and characters
    of the classes `edges` before and after its blanks."""
    own = [F.col(c) for c in on]
    at_blank = [k for k in kinds if k != (0, 0)]
    gram = _SIDE + max(min_len, 1 + _AFTER)
    piece = F.col("_piece")
    blanks = all_matches(F.concat(F.lit(_PAD * _SIDE), piece),
                         r"(?s)(?=(.{%d}%s %s.{0,%d}))" % (_SIDE - 1, edges[0], edges[1], _AFTER - 1))
    runs = all_matches(piece, r"(?=([^ ]{%d}))" % min_len)
    grams = F.concat(blanks, runs) if at_blank and (0, 0) in kinds else blanks if at_blank else runs
    # No lambda below: rows of grams are made and dropped in one generated stage.
    g = F.col("_g")
    left, right = F.substring(g, 1, _SIDE), F.substring(g, _SIDE + 2, _AFTER)
    listed = lambda ks: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ks])
    is_run = F.substring(g, _SIDE + 1, 1) != " "
    placed = windows(texts, ids, text, max(reach or 0, gram), gram).select(*ids, "_w", F.explode(grams).alias("_g")).select(
        *ids, "_w", "_g", F.explode(F.when(is_run, listed([(0, 0)])).otherwise(listed(at_blank or [(0, 0)]))).alias("_k"))
    a, b = F.col("_k.a"), F.col("_k.b")
    key = F.when(is_run, _gram_key(own, "run", g)).otherwise(
        _gram_key(own, "blank", a, F.right(left, a), F.left(right, b)))
    keyed = placed.where(F.length(right) >= b).select(*ids, "_w", key.alias("key"))
    found = only_wanted(keyed, wanted)
    return found.select(*ids, "key") if reach is None else found.select(*ids, "key", F.col("_w").alias("_window")).distinct()


def _edge_class(chars: list[str]) -> str:
    """A regular expression of one of the characters; any character where they are many, or a name has none there."""
    few = 0 < len(chars) <= 256 and all(len(c) == 1 for c in chars)
    return "[%s]" % "".join(r"\x{%x}" % ord(c) for c in sorted(chars)) if few else "."


def contains_join(texts: DataFrame, names: DataFrame, ids: list[str], text: str = "text",
                  name: str = "name", on: list[str] | None = None,
                  min_len: int = 6, keep: list[str] | None = None) -> DataFrame:
    """Pairs (ids, name) where the name occurs in the text.

    `ids` identify a text; `on` (columns of both sides, part of the ids) restricts
    which names are looked for in it.  Both sides are expected lower-cased, names
    stripped as well; names shorter than `min_len` never match.  `keep` names further
    columns of the texts to return.
    """
    from ..plans.lineage import cut
    on, keep = on or [], keep or []
    grams = cut(names.where(F.length(name) >= min_len).select(*on, name).distinct()
             .select(*on, name, name_grams(F.col(name), min_len, [F.col(c) for c in on]).alias("_gs"))
             .select(*on, name, F.size("_gs").alias("_of"), F.explode("_gs").alias("_g"))
             .select(*on, name, "_of", "_g.key", "_g.a", "_g.b", F.right("_g.before", F.lit(1)).alias("_l"),
                     F.left("_g.after", F.lit(1)).alias("_r")))
    found_kinds = grams.groupBy("a", "b").agg(F.max("_of").alias("of")).collect()      # 25 at most
    kinds = sorted((r.a, r.b) for r in found_kinds)
    if not kinds:
        return texts.join(names.select(*on, name).where("false"), on).select(*ids, name, *keep) if on else (
            texts.where("false").select(*ids, F.lit(None).cast("string").alias(name), *keep))
    at_blank = F.col("a") + F.col("b") > 0
    # A character of every name's own alphabet at most; blanks beside others never make a row.
    ends = grams.agg(F.max(F.length(name)).alias("longest"), *[F.collect_set(F.when(at_blank, F.col(c))).alias(c)
                                                               for c in ("_l", "_r")]).first()
    edges = _edge_class(ends["_l"]), _edge_class(ends["_r"])
    # A name of two words has one gram and nothing to choose.
    rarest = grams.where("_of = 1").select(*on, name, "key")
    counted = sorted((r.a, r.b) for r in found_kinds if r.of > 1)
    if counted:
        several = grams.where("_of > 1")
        often = (postings(texts, several, ids, text, min_len, on, kinds=counted, edges=edges).groupBy("key")
                 .agg(F.count(F.lit(1)).alias("_n")))
        rarest = rarest.unionByName(
            several.join(often, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
            .groupBy(*on, name).agg(F.min(F.struct("_n", "key")).alias("_g"))
            .where("_g._n > 0").select(*on, name, "_g.key"))
    longest = ends.longest
    rows = texts.select(*dict.fromkeys([*ids, *keep, text]))
    found = postings(rows, rarest, [*ids, *[c for c in keep if c not in ids]], text, min_len, on, longest, kinds, edges)
    return (found.join(rarest, [*on, "key"])
            .where(F.contains("_window", F.col(name)))
            .select(*ids, name, *keep).distinct())
