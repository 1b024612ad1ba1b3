"""Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Rows are leaves. Each group has a tree over its leaves in order, in which every `arity` consecutive nodes become their
hash; the groups' tops are the leaves of one more tree. Only every `every`-th level is written: its nodes stand in
blocks, one for each aligned subtree of arity^every nodes, beside their places. The levels between are worked out anew
from a block's nodes where they are needed: on the way up to get the subtree's top, and for proofs on the way down to
get the siblings of each node, after which they are gone.

Places in a group come from one sort by ranges: a row's place in its task, and the rows of its group in the tasks
before. So no group is held by one task, however many leaves it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import small, stage

_PLACES = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a task


@dataclass(frozen=True)
class ManifestSettings:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    order: str = "doc_id"
    arity: int = 3
    every: int = 3
    broadcast_rows: int = 1_000_000


@dataclass(frozen=True)
class Tree:
    """`blocks[t]`: (grp, block, height, kids) of the written level t; `top`: (grp, digest), one row a group."""
    blocks: list[DataFrame]
    top: DataFrame


@dataclass(frozen=True)
class Manifest:
    groups: Tree
    over: Tree
    root: str | None


def digest(parts: Column) -> Column:
    """Lowercase hex sha256 of a text."""
    return F.sha2(parts, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[part(c) for c in fields]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda d, p: digest(F.concat(p["left"], d, p["right"])))


def siblings(path: Column) -> Column:
    """The digest of all siblings on a path."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def _above(nodes: Column, arity: int) -> Column:
    """The level above `nodes`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int")),
                       lambda i: digest(F.array_join(F.slice(nodes, i * arity + 1, F.lit(arity)), "")))


def _regenerated(blocks: DataFrame, settings: ManifestSettings, levels: int) -> DataFrame:
    """`blocks` with the digests of their nodes as `l0` and of the levels above as `l1` ...; `steps` says how many of
    them the group's tree has, the others repeat the one before."""
    out = blocks.withColumns({"l0": F.col("kids.digest"), "steps": F.least("height", F.lit(settings.every))})
    for j in range(1, levels):
        out = out.withColumn(f"l{j}", F.when(F.col("steps") >= j, _above(F.col(f"l{j - 1}"), settings.arity)).otherwise(F.col(f"l{j - 1}")))
    return out


def grow(rows: DataFrame, settings: ManifestSettings, name: str) -> Tree:
    """The trees over `rows` (grp, digest, item and the columns by which they are ordered, `o0`, `o1` ...)."""
    order = sorted(c for c in rows.columns if c[0] == "o" and c[1:].isdigit())
    sort = ["grp", *order, "digest", "_tie"]
    # equal rows give the same tree in any order; the tie spreads them over tasks
    placed = stage(rows.withColumn("_tie", F.rand(7)).repartitionByRange(*sort).sortWithinPartitions(*sort)
                   .select("grp", "digest", "item", F.monotonically_increasing_id().alias("at")), f"{name}-sorted")
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_PLACES))
    runs = stage(placed.groupBy("grp", task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), f"{name}-runs")
    before = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("grp").agg(F.sum("n").alias("size"))
    powers = F.array(*[F.lit(settings.arity**i).cast("long") for i in range(64) if settings.arity**i < 1 << 63])
    height = F.size(F.filter(powers, lambda p: p < F.col("size")))
    runs = stage(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sizes, "grp")
                 .select("grp", "task", (F.col("before") - F.col("first")).alias("shift"), height.alias("height")), f"{name}-places")
    nodes = (placed.withColumn("task", task).join(small(runs, settings.broadcast_rows), ["grp", "task"])
             .select("grp", (place + F.col("shift")).alias("pos"), "height", "digest", "item"))
    blocks: list[DataFrame] = []
    span = settings.arity**settings.every
    left = runs.agg(F.max("height")).first()[0] or 0
    while True:
        kid = F.struct("pos", "digest", *(["item"] if not blocks else []))
        block = F.expr(f"pos div {span}")
        blocks.append(stage(nodes.groupBy("grp", block.alias("block"), "height").agg(F.array_sort(F.collect_list(kid)).alias("kids")),
                            f"{name}-level{len(blocks) * settings.every}"))
        tops = _regenerated(blocks[-1], settings, settings.every + 1)
        nodes = tops.select("grp", F.col("block").alias("pos"), F.greatest(F.col("height") - settings.every, F.lit(0)).alias("height"),
                            F.col(f"l{settings.every}")[0].alias("digest"))
        left -= settings.every
        if left <= 0:
            return Tree(blocks, nodes.select("grp", "digest"))


def paths(tree: Tree, above: DataFrame, settings: ManifestSettings, name: str) -> DataFrame:
    """(grp, pos, digest, item, path and the other columns of `above`) of each leaf: the siblings left and right of it,
    level by level, then those of `above` (grp, path, ...), the path of the group's top."""
    extra = [c for c in above.columns if c not in ("grp", "path")]
    up = above.withColumn("pos", F.lit(0).cast("long"))
    for t in reversed(range(len(tree.blocks))):
        rows = tree.blocks[t].join(up.withColumnsRenamed({"pos": "block", "path": "_up"}), ["grp", "block"])
        kept = [f"l{j}" for j in range(settings.every)]
        rows = (_regenerated(rows, settings, settings.every)
                .select("grp", "height", "steps", *kept, "_up", *extra, F.posexplode("kids").alias("i", "kid")))

        def step(j: int) -> Column:
            q = F.expr(f"i div {settings.arity**j}")
            in_run = q % settings.arity
            return F.struct(F.array_join(F.slice(f"l{j}", q - in_run + 1, in_run), "").alias("left"),
                            F.array_join(F.slice(f"l{j}", q + 2, F.lit(settings.arity - 1) - in_run), "").alias("right"))

        own = F.slice(F.array(*[step(j) for j in range(settings.every)]), F.lit(1), F.col("steps"))
        up = rows.select("grp", F.col("kid.pos").alias("pos"), *(["kid.digest", "kid.item"] if t == 0 else []),
                         F.concat(own, "_up").alias("path"), *extra)
        if t:
            up = stage(up, f"{name}-paths{t * settings.every}")
    return up


def build(docs: DataFrame, items: Column, settings: ManifestSettings = ManifestSettings(), name: str = "manifest") -> Manifest:
    """The manifest of `docs`. Leaves are the digests of `settings.fields` and carry `items` beside them.

    Groups stand in the order of their name, null first, bytewise; a null group is a group. Leaves of a group stand in
    the order of `settings.order`, null first, and of their digest where it repeats; equal rows are leaves of their own.
    Columns that are not named do not count. Without rows there is no root (None).
    """
    key = F.col(settings.group).cast("string")
    rows = stage(docs.select(F.when(key.isNull(), "0").otherwise(F.concat(F.lit("1"), key)).alias("grp"), F.col(settings.order).alias("o0"),
                             leaf([F.col(c) for c in settings.fields]).alias("digest"), items.alias("item")), f"{name}-leaves")
    groups = grow(rows, settings, f"{name}-groups")
    over = grow(groups.top.select(F.lit("").alias("grp"), F.col("grp").alias("o0"), "digest", F.col("grp").alias("item")), settings, f"{name}-over")
    top = over.top.first()
    return Manifest(groups, over, top.digest if top else None)


def proofs(manifest: Manifest, settings: ManifestSettings = ManifestSettings(), name: str = "manifest") -> DataFrame:
    """(item, leaf, subroot, path) of every leaf: its path leads over its group's top to the root."""
    spark = manifest.over.top.sparkSession
    start = spark.createDataFrame([("", [])], "grp string, path array<struct<left: string, right: string>>")
    tops = stage(paths(manifest.over, start, settings, f"{name}-over")
                 .select(F.col("item").alias("grp"), F.col("digest").alias("subroot"), "path"), f"{name}-subroots")
    return (paths(manifest.groups, tops, settings, f"{name}-groups")
            .select("item", F.col("digest").alias("leaf"), "subroot", "path"))
