"""A Merkle manifest of a dataset: a persistent tree whose versions copy paths.

Leaves of a group (a language) are numbered in order of id and lie in aligned
blocks of 512, three levels of eight children. A block is one row, so its levels
are computed, and read, in one task; blocks' tops are the leaves of the next,
smaller set of blocks, until each group has one node, and groups' nodes make the
root the same way. A version of the tree with another leaf shares every node that
is not above the leaf: its path, the siblings at each level, is all it needs, and
folding the path copies the ancestors alone. Paths above a block are found from
the root down, one row for each block, and joined to the block's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import bind
from .common import discard, materialise

#: Children of a node; levels inside a block; leaves of a block.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS

_KEYS = ["named", "none"]


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*texts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Of the values in order: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _numbered(rows: DataFrame, groups: list[str], order: list[Column], tag: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the group's order from 0, and ``n``, the group's size.

    Rows are dealt out by ranges of the whole order. A row's number in its sorted
    range is exact, and ranges and groups give one row each to a table of offsets.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*groups, *order, "tie").sortWithinPartitions(*groups, *order, "tie").drop("tie")
    ranged = materialise(ranged.withColumn("mark", F.monotonically_increasing_id()).withColumn("range", F.shiftright("mark", 33)), tag)
    spans = ranged.groupBy(*groups, "range").agg(F.min("mark").alias("low"), F.count(F.lit(1)).alias("rows"))
    one = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("rows").over(one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialise(spans.select(*groups, "range", (before - F.col("low")).alias("shift"), F.sum("rows").over(one).alias("n")), f"{tag}-spans")
    return ranged.join(spans, [*groups, "range"]).withColumn("pos", F.col("mark") + F.col("shift")).drop("mark", "range", "shift")


def _blocks(nodes: DataFrame, extra: list[str], tag: str) -> DataFrame:
    """One row for each aligned block of (named, none, pos, n, digest and ``extra``), with its levels.

    ``levels`` holds the arrays of digests from the nodes up, ``sizes`` how many
    nodes the whole group has at these levels; a level of one node is the last.
    """
    member = F.struct("pos", "digest", *extra)
    rows = nodes.groupBy(*_KEYS, F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def above(level: Column) -> Column:
        last = F.floor((F.size(level) - 1) / FAN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(F.array_join(F.slice(level, k * FAN + 1, FAN), ""), 256))

    sizes = [F.col("n")]
    rows = rows.withColumn("level0", F.col("members.digest"))
    for k in range(LEVELS):
        rows = rows.withColumn(f"level{k + 1}", F.when(sizes[-1] > 1, above(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        sizes.append(F.when(sizes[-1] > 1, F.ceil(sizes[-1] / FAN)).otherwise(sizes[-1]))
    levels = F.array(*[F.col(f"level{k}") for k in range(LEVELS + 1)])
    return materialise(rows.select(*_KEYS, "block", "members", levels.alias("levels"), F.array(*[s.cast("long") for s in sizes]).alias("sizes")), tag)


def _steps(levels: Column, sizes: Column, place: Column) -> Column:
    """The path from ``place`` in a block to the block's top: the siblings left and right of each level."""

    def step(k: int) -> Column:
        def siblings(level: Column) -> Column:
            at = F.shiftright(place, 3 * k)
            first = at - at % FAN
            return F.struct(F.slice(level, first + 1, at - first).alias("left"), F.slice(level, at + 2, first + FAN - 1 - at).alias("right"))

        return F.when(sizes[k] > 1, siblings(levels[k]))

    return F.filter(F.array(*[step(k) for k in range(LEVELS)]), lambda s: s.isNotNull())


def _climb(nodes: DataFrame, largest: int, tag: str, extra: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(named, none, digest) of each group's root, and the blocks of every storey.

    ``largest`` is the size of the largest group; each storey is 512 times smaller.
    """
    storeys = []
    while True:
        blocks = _blocks(nodes, extra if not storeys else [], f"{tag}-{len(storeys)}")
        storeys.append(blocks)
        top = blocks.select(*_KEYS, F.col("block").alias("pos"), F.col("sizes")[LEVELS].alias("n"), F.col("levels")[LEVELS][0].alias("digest"))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return top.select(*_KEYS, "digest"), storeys
        nodes = top


def _descend(storeys: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(named, none, block, path, subroot, root) of the lowest blocks, from the same of the groups' roots."""
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(storeys[1:]):
        joined = blocks.join(paths, [*_KEYS, "block"])
        places = F.sequence(F.lit(0), F.size("members") - 1)
        down = F.transform(places, lambda p: F.struct((F.col("block") * BLOCK + p).alias("block"), F.concat(_steps(F.col("levels"), F.col("sizes"), p), F.col("path")).alias("path")))
        paths = joined.select(*_KEYS, F.explode(down).alias("down"), "subroot", "root").select(*_KEYS, "down.block", "down.path", "subroot", "root")
    return paths


def siblings(path: Column) -> Column:
    """All siblings of a path put together, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), "")


def copied(path: Column, leaf: Column) -> Column:
    """The nodes above ``leaf`` in the version of the tree that holds it at the end of ``path``, the root last."""
    folded = F.aggregate(
        path,
        F.struct(leaf.alias("at"), F.expr("cast(array() as array<string>)").alias("nodes")),
        lambda a, s: bind(F.sha2(F.array_join(F.concat(s["left"], F.array(a["at"]), s["right"]), ""), 256), lambda made: F.struct(made.alias("at"), F.concat(a["nodes"], F.array(made)).alias("nodes"))),
    )
    return folded["nodes"]


def audit(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, path, nodes, verified), one row per document.

    ``leaf`` is the digest of ``columns``; leaves of a group ascend by id (null
    first, then by digest), every eight consecutive nodes make the next level while
    a group has several, and the groups' roots, ordered by name (null first,
    bytewise), make ``root`` likewise. ``path`` has the siblings left and right of
    each level up to the root. Where ``where`` holds, the version of the tree is
    built in which the leaf has the values ``tampered`` gives for its columns, else
    that with the leaf as it is: ``nodes`` are its copied ancestors, the root last
    (none if the leaf is the root), and ``verified`` says if that root is ``root``.

    Rows that repeat another are leaves of their own. Texts of any length are read
    once, into a digest. An empty table gives no rows; further columns are ignored.
    """
    changed = F.lit(None).cast("string")
    if tampered:
        changed = F.when(F.lit(True) if where is None else where, leaf_digest([tampered.get(c, F.col(c)) for c in columns]))
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(group, F.lit("")).alias("named"),
        group.isNull().alias("none"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        changed.alias("changed"),
    )
    numbered = _numbered(leaves, _KEYS, [F.col("id").asc_nulls_first(), F.col("digest")], "leaves")
    sizes = numbered.agg(F.max("n")).first()[0] or 0
    subroots, storeys = _climb(numbered, sizes, "storey", ["id", "changed"])

    order = [(~F.col("of_none")), F.col("of_named")]
    groups = subroots.select(F.lit("").alias("named"), F.lit(False).alias("none"), F.col("named").alias("of_named"), F.col("none").alias("of_none"), "digest")
    groups = _numbered(groups, _KEYS, order, "groups")
    count = groups.agg(F.max("n")).first()[0] or 0
    roots, upper = _climb(groups, count, "upper", ["of_named", "of_none"])
    whole = roots.select(*_KEYS, F.expr("cast(array() as array<struct<left array<string>, right array<string>>>)").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ends = upper[0].join(_descend(upper, whole), [*_KEYS, "block"])
    places = F.sequence(F.lit(0), F.size("members") - 1)
    each = F.transform(places, lambda p: F.struct(F.col("members")[p].alias("of"), F.concat(_steps(F.col("levels"), F.col("sizes"), p), F.col("path")).alias("path")))
    tops = ends.select(F.explode(each).alias("each"), "root").select(F.col("each.of.of_named").alias("named"), F.col("each.of.of_none").alias("none"), "each.path", F.col("each.of.digest").alias("subroot"), "root")

    paths = materialise(_descend(storeys, tops), "paths")
    for blocks in (*storeys[1:], *upper):
        discard(blocks)
    joined = storeys[0].join(paths, [*_KEYS, "block"])
    low = F.transform(
        F.sequence(F.lit(0), F.size("members") - 1),
        lambda p: F.struct(F.col("members")[p].alias("of"), F.concat(_steps(F.col("levels"), F.col("sizes"), p), F.col("path")).alias("path")),
    )
    rows = joined.select(F.explode(low).alias("each"), "subroot", "root").select("each.of.id", F.col("each.of.digest").alias("leaf"), "each.of.changed", "each.path", "subroot", "root")
    now = F.coalesce("changed", "leaf")
    rows = rows.withColumn("nodes", copied(F.col("path"), now))
    return rows.select("id", "leaf", "subroot", "root", "path", "nodes", (F.coalesce(F.try_element_at("nodes", F.lit(-1)), now) == F.col("root")).alias("verified"), now.alias("version_leaf"))
