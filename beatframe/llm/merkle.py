"""Merkle manifest of a dataset by slot pivots: each parent's children stand in fanout columns beside every row below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import cut
from beatframe.llm.ordered import numbered

FANOUT = 3
LEVELS = 6  # levels that one exchange serves: a tile of FANOUT ** LEVELS neighbours is bounded whatever its group


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, `:` and itself; `-` if null. Numbers are written in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row."""
    return digest(*[field(v) for v in values])


def climb(nodes: DataFrame, group: str = "group", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes: group, pos, size, node and others. Adds top (the ancestor of the row `levels` levels up, or the group's root below that),
    and path: for each level that has more than one node, what stands before and after the row's ancestor among its parent's children.

    Rows are dealt by (group, tile) and sorted once; that serves the pivots of all levels. A pivot spreads the children of a parent into
    `fanout` columns by conditional aggregates; all columns together are hashed into the parent, those beside the own slot are the siblings."""
    at = [F.col("pos"), *[F.expr(f"pos div {fanout**k}") for k in range(1, levels + 1)]]
    parents = [f"__p{k}" for k in range(levels, 0, -1)]
    rows = nodes.withColumns({f"__p{k}": at[k] for k in range(1, levels + 1)} | {"__h": F.col("node"), "__m": F.col("size")})
    rows = rows.repartition(group, f"__p{levels}")
    for k in range(1, levels + 1):
        slot = (F.col("pos") if k == 1 else F.col(f"__p{k - 1}")) % fanout
        children = Window.partitionBy(group, *parents[: levels - k + 1])
        rows = rows.select("*", *[F.max(F.when(slot == i, F.col("__h"))).over(children).alias(f"__s{i}") for i in range(fanout)])
        slots = [F.col(f"__s{i}") for i in range(fanout)]
        before = F.concat_ws("", *[F.when(slot > i, s) for i, s in enumerate(slots)])
        after = F.concat_ws("", *[F.when(slot < i, s) for i, s in enumerate(slots)])
        several = F.col("__m") > 1
        rows = rows.withColumns({
            f"__step{k}": F.when(several, F.struct(before.alias("before"), after.alias("after"))),
            "__h": F.when(several, digest(*slots)).otherwise(F.col("__h")),
            "__m": F.expr(f"(__m + {fanout - 1}) div {fanout}"),
        })
        rows = rows.drop(*[f"__s{i}" for i in range(fanout)])
    steps = F.array_compact(F.array(*[f"__step{k}" for k in range(1, levels + 1)]))
    return rows.select(*nodes.columns, F.col("__h").alias("top"), F.col("__m").alias("left"), steps.alias("path"))


def ascend(nodes: DataFrame, group: str, most: int, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of climb, one for each `levels` levels of a tree whose largest group has `most` nodes, and (group, top): the roots of the groups."""
    tile, stages = fanout**levels, []
    while True:
        stages.append(cut(climb(nodes, group, fanout, levels)))
        nodes = stages[-1].where(F.col("pos") % tile == 0).select(group, F.expr(f"pos div {tile}").alias("pos"), F.col("left").alias("size"), F.col("top").alias("node"))
        most = -(-most // tile)
        if most <= 1:
            return stages, nodes.select(group, F.col("node").alias("top"))


def descend(stages: list[DataFrame], group: str, above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The rows of the lowest table with whole paths. above: one row of each group with path (what follows its root) and other columns, which
    every row of the group gets. The highest table has at most a tile of rows for a group, and each join below it a tile for each key."""
    tile = fanout**levels
    more = [c for c in above.columns if c not in (group, "path")]
    up = above.select(F.col(group).alias("__group"), F.lit(0).cast("long").alias("__tile"), F.col("path").alias("__path"), *more)
    for i, rows in reversed([*enumerate(stages)]):
        own = rows.withColumn("__own_tile", F.expr(f"pos div {tile}"))
        joined = own.join(up, own[group].eqNullSafe(up["__group"]) & (own["__own_tile"] == up["__tile"]))
        kept = joined.select(*rows.columns, *more, F.concat("path", "__path").alias("__whole")).withColumn("path", F.col("__whole")).drop("__whole")
        if i:
            up = kept.select(F.col(group).alias("__group"), F.col("pos").alias("__tile"), F.col("path").alias("__path"), *more)
        else:
            return kept
    raise ValueError("no tables")


def most_in_a_group(rows: DataFrame) -> int:
    return rows.agg(F.max("size")).first()[0] or 0


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf leads to along its path of siblings."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step.before, h, step.after), 256))


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step.before, step.after))), 256)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Adds subroot, root and path (array of before and after) to every row of leaves.

    In each group leaves ascend by order (nulls first; ties by leaf, and rows equal in both are the same whatever their place). While a level
    has several nodes, each `fanout` consecutive ones become their digest, a last run of fewer or of one too; what remains is the subroot, a
    lone leaf itself. The subroots, ordered by group (null first, bytewise), become the root in the same way. A null group is a group of its
    own; no rows give no rows. Other columns are carried along under any names but pos, size, node, top, left, path, subroot, root and those
    that begin with two underscores.

    No group meets in one task: positions come from ranges, each exchange serves tiles of bounded size, and no step makes more rows than leaves."""
    placed = numbered(leaves, group, [order, leaf]).withColumn("node", F.col(leaf))
    placed = cut(placed)
    stages, tops = ascend(placed, group, most_in_a_group(placed), fanout)
    subroots = cut(numbered(tops.select(F.lit(0).alias("__all"), F.col(group).alias("__of"), F.col("top").alias("node")), "__all", ["__of", "node"]))
    higher, whole = ascend(subroots, "__all", most_in_a_group(subroots), fanout)
    root = whole.select("__all", F.col("top").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    over = descend(higher, "__all", root, fanout).select(F.col("__of").alias(group), F.col("node").alias("subroot"), "root", "path")
    return descend(stages, group, cut(over), fanout).select(*leaves.columns, "subroot", "root", "path")


def verify(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", tampered: str = "tampered", fanout: int = FANOUT) -> DataFrame:
    """manifest with proof_sha256, folded_root (from the tampered leaf where there is one, along the original siblings) and verified."""
    proved = manifest(leaves, group, order, leaf, fanout)
    folded = proved.select("*", proof_digest().alias("proof_sha256"), fold(F.coalesce(tampered, leaf)).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row; rows whose key's crc32 is even are verified against a
    text without its line feeds. Nulls in any column count as `-`, empty texts as `0:`; a null key is not tampered with. Other columns are left out."""
    whole = leaf_of(*[docs[c] for c in columns])
    bare = leaf_of(*[F.replace(docs[c], F.lit("\n"), F.lit("")) if c == text else docs[c] for c in columns])
    even = F.crc32(docs[key].cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(docs[key].alias("key"), docs[group].alias("group"), whole.alias("leaf"), F.when(even, bare).alias("tampered"))
    out = verify(leaves, "group", "key")
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
