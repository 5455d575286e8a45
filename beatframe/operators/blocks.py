"""Ordered work inside a key that may hold a third of all rows.

A plan is an ordered list of rows. Most plans are short, but nothing here relies
on it: rows are grouped by ``(key, block)``, a block being ``size`` consecutive
positions, so every task and every array is bounded however long one key is.

* ``halo``          lag and lead: block borders are copied into the neighbour block
* ``prefix``        running sums, maxima, last non-null: block totals are carried over
* ``dense_pos``     0, 1, 2, ... per key from any order column with a coarse bucket
* ``asof``          latest (or next) row of another table in time, by time bucket
* ``ordered_fold``  sequential state: fold inside a block, states handed on between blocks

Positions are dense from 0 within a key (``dense_pos`` makes them so).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 2048


def block_of(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("bigint")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder of the session, or one beside the warehouse where none is set.

    Both are shared by all executors; nothing depends on the kind of master.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return df.checkpoint()


def halo(df: DataFrame, pos: str, back: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Copy the rows next to a block border into the neighbour block.

    Adds ``__blk`` and ``__own``. Windows over ``block_window`` then see up to
    ``back`` earlier and ``ahead`` later rows; ``own_rows`` drops the copies.
    """
    p = F.col(pos)
    blk, inside = block_of(p, size), p % size
    copies = [blk]
    if back:
        copies.append(F.when(inside >= size - back, blk + 1))
    if ahead:
        copies.append(F.when((inside < ahead) & (blk > 0), blk - 1))
    return df.withColumn("__blk", F.explode(F.array_compact(F.array(*copies)))).withColumn(
        "__own", F.col("__blk") == blk
    )


def block_window(keys: Sequence[str], pos: str):
    return Window.partitionBy(*keys, "__blk").orderBy(pos)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__blk")


def prefix(
    df: DataFrame, keys: Sequence[str], pos: str, specs: dict[str, tuple[str, Column]], size: int = BLOCK, ahead: bool = False
) -> DataFrame:
    """Aggregates over all earlier rows of the key (all later rows when ``ahead``).

    ``specs`` maps a new column to ``("sum" | "max" | "last", value)``; "last" is
    the nearest non-null value. The row itself is not included.
    """
    order = F.col(pos).desc() if ahead else F.col(pos).asc()
    base = df.withColumn("__blk", block_of(F.col(pos), size))

    def over(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "max": F.max}[kind](value)

    def total(kind: str, value: Column) -> Column:
        if kind == "last":
            at = F.when(value.isNotNull(), F.col(pos))
            return F.min_by(value, at) if ahead else F.max_by(value, at)
        return over(kind, value)

    inside = Window.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = base.select("*", *[over(k, v).over(inside).alias(f"__in_{n}") for n, (k, v) in specs.items()])
    totals = base.groupBy(*keys, "__blk").agg(*[total(k, v).alias(f"__t_{n}") for n, (k, v) in specs.items()])
    blk = F.col("__blk").desc() if ahead else F.col("__blk").asc()
    across = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__blk", *[over(k, F.col(f"__t_{n}")).over(across).alias(f"__c_{n}") for n, (k, _) in specs.items()]
    )

    def combine(name: str, kind: str) -> Column:
        own, before = F.col(f"__in_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            return F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
        return F.greatest(own, before) if kind == "max" else F.coalesce(own, before)

    joined = here.join(carry, [*keys, "__blk"])
    return joined.select(*df.columns, *[combine(n, k).alias(n) for n, (k, _) in specs.items()])


def dense_pos(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows of a key 0, 1, 2, ... in ``order``.

    ``bucket`` is any coarse value that never falls along the order (a day of a
    timestamp, a thousand of an id); numbering runs per bucket and the counts of
    earlier buckets are added.
    """
    base = df.withColumn("__b", bucket)
    local = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) - 1
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = base.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, "__b", F.coalesce(before, F.lit(0)).alias("__before")
    )
    numbered = base.withColumn("__local", local).join(offsets, [*keys, "__b"])
    return numbered.select(*df.columns, (F.col("__local") + F.col("__before")).cast("bigint").alias(name))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    value: Column,
    name: str,
    bucket: int,
    after: bool = False,
    prefer: Column | None = None,
) -> DataFrame:
    """Add to every left row the ``value`` of the latest right row at or before it.

    ``after`` looks for the earliest right row at or after it instead. Times are
    integers; among right rows of one time the largest ``prefer`` wins. Both sides meet in time buckets of width ``bucket``; a left
    row without a match in its bucket takes the one carried over from the nearest
    bucket that has rows, so no key is processed as a whole.
    """
    sign = -1 if after else 1
    lt, rt = F.col(left_time) * sign, F.col(right_time) * sign
    cell = lambda t: F.floor(t / F.lit(bucket)).cast("bigint")
    whole = F.struct(*[F.col(c) for c in left.columns])
    order = F.struct((value if prefer is None else prefer).alias("o"), value.alias("v"))
    points = right.select(*keys, rt.alias("__t"), F.lit(0).alias("__k"), order.alias("__v"), F.lit(None).cast(
        left.select(whole.alias("x")).schema["x"].dataType).alias("__l"))
    asks = left.select(*keys, lt.alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(
        points.schema["__v"].dataType).alias("__v"), whole.alias("__l"))
    both = points.unionByName(asks).withColumn("__cell", cell(F.col("__t")))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__t", "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__near", F.last("__v", ignorenulls=True).over(inside)).filter("__k = 1")
    tops = both.groupBy(*keys, "__cell").agg(F.max_by("__v", F.when(F.col("__k") == 0, F.struct("__t", "__v"))).alias("__top"))
    across = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "__cell", F.last("__top", ignorenulls=True).over(across).alias("__carry"))
    return found.join(carry, [*keys, "__cell"]).select(
        "__l.*", F.coalesce(F.col("__near"), F.col("__carry"))["v"].alias(name)
    )


Step = Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]


def fold_blocks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: Sequence[str],
    zero: dict[str, tuple[str, object]],
    step: Step,
    out_type: str,
    size: int = BLOCK,
) -> tuple[DataFrame, DataFrame | None]:
    """Sequential pass over the rows of every key, one block at a time.

    ``zero`` maps a state field to ``(type, start value)``. ``step(state, row)``
    returns the changed state fields, a condition and the array of values emitted
    when it holds.

    Returns two tables with the keys, ``__blk``, ``__rows``, the entry state
    ``__entry`` and the emitted array ``__out``: the keys that fit into one block,
    and the longer keys (``None`` when there are none). A longer key starts each
    block from a guessed state; blocks whose true entry state turns out different
    are folded again until no entry state changes, so the result is exact.
    """
    fields = list(zero)

    def start() -> list[Column]:
        return [F.lit(v).cast(t).alias(f) if v is not None else F.lit(None).cast(t).alias(f) for f, (t, v) in zero.items()]

    def fold(emit: bool) -> Column:
        def merge(acc: Column, row: Column) -> Column:
            changed, cond, value = step(acc, row)
            parts = [changed.get(f, acc[f]).cast(zero[f][0]).alias(f) for f in fields]
            if emit:
                grown = F.concat(acc["out"], value.cast(f"array<{out_type}>"))
                parts.append(F.when(cond, grown).otherwise(acc["out"]).alias("out"))
            return F.struct(*parts)

        init = [F.col(f"__entry.{f}").alias(f) for f in fields]
        if emit:
            init.append(F.array().cast(f"array<{out_type}>").alias("out"))
        return F.aggregate("__rows", F.struct(*init), merge)

    packed = F.sort_array(F.collect_list(F.struct(pos, *[c for c in cols if c != pos])))
    grouped = df.withColumn("__blk", block_of(F.col(pos), size)).groupBy(*keys, "__blk").agg(packed.alias("__rows"))
    alone = (F.col("__blk") == 0) & (F.size("__rows") < size)
    many = df.filter(F.col(pos) >= size - 1).limit(1).count() > 0
    short = (grouped.filter(alone) if many else grouped).withColumn("__entry", F.struct(*start()))
    short = short.withColumn("__out", fold(True)["out"])
    if not many:
        return short, None

    long = checkpoint(grouped.filter(~alone))
    blocks = [*keys, "__blk"]

    def solved(todo: DataFrame) -> DataFrame:
        """Entry and exit state of the given blocks."""
        return long.join(todo, blocks).select(*blocks, "__entry", fold(False).alias("__exit"))

    states = checkpoint(solved(long.select(*blocks, F.struct(*start()).alias("__entry"))))
    while True:
        handed = states.select(*keys, (F.col("__blk") + 1).alias("__blk"), F.col("__exit").alias("__new"))
        linked = states.join(handed, blocks, "left").withColumn("__new", F.coalesce("__new", F.struct(*start())))
        stale = linked.filter(~F.col("__new").eqNullSafe(F.col("__entry"))).select(*blocks, F.col("__new").alias("__entry"))
        stale = checkpoint(stale)
        if stale.isEmpty():
            break
        states = checkpoint(states.join(stale, blocks, "left_anti").unionByName(solved(stale)))
    return short, long.join(states.drop("__exit"), blocks).withColumn("__out", fold(True)["out"])


def ordered_fold(df, keys, pos, cols, zero, step, out_type, size: int = BLOCK) -> DataFrame:
    """``fold_blocks`` whose emitted structs become rows: the keys and the struct fields."""
    short, long = fold_blocks(df, keys, pos, cols, zero, step, out_type, size)
    rows = short.select(*keys, F.inline("__out"))
    return rows if long is None else rows.unionByName(long.select(*keys, F.inline("__out")))


def join_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], pos: str, how: str = "inner", size: int = BLOCK) -> DataFrame:
    """Join a table with one row per key to the rows of the keys.

    The small table is first spread over the blocks of every key, so the rows of
    one large key meet it in many tasks.
    """
    base = df.withColumn("__blk", block_of(F.col(pos), size))
    spread = base.select(*keys, "__blk").distinct().join(per_key, list(keys))
    return base.join(spread, [*keys, "__blk"], how).drop("__blk")
