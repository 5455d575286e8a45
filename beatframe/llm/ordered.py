"""Dense positions in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import cut

ROWS = 500_000  # rows of a range, on average, once there are many
LEAST = 8192  # small tables get no more ranges than rows / LEAST


def ranges_for(rows: int, shuffle_partitions: int) -> int:
    return max(1, -(-rows // ROWS), min(shuffle_partitions, -(-rows // LEAST)))


def numbered(df: DataFrame, group: str, order: list[str], pos: str = "pos", size: str = "size") -> DataFrame:
    """Adds pos (0, 1, 2, ... in each group by `order`, nulls first, strings bytewise) and size (rows of the group).

    Rows are dealt by ranges of (group, order, a number of the written row), so a group that holds a third of all rows, or one row repeated
    as often, is spread over many tasks; a row's place is its place in its range plus the rows of its group in earlier ranges. Only one row
    for each pair of group and range meets in a window. Rows that are equal in `order` stand in any order. A null group is a group; an empty
    table gives an empty one. Columns whose names begin with two underscores are not allowed in df."""
    written = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    spark = df.sparkSession
    count = ranges_for(written.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [group, *order, "__row"]
    dealt = written.repartitionByRange(count, *keys).sortWithinPartitions(*keys).drop("__row")
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)))
    totals = placed.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__in")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    same = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(same.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("__group", "__in", "__first", before.alias("__before"), F.sum("__n").over(same).alias("__size"))
    joined = placed.join(starts, placed[group].eqNullSafe(starts["__group"]) & (placed["__range"] == starts["__in"]))
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(pos), F.col("__size").alias(size))
