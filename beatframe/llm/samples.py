"""Bounded samples of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys count as fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def class_counts(labels: DataFrame, key: str, label: str) -> dict[int, int]:
    """Keys of each class, 0 and 1. A key with several labels has the largest; null keys and labels are left out."""
    one = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    return {0: 0, 1: 0} | {int(r.y > 0): r.n for r in one.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    """(key, text, y): at most `limit` labelled documents of each class, those whose hashed key is smallest.

    limit bounds what a classifier is fitted on, so the chosen keys may be broadcast. Of rows that repeat a key the smallest text counts."""
    one = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    one = one.select("k", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64(F.lit("sample"), "k").alias("h"))
    chosen = one.where("y = 1").orderBy("h", "k").limit(limit).union(one.where("y = 0").orderBy("h", "k").limit(limit))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("__text"))
    one_each = rows.join(F.broadcast(chosen.select("k", "y")), "k").groupBy("k", "y").agg(F.min("__text").alias("__text"))
    return one_each.select(F.col("k").alias(key), F.col("__text").alias(text), "y")
