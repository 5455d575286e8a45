"""Helpers shared by the operators of this folder: word hashes of whole texts, cut lineage, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_ONE = np.uint64(1)
_BLOCK = 1 << 20  # bytes of text whose positions are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    values = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x51ED2701))
    power = np.ones(_BLOCK + 1, np.uint64)
    np.multiply.accumulate(np.full(_BLOCK, _POWER, np.uint64), out=power[1:])
    inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
    back = np.ones(_BLOCK + 1, np.uint64)
    np.multiply.accumulate(np.full(_BLOCK, inverse, np.uint64), out=back[1:])
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, values[lower], np.stack([power, back]), space


_READY: list = []


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order; words are runs without white space (codes 9 to 13 and 32).

    fold lower-cases A to Z first. Long texts are hashed in blocks cut at white space, so memory stays a small multiple of
    one block, or of the longest word."""
    if not _READY:
        _READY.append(_tables())
    plain, folded, powers, space = _READY[0]
    table = folded if fold else plain
    whole = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + _BLOCK)
        if end < len(whole):
            gaps = np.flatnonzero(space[whole[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a block is hashed by itself
                rest = np.flatnonzero(space[whole[end : end + (1 << 26)]])
                while not len(rest) and end + (1 << 26) < len(whole):
                    end += 1 << 26
                    rest = np.flatnonzero(space[whole[end : end + (1 << 26)]])
                end = end + int(rest[0]) if len(rest) else len(whole)
        out.append(_block_hashes(whole[at:end], table, powers, space))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(part: np.ndarray, table: np.ndarray, powers: np.ndarray, space: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = ~space[part]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(part) > _BLOCK:  # a single word; the same polynomial, block by block
        total, seen = np.uint64(0), _ONE
        for i in range(int(starts[0]), int(ends[0]), _BLOCK):
            x = table[part[i : min(i + _BLOCK, int(ends[0]))]]
            total = total + (x * powers[0, : len(x)]).sum(dtype=np.uint64) * seen
            seen = seen * powers[0, len(x)]
        return mix(np.array([total], np.uint64) + (ends[:1] - starts[:1]).astype(np.uint64) * _STEP)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(table[part] * powers[0, : len(part)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers[1, starts] + (ends - starts).astype(np.uint64) * _STEP)


def letters_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of letters and digits of a UTF-8 text of at most one block: prefix sums of the polynomial, starts and ends.

    A to Z are folded; every byte from 128 on counts as a letter."""
    if not _READY:
        _READY.append(_tables())
    _, folded, powers, _ = _READY[0]
    part = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = _LETTER[part]
    edges = np.flatnonzero(np.diff(inside))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(folded[part] * powers[0, : len(part)], out=sums[1:])
    return sums, edges[::2], edges[1::2]


_LETTER = np.array([b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the spans of one block whose prefix sums letters_of gave; equal spans have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _READY[0][2][1, starts] + (ends - starts + (salt << 32)).astype(np.uint64) * _STEP)


def blocks_of(data: bytes) -> Iterator[bytes]:
    """A text in blocks that hashing tables cover, cut after white space where there is some."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            gap = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = gap + 1 if gap > at else end
        yield data[at:end]
        at = end


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m]
    for i in range(1, n):
        out = out * _POWER + (words[i : i + m] ^ (words[i : i + m] >> np.uint64(29)))
    return mix(out)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty."""
    data = column.cast(pa.large_binary())
    for value in data:
        yield value.as_py() or b""


def trim() -> None:
    """Give memory that a finished piece of work has freed back to the system, so that workers that are kept do not stay as large as their largest task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, one beside the warehouse, which every executor sees."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that pairs reach from each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes of undirected edges: the smallest node that is reachable.

    Large-star and small-star rewiring in turn: every round is a few shuffles of at most as many rows as there are edges,
    the number of rounds grows with the logarithm of the longest path, and no component meets in one task: the star centre of
    a node comes from a min() that combines before the shuffle and is joined back, which adaptive skew joins may split. The rounds end as soon
    as all pairs are stars; stars given need none.
    Nulls link nothing; repeated edges and loops are harmless; no edges give no rows."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    pairs = pairs.where("u <> v")
    while not _stars(pairs):
        both = pairs.union(pairs.select("v", "u"))
        # written out first: a join may split a hot centre only where an exchange, not an aggregate, lies right below it
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down).distinct()
        pairs = cut(small)
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _stars(pairs: DataFrame) -> bool:
    """Whether pairs (u, v), u above v, are stars already: each u has one v, and no v is a u itself."""
    ends = pairs.select("u", F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
    met = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return met.where("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0] == 0
