"""Vectors: nearest neighbours by a hash-prefix forest, and near duplicates by small-world graphs per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm.common import components, cut, forest_of, trim

TREES = 48
ROWS = 16_384  # of a shard of the forest, on average
QUERIES = 16_384  # of a block, on average
AUDIT = 48  # queries that an audit holds against brute force, at most
RECALL = 0.96  # that an audit asks for
_INFINITE = float("inf")


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == _INFINITE))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(flat), -1)


class Forest:
    """Sorted arrays of 64-bit hash strings, one per tree; each bit is the side of a random plane through the rows' mean."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 5) -> None:
        self.middle = x.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], 64))
        self.order, self.strings = [], []
        for s in self.hashes(x):
            order = np.argsort(s, kind="stable")
            self.order.append(order)
            self.strings.append(s[order])

    def hashes(self, x: np.ndarray) -> list[np.ndarray]:
        weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        return [(((x - self.middle) @ p) > 0) @ weights for p in self.planes]

    def ranges(self, q: np.ndarray) -> np.ndarray:
        """For each prefix length from 64 to 0, query and tree: the rows of the sorted array that share that prefix."""
        out = np.zeros((65, 2, len(q), len(self.strings)), np.int64)
        for t, s in enumerate(self.hashes(q)):
            for level in range(65):
                mask = np.uint64((1 << 64) - (1 << level)) if level < 64 else np.uint64(0)
                low = s & mask
                out[level, 0, :, t] = np.searchsorted(self.strings[t], low)
                out[level, 1, :, t] = np.searchsorted(self.strings[t], low | ~mask, side="right")
        return out

    def level(self, ranges: np.ndarray, want: int) -> np.ndarray:
        """How far each query ascends in all trees at once: to the longest prefix at which they hold `want` rows together."""
        held = (ranges[:, 1] - ranges[:, 0]).sum(axis=2)
        enough = held >= want
        enough[-1] = True
        return enough.argmax(axis=0)

    def candidates(self, ranges: np.ndarray, i: int, level: int) -> np.ndarray:
        found = [o[a:b] for o, a, b in zip(self.order, ranges[level, 0, i], ranges[level, 1, i], strict=True)]
        seen = np.zeros(len(self.order[0]), bool)
        seen[np.concatenate(found)] = True
        return np.flatnonzero(seen)


def _split(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, x = table.column("id").to_numpy(), _matrix(table.column("v"))
    return ids[~asks], x[~asks], ids[asks], x[asks]


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = TREES, shard_rows: int = ROWS, block_rows: int = QUERIES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, key, score: the k nearest rows found for each query by Euclidean distance in double precision, nearest first, ties to
    the smaller key; a query is not held against rows of its own key.

    Rows are dealt to shards, each with a forest over all its rows, and every block of queries visits every shard; the shards'
    best are merged. How many candidates a query gathers is set by an audit: a bounded sample of queries is also held against all
    rows, and the number doubles until the forests find the share `recall` of their true neighbours. Vectors that are null, empty, zero or hold
    null or non-finite components take no part; only vectors of one length are compared. A repeated query key asks once, with its
    smallest vector; of repeated rows each counts. Fewer than k rows: all. Empty tables give an empty one; other columns are left out."""
    kind = rows.schema[key].dataType
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = cut(asked.groupBy("id").agg(F.min("v").alias("v")))
    n, m = base.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    deal = F.pmod(F.xxhash64(F.lit("shard"), "id", "v"), F.lit(shards)).cast("int")
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    both = lambda asked, blocks: base.select("id", "v", deal.alias("shard"), every("block", blocks), F.lit(False).alias("asks")).unionByName(asked.select("id", "v", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks")).select("id", "v", every("shard", shards), "block", "asks")).withColumn("size", F.size("v"))

    def needed(table: pa.Table) -> pa.Table:
        """For the k nearest of each audited query in this shard: their distance, and how many candidates would have included them."""
        ids, x, asks, q = _split(table)
        out: list[tuple] = []
        if len(ids) and len(asks):
            forest = Forest(x, trees)
            ranges = forest.ranges(q)
            held = (ranges[:, 1] - ranges[:, 0]).sum(axis=2)
            place = np.empty((trees, len(ids)), np.int64)
            for t, o in enumerate(forest.order):
                place[t, o] = np.arange(len(ids))
            for i in range(len(asks)):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                d[ids == asks[i]] = np.inf
                for j in np.lexsort((ids, d))[:k]:
                    if np.isfinite(d[j]):
                        inside = ((ranges[:, 0, i] <= place[:, j]) & (place[:, j] < ranges[:, 1, i])).any(axis=1)
                        level = int(inside.argmax())
                        out.append((int(asks[i]), float(d[j]), int(ids[j]), int(held[level - 1, i]) + 1 if level else 1))
        return pa.table({c: pa.array([r[p] for r in out], t) for p, (c, t) in enumerate((("query", pa.int64()), ("d", pa.float64()), ("id", pa.int64()), ("want", pa.int64())))})

    sample = asked.orderBy(F.xxhash64("id"), "id").limit(AUDIT)
    tried = both(sample, 1).groupBy("size", "shard", "block").applyInArrow(needed, "query long, d double, id long, want long")
    place = F.row_number().over(_by("query", "d", "id"))
    found = tried.withColumn("place", place).where(F.col("place") <= k).groupBy(F.ceil(F.log2(F.col("want").cast("double"))).alias("power")).agg(F.count("*").alias("n")).orderBy("power").collect()
    total, so_far, want = sum(r.n for r in found), 0, 1
    for r in found:
        so_far, want = so_far + r.n, 2 ** int(r.power)
        if so_far >= recall * total:
            break

    def search(table: pa.Table) -> pa.Table:
        ids, x, asks, q = _split(table)
        out: list[list] = [[], [], []]
        if len(ids) and len(asks):
            forest = Forest(x, trees)
            for a in range(0, len(asks), 256):
                ranges = forest.ranges(q[a : a + 256])
                levels = forest.level(ranges, want)
                for i, level in enumerate(levels):
                    at = forest.candidates(ranges, i, level)
                    at = at[ids[at] != asks[a + i]]
                    d = np.sqrt(((x[at] - q[a + i]) ** 2).sum(axis=1))
                    if len(at) > 4 * k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[near], d[near]
                    top = np.lexsort((ids[at], d))[:k]
                    out[0].append(np.full(len(top), asks[a + i]))
                    out[1].append(d[top])
                    out[2].append(ids[at[top]])
        whole = lambda p, t: pa.array(np.concatenate(out[p]) if out[p] else [], t)
        return pa.table({"query_id": whole(0, pa.int64()), "score": whole(1, pa.float64()), "id": whole(2, pa.int64())})

    made = both(asked, blocks).groupBy("size", "shard", "block").applyInArrow(search, "query_id long, score double, id long")
    ranked = made.withColumn("rank", F.row_number().over(_by("query_id", "score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").cast(kind).alias(key), "score")


def _by(of: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(of).orderBy(*order)


# ---------------------------------------------------------------------------------------------------------------- small worlds

SHARDS = 4  # at least
SHARD_ROWS = 65_536  # of a shard, on average
BLOCK_ROWS = 32_768  # queries of a block, on average
DEGREE = 16  # links of a node in the upper layers; twice as many in the lowest
BUILD_BEAM = 48
BEAM = 32  # to begin with
AUDIT_QUERIES = 4096  # random queries of all blocks that the audit of links begins with; four times as many until enough links are seen
AUDIT_MOST = 65_536  # queries at which it stops; what it lacks then is made up of planted copies
LINKS = 400  # links of queries with few of them that the audit asks for
_FEW = 4  # links from which on a query does not count as one with few
_WIDEST = 512  # beam after which a query is held against its whole shard instead
_LAST = 4096  # beam after which all queries are
_CELLS = 1 << 22  # cosines of a block product
_TRIALS = 1 << 20  # cosines of candidates for links that are compared at once
_SPAN = 4  # blocks that a shard's graph is sent for at once, where there are groups enough for all cores
_PAIRS = 1 << 16  # pairs whose vectors are copied at once
_ROWS = 1 << 13  # vectors that become doubles at once
_TOGETHER = 512  # queries that walk in step
_STEP = 4  # nodes that each of them opens at a time


@dataclass
class Layer:
    nodes: np.ndarray  # positions of its vectors
    links: np.ndarray  # numbers within the layer, -1 where there is none


def walk(x: np.ndarray, layer: Layer, q: np.ndarray, start: np.ndarray, beam: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries in step over one layer: numbers and cosines of the `beam` best nodes met, best first (-1 where there
    are fewer). start: numbers where each query begins. upto: the layer's nodes that are in place already."""
    n = len(layer.nodes) if upto is None else upto
    beam = min(beam, n)
    rows = np.arange(len(q))[:, None]
    seen = np.zeros(len(q) * n, bool)  # by query, then node
    best = np.full((len(q), beam), -1, np.int32)
    cos = np.full((len(q), beam), -np.inf, np.float32)
    opened = np.ones((len(q), beam), bool)
    fresh = start.astype(np.int32)
    live = np.arange(len(q))
    nodes = None if len(layer.nodes) == len(x) else layer.nodes  # the lowest layer has all
    while len(live):
        fresh = np.sort(fresh, axis=1)
        new = fresh >= 0
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        cell = np.maximum(fresh, 0) + live[:, None] * n
        new &= ~seen.take(cell)
        at = np.flatnonzero(new)
        seen[cell.take(at)] = True
        ids = fresh.take(at)
        value = np.full(fresh.size, -np.inf, np.float32)
        value[at] = np.einsum("ij,ij->i", x.take(ids if nodes is None else nodes.take(ids), axis=0), q.take(live.take(at // fresh.shape[1]), axis=0))
        every = len(live) == len(q)  # nothing is copied out and back then
        was = (best, cos, opened) if every else (best[live], cos[live], opened[live])
        all_ids = np.concatenate([was[0], np.where(new, fresh, -1)], axis=1)
        all_cos = np.concatenate([was[1], value.reshape(fresh.shape)], axis=1)
        all_open = np.concatenate([was[2], ~new], axis=1)
        width = all_cos.shape[1]
        keep = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam] if width > beam else np.tile(np.arange(width), (len(live), 1))
        keep += (np.arange(len(live)) * width)[:, None]
        mine, near, done = all_ids.take(keep), all_cos.take(keep), all_open.take(keep)
        waiting = np.where(done, -np.inf, near)
        pick = np.argpartition(-waiting, min(_STEP, beam) - 1, axis=1)[:, :_STEP] if beam > _STEP else np.tile(np.arange(beam), (len(live), 1))
        chosen = np.where(np.take_along_axis(waiting, pick, 1) > -np.inf, np.take_along_axis(mine, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        if every:
            best, cos, opened = mine, near, done
        else:
            best[live], cos[live], opened[live] = mine, near, done
        go = (chosen >= 0).any(axis=1)
        live, chosen = live[go], chosen[go]
        fresh = np.where(chosen[:, :, None] >= 0, layer.links.take(np.maximum(chosen, 0), axis=0), -1).reshape(len(live), chosen.shape[1] * layer.links.shape[1]).astype(np.int32, copy=False)
    order = np.argsort(-cos, axis=1, kind="stable")
    return best[rows, order], cos[rows, order]


def _diverse(x: np.ndarray, of: np.ndarray, ids: np.ndarray, degree: int) -> np.ndarray:
    """For each node up to `degree` of its candidates (nearest first, -1 for none): those nearer to it than to any taken before, then the
    rest. A bounded number of nodes at once."""
    out = np.full((len(of), degree), -1)
    width = ids.shape[1]
    step = max(1, _TRIALS // max(1, width * max(width, x.shape[1])))
    for s in range(0, len(of), step):
        mine, node = ids[s : s + step], of[s : s + step]
        ok = (mine >= 0) & (mine != node[:, None])
        v = x[np.maximum(mine, 0)]
        to_node, between = (v @ x[node][:, :, None])[:, :, 0], v @ v.transpose(0, 2, 1)
        taken, free, count = np.zeros(mine.shape, bool), ok.copy(), np.zeros(len(mine), np.int64)
        for j in range(width):
            take = free[:, j] & (count < degree)
            if not take.any():
                if (count >= degree).all():
                    break
                continue
            taken[:, j] = take
            count += take
            free &= ~take[:, None] | (between[:, j] <= to_node)
        kind = np.where(taken, 0, np.where(ok, 1, 2))
        order = np.argsort(kind, axis=1, kind="stable")[:, :degree]
        out[s : s + step, : order.shape[1]] = np.where(np.take_along_axis(kind, order, 1) < 2, np.take_along_axis(mine, order, 1), -1)
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, degree: int) -> Layer:
    """One layer, grown in batches: new nodes are linked with what a beam search finds among those in place and with each other."""
    own = x[nodes]
    n = len(nodes)
    layer = Layer(nodes, np.full((n, degree), -1))
    done = 0
    while done < n:
        upto = min(n, max(512, done + min(done // 2, 2048)))
        new = np.arange(done, upto)
        near = own[new] @ own[new].T
        near[np.arange(len(new)), np.arange(len(new))] = -np.inf
        c = min(BUILD_BEAM, len(new) - 1)
        ids, cos = [], []
        if c:
            top = np.argpartition(-near, c - 1, axis=1)[:, :c]
            ids.append(new[top])
            cos.append(np.take_along_axis(near, top, 1))
        if done:
            found = [walk(own, Layer(np.arange(n), layer.links), own[new[a : a + _TOGETHER]], np.tile(np.arange(0, done, max(1, done // 8))[None, :8], (len(new[a : a + _TOGETHER]), 1)), BUILD_BEAM, done) for a in range(0, len(new), _TOGETHER)]
            ids.append(np.concatenate([f[0] for f in found]))
            cos.append(np.concatenate([f[1] for f in found]))
        if ids:
            ids_all, cos_all = np.concatenate(ids, axis=1), np.concatenate(cos, axis=1)
            order = np.argsort(-cos_all, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = _diverse(own, new, np.take_along_axis(ids_all, order, 1), degree)
            layer.links[new] = chosen
            back_to, back = chosen.ravel(), np.repeat(new, degree)
            ok = back_to >= 0
            _link_back(own, layer, back_to[ok], back[ok], degree)
        done = upto
    return layer


def _link_back(x: np.ndarray, layer: Layer, to: np.ndarray, other: np.ndarray, degree: int) -> None:
    """Adds links from `to` to `other`; a node that then has too many keeps diverse ones, of the nearest first."""
    n = len(layer.links)
    nodes = np.unique(to)
    i, j = np.nonzero(layer.links[nodes] >= 0)
    node, mine = np.divmod(np.unique(np.concatenate([nodes[i] * n + layer.links[nodes[i], j], to * n + other])), n)
    cos = np.concatenate([np.einsum("ij,ij->i", x[node[s : s + _PAIRS]], x[mine[s : s + _PAIRS]]) for s in range(0, len(node), _PAIRS)] or [np.zeros(0, x.dtype)])
    mine = mine[np.lexsort((-cos, node))]
    counts = np.bincount(np.searchsorted(nodes, node), minlength=len(nodes))
    starts = np.cumsum(counts) - counts
    low, high = 0, degree
    while low < counts.max(initial=0):
        some = np.flatnonzero((low < counts) & (counts <= high))
        if len(some):  # of up to twice as many candidates, so that little is padded
            step = max(1, _CELLS // high)
            for s in range(0, len(some), step):
                part = some[s : s + step]
                place = np.arange(counts[part].max())[None, :]
                ids = np.where(place < counts[part, None], mine[np.minimum(starts[part, None] + place, len(mine) - 1)], -1)
                kept = ids if high == degree else _diverse(x, nodes[part], ids, degree)
                layer.links[nodes[part], : kept.shape[1]] = kept
                layer.links[nodes[part], kept.shape[1] :] = -1
        low, high = high, 2 * high


class SmallWorld:
    """Layers of ever fewer nodes over unit vectors; a search goes down from the top."""

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        height = np.floor(-np.log(np.random.default_rng(seed).random(len(x)).clip(1e-12)) / np.log(DEGREE)).astype(int)
        self.layers = []
        for level in range(int(height.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(height >= level)
            self.layers.append(_layer(self.x, nodes, DEGREE if level else 2 * DEGREE))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the nodes found, best first."""
        at = np.zeros((len(q), 1), np.int64)  # the first node of the top layer
        top = self.layers[0].nodes[0]
        at[:] = top
        for i, layer in enumerate(self.layers):
            lowest = i == len(self.layers) - 1
            start = np.searchsorted(layer.nodes, at)
            found, cos = walk(self.x, layer, q, start, beam if lowest else 4)
            at = np.where(found >= 0, layer.nodes[np.maximum(found, 0)], top)
        return np.where(found >= 0, at, -1), cos


def _flat(world: SmallWorld, n: int) -> tuple[pa.Array, pa.Array]:
    """Each node's place, and its links in all its layers from the lowest up."""
    heights = np.zeros(n, np.int64)
    for layer in world.layers:
        heights[layer.nodes] += 1
    ends = np.concatenate([[0], np.cumsum((heights + 1) * DEGREE)])
    flat = np.empty(ends[-1], np.int32)
    for level, layer in enumerate(reversed(world.layers)):
        own = np.arange(layer.links.shape[1]) + (level + 1) * DEGREE * (level > 0)
        flat[ends[layer.nodes, None] + own] = layer.links
    return pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _layers(links: pa.ListArray) -> list[Layer]:
    """The layers that _flat has taken apart, from links by place."""
    links = pa.concat_arrays(links.chunks) if isinstance(links, pa.ChunkedArray) else links
    ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
    heights, flat, out = np.diff(ends) // DEGREE - 1, links.flatten().to_numpy(), []
    for level in range(int(heights.max(initial=1))):
        nodes = np.flatnonzero(heights > level)
        own = np.arange(DEGREE if level else 2 * DEGREE) + (level + 1) * DEGREE * (level > 0)
        out.append(Layer(nodes, flat[ends[nodes, None] + own]))
    return out[::-1]


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, recall: float = RECALL) -> DataFrame:
    """key, n_links, component_id and kept of each row: links are pairs with a cosine of at least `least` in double precision.

    Equal vectors become one node with a weight. Each shard of nodes gets a small-world graph; every block of nodes searches every shard,
    a query widens its beam until the beam holds something below `least`, and one with more than _WIDEST links is held against the whole shard.
    The beam to begin with is one for all: random queries of all blocks, whether or not anything was found for them, are held against all
    rows, more of them until LINKS links of queries with fewer than _FEW in a shard are seen (at AUDIT_MOST queries planted copies of
    random rows stand in for links still lacking), and the beam doubles until the share `recall` is found of the links of few-linked and of
    each kind of more-linked queries. Each chunk of queries adds to link counts and to one spanning forest per block and shard; no list of
    pairs is kept. The union of forests gives the components. Graphs are kept and sent as one row for each node, and a graph that has been
    put together serves up to _SPAN blocks, one after the other. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; only vectors of one length are compared. Rows with a null key have a null component, are linked with
    nothing and are not kept; rows that repeat a key count as one node per vector. An empty table gives an empty one; other columns are left out."""
    kind, element = rows.schema[key].dataType, getattr(rows.schema[vector].dataType, "elementType", None)
    number = "float" if isinstance(element, T.FloatType) else "double"  # floats travel as they are and are doubles in all sums
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{number}>").alias("v"))
    good = base.where(usable(F.col("v")) & F.col("id").isNotNull())
    nodes = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    n = nodes.count()
    shards, blocks = max(shards, -(-n // shard_rows)), max(1, -(-n // block_rows))
    placed = nodes.withColumn("size", F.size("v")).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"), np.float32 if number == "float" else np.float64)
        world = SmallWorld(_unit(x, _norms(x)))
        at, links = _flat(world, len(x))
        del x, world
        trim()
        made = table.select(["size", "shard", "rep", "weight", "v"]).append_column("at", at).append_column("links", links)
        return pa.Table.from_batches(made.to_batches(max_chunksize=_ROWS))

    # a graph travels as one short row for each of its nodes, so that executors sort, spill and send on little at a time
    node = f"size int, shard int, rep long, weight long, v array<{number}>, at int, links array<int>"
    graphs = cut(placed.repartition(4 * shards, "size", "shard").groupBy("size", "shard").applyInArrow(build, node))
    span = max(1, min(_SPAN, shards * blocks // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    lanes = -(-blocks // span)
    asks = placed.select("size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64(F.lit("block"), "v"), F.lit(lanes)).cast("int").alias("lane"), "rep", "v")
    spread = graphs.select("size", "shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "rep", "weight", "v", "at", "links")

    def beside(left: DataFrame, right: DataFrame, *keys: str):
        parts = 2 * shards * (lanes if "lane" in keys else 2)  # few groups meet in one task
        return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys))

    def opened(table: pa.Table) -> tuple:
        table = table.take(pa.array(np.argsort(table.column("at").to_numpy())))
        x = _matrix(table.column("v"), np.float32 if number == "float" else np.float64)
        norms = _norms(x)
        world = SmallWorld.__new__(SmallWorld)
        world.x, world.layers = _unit(x, norms), _layers(table.column("links").combine_chunks())
        return table.column("rep").to_numpy(), table.column("weight").to_numpy(), x, norms, world

    def linked_in(left: pa.Table, right: pa.Table) -> pa.Table:
        """The audited queries with true links in this shard, and how many."""
        if not left.num_rows or not right.num_rows:
            return right.select(["size", "shard", "rep", "v"]).slice(0, 0).append_column("links", pa.array([], pa.int64()))
        reps, _, x, norms, world = opened(left)
        ids, q = right.column("rep").to_numpy(), _matrix(right.column("v"))
        links = np.zeros(len(ids), np.int64)
        for a, b in _product(q, np.linalg.norm(q, axis=1), x, norms, least, world.x):
            links += np.bincount(a[ids[a] != reps[b]], minlength=len(ids))
        some = np.flatnonzero(links)
        del q, x, world
        trim()
        return right.select(["size", "shard", "rep", "v"]).take(pa.array(some)).append_column("links", pa.array(links[some]))

    def retried(beam: int, probes: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """For each size of neighbourhood: true links and those that a search with this beam finds."""
            out: list[tuple] = []
            if left.num_rows:
                reps, _, x, norms, world = opened(left)
                if right.num_rows:
                    ids, q, links = right.column("rep").to_numpy(), _matrix(right.column("v")), right.column("links").to_numpy()
                    got = np.zeros(len(ids), np.int64)
                    for a, b in _pairs(world, q, np.linalg.norm(q, axis=1), x, norms, beam, least):
                        got += np.bincount(a[ids[a] != reps[b]], minlength=len(ids))
                    level = np.floor(np.log(links) / np.log(_FEW) + 1e-9).astype(int)
                    out += [(int(k), int(links[level == k].sum()), int(got[level == k].sum())) for k in np.unique(level)]
                if probes:
                    rng = np.random.default_rng(13)
                    of = rng.choice(len(x), min(len(x), probes), replace=False)
                    q = _copies(x[of] / norms[of, None], least, rng)
                    got = sum(int((of[a] == b).sum()) for a, b in _pairs(world, q, np.linalg.norm(q, axis=1), x, norms, beam, least))
                    out.append((0, len(of), got))
            return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("level", pa.int32()), ("links", pa.int64()), ("got", pa.int64())))})

        return run

    tries = min(n, AUDIT_QUERIES)
    while True:
        drawn = placed if tries >= n else placed.where(F.pmod(F.xxhash64(F.lit("audit"), "v"), F.lit(1 << 40)) < int(tries / n * (1 << 40)))
        drawn = drawn.select("size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "rep", "v")
        truth = cut(beside(graphs, drawn, "size", "shard").applyInArrow(linked_in, f"size int, shard int, rep long, v array<{number}>, links long"))
        few = int(truth.where(F.col("links") < _FEW).agg(F.sum("links")).first()[0] or 0)
        if few >= LINKS or tries >= min(n, AUDIT_MOST):
            break
        tries = min(n, AUDIT_MOST, 4 * tries)
    probes = -(-(LINKS - few) // shards) if few < LINKS and tries < n else 0
    beam = BEAM
    while True:
        seen = beside(graphs, truth, "size", "shard").applyInArrow(retried(beam, probes), "level int, links long, got long")
        if all(r.got >= recall * r.links for r in seen.groupBy("level").agg(F.sum("links").alias("links"), F.sum("got").alias("got")).collect()):
            break
        beam *= 2
        if beam > _LAST:
            beam = n  # every query is held against whole shards
            break

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["node", "links", "root"]
        out = [pa.table({c: pa.array([], pa.int64()) for c in names})]
        if not left.num_rows or not right.num_rows:
            return out[0]
        reps, weights, x, norms, world = opened(left)
        for start in range(0, right.num_rows, block_rows):
            block = right.slice(start, block_rows)
            ids, q = block.column("rep").to_numpy(), _matrix(block.column("v"))
            links = np.zeros(len(ids), np.int64)
            every, where = np.unique(np.concatenate([ids, reps]), return_inverse=True)
            label = np.arange(len(every))
            for a, b in _pairs(world, q, np.linalg.norm(q, axis=1), x, norms, beam, least):
                ok = ids[a] != reps[b]
                a, b = a[ok], b[ok]
                links += np.bincount(a, weights[b], len(ids)).astype(np.int64)
                label = _joined(label, where[a], where[len(ids) + b])
            links_of = np.zeros(len(every), np.int64)
            np.add.at(links_of, where[: len(ids)], links)
            root = every[label]
            some = (links_of > 0) | (root != every)
            out.append(pa.table({"node": every[some], "links": links_of[some], "root": root[some]}))
            del q
        del x, world
        trim()
        return pa.concat_tables(out)

    found = cut(beside(spread, asks, "size", "shard", "lane").applyInArrow(search, "node long, links long, root long"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = cut(nodes.select("v", "rep", "weight").join(counts, F.col("rep") == F.col("node"), "left").drop("node").join(linked, F.col("rep") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    taking = base.withColumn("v", F.when(usable(F.col("v")) & F.col("id").isNotNull(), F.col("v")))
    out = taking.join(of_node, "v", "left").select(F.col("id").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors in double precision, a bounded number at once."""
    return np.concatenate([np.linalg.norm(x[s : s + _ROWS].astype(np.float64), axis=1) for s in range(0, len(x), _ROWS)] or [np.zeros(0)])


def _unit(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for s in range(0, len(x), _ROWS):
        out[s : s + _ROWS] = x[s : s + _ROWS] / norms[s : s + _ROWS, None]
    return out


def _exact(q: np.ndarray, own: np.ndarray, x: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, a bounded number of vectors at once."""
    out = np.empty(len(a))
    for s in range(0, len(a), _PAIRS):
        i, j = a[s : s + _PAIRS], b[s : s + _PAIRS]
        out[s : s + _PAIRS] = np.einsum("ij,ij->i", q[i], x[j].astype(np.float64, copy=False)) / (own[i] * norms[j])
    return out


def _product(q: np.ndarray, own: np.ndarray, x: np.ndarray, norms: np.ndarray, least: float, unit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of query and row with a cosine of at least `least`, a bounded block of cosines at a time: in single precision, and
    in double where the error of that may decide. unit: the rows as unit vectors of single precision, where they are at hand."""
    unit = _unit(x, norms) if unit is None else unit
    near = max(1e-5, (x.shape[1] + 4) * 2.0**-23)  # beyond what rounding adds up to
    step = max(1, _CELLS // len(x))
    for s in range(0, len(q), step):
        cos = (q[s : s + step] / own[s : s + step, None]).astype(np.float32) @ unit.T
        hit = cos >= np.float32(least + near)
        i, j = np.nonzero((cos >= np.float32(least - near)) & ~hit)
        hit[i, j] = _exact(q, own, x, norms, s + i, j) >= least
        a, b = np.nonzero(hit)
        yield s + a, b


def _pairs(world: SmallWorld, q: np.ndarray, own: np.ndarray, x: np.ndarray, norms: np.ndarray, beam: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of query and row with a cosine of at least `least`, a chunk of queries at a time. A query whose beam holds nothing else
    widens it, and is held against all rows when it is wider than _WIDEST."""
    low = np.float32(least - 1e-5)
    for s in range(0, len(q), _TOGETHER):
        left, width = np.arange(s, min(len(q), s + _TOGETHER)), beam
        while len(left) and width < len(x) and width <= max(beam, _WIDEST):
            found, cos = world.search(np.ascontiguousarray(q[left] / own[left, None], np.float32), width)
            full = cos[:, -1] >= low
            i, j = np.nonzero((cos >= low) & (found >= 0) & ~full[:, None])
            a, b = left[i], found[i, j]
            ok = _exact(q, own, x, norms, a, b) >= least
            yield a[ok], b[ok]
            left, width = left[full], width * 2
        if len(left):
            for a, b in _product(q[left], own[left], x, norms, least, world.x):
                yield left[a], b


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest node of each group) after more pairs."""
    u, v = label[a], label[b]
    new = u != v
    u, v = u[new], v[new]
    if not len(u):
        return label
    roots, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    to = np.arange(len(label))
    to[roots] = roots[forest_of(len(roots), at[: len(u)], at[len(u) :])]
    return to[label]


def _copies(unit: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one in a random direction from it, at a cosine between `least` and halfway to 1."""
    side = rng.standard_normal(unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    cos = rng.uniform(least + 1e-9, (1 + least) / 2, (len(unit), 1))
    return cos * unit + np.sqrt(1 - cos * cos) * side
