"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted lists, with distance-weighted votes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm import samples
from beatframe.llm.common import blocks_of, cut, letters_of, span_hashes, text_bytes, trim
from beatframe.llm.quality import platt

LIMIT = 3000  # labelled documents of each class that serve as examples, at most
TERMS = 8192  # terms that are compared, at most: those most tied to the class
NEAREST = 25
BLOCK = 64  # examples under one bound of a list
_STEMS = (4, 5, 6)  # bytes of a longer word that also count as a term
_LEAST, _RATIO = 6, 2.5  # documents and contexts of the class, log ratio of shares that a term needs


def occurrences(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All terms (words in small letters, and beginnings of longer words) of a whole text, each with the hash of the word before."""
    found, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for part in blocks_of(data):
        sums, starts, ends = letters_of(part)
        words = span_hashes(sums, starts, ends)
        previous = np.concatenate([np.zeros(1, np.uint64), words[:-1]])[: len(words)]
        found.append(words)
        before.append(previous)
        for n in _STEMS:
            long = ends - starts > n
            found.append(span_hashes(sums, starts[long], starts[long] + n, salt=n))
            before.append(previous[long])
    return np.concatenate(found), np.concatenate(before)


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a whole text with their counts."""
    return np.unique(occurrences(data)[0], return_counts=True)


@dataclass
class Lists:
    """Inverted lists in blocks of consecutive examples, each block with the largest weight in it."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray  # number of each block
    most: np.ndarray  # largest weight in it
    first: np.ndarray  # where its entries begin, and one past the last
    examples: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    empty: float = 0.0  # score of a text without any of the terms
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector of a text: numbers of its terms and their weights."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        maybe = self.seen[(hashes & np.uint64(len(self.seen) - 1)).astype(np.intp)]
        hashes, counts = hashes[maybe], counts[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes
        at, w = at[hit], (1 + np.log(counts[hit])) * self.idf[at[hit]]
        return at, w / np.sqrt(w @ w) if len(w) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples and their cosines, ties by position: blocks are scored whole, in the order of
        their bounds, until no bound left reaches the k-th cosine; so the result is that of scoring every example."""
        spans = [(self.starts[t], self.starts[t + 1]) for t in at]
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for (a, b), x in zip(spans, w, strict=True):
            bound[self.blocks[a:b]] += x * self.most[a:b]
        order = np.flatnonzero(bound)
        order = order[np.lexsort((order, -bound[order]))]
        where: dict[int, list[tuple[int, float]]] = {}
        for (a, b), x in zip(spans, w, strict=True):
            for j in range(a, b):
                where.setdefault(int(self.blocks[j]), []).append((j, x))
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0), -1.0
        for block in order:
            if bound[block] < least - 1e-12:
                break
            sums = np.zeros(BLOCK)
            for j, x in where[int(block)]:
                a, b = self.first[j], self.first[j + 1]
                sums[self.examples[a:b] - block * BLOCK] += x * self.weights[a:b]
            hit = np.flatnonzero(sums)
            hit = hit[hit + block * BLOCK != without]
            ids, scores = np.concatenate([ids, hit + block * BLOCK]), np.concatenate([scores, sums[hit]])
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            if len(ids) == k:
                least = scores.min()
        top = np.lexsort((ids, -scores))
        return ids[top], scores[top]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic examples among the nearest, each counting by its cosine."""
        return float((cosines * self.toxic[found]).sum() / cosines.sum()) if cosines.sum() > 0 else 0.0

    def score(self, data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        at, w = self.vector(*terms(data))
        if not len(at):
            return self.empty, np.zeros(0, np.int64), np.zeros(0)
        found, cosines = self.nearest(at, w)
        if not len(found):
            return self.empty, found, cosines
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.vote(found, cosines) + self.offset, -500, 500)))
        return float(p), found, cosines


def build(vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Lists:
    """Lists of examples; rows: each example's term numbers and unit weights."""
    term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weight = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    block = example // BLOCK
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    first = np.append(np.flatnonzero(new), len(term))
    most = np.maximum.reduceat(weight, first[:-1]) if len(term) else np.zeros(0)
    starts = np.searchsorted(term[first[:-1]], np.arange(len(vocabulary) + 1)) if len(term) else np.zeros(len(vocabulary) + 1, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.intp)] = True
    return Lists(vocabulary, idf, ids, toxic, starts, block[first[:-1]], most, first, example, weight, seen=seen)


def _vocabulary(chosen: DataFrame, text: str, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms most tied to the class among the examples, with the number of examples that hold each.

    Words of a text that was copied often would look tied to the class of its copies. They follow the same word in every copy, so
    a term must also follow several different words; 64 bits per term, set by the hash of the word before, tell that."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            found = [occurrences(x) for x in text_bytes(batch.column(0))]
            all_terms, before = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]) for i in (0, 1))
            example = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            order = np.lexsort((example, all_terms))
            all_terms, example = all_terms[order], example[order]
            bits = np.where(toxic[example] > 0, np.uint64(1) << (before[order] & np.uint64(63)), np.uint64(0)) if len(example) else np.zeros(0, np.uint64)
            new = np.flatnonzero(np.append(True, all_terms[1:] != all_terms[:-1])[: len(all_terms)])
            once = np.append(True, (all_terms[1:] != all_terms[:-1]) | (example[1:] != example[:-1]))[: len(all_terms)]
            counts = [np.add.reduceat((once & (toxic[example] == y)).astype(np.int64), new) if len(new) else np.zeros(0, np.int64) for y in (1, 0)]
            follow = np.bitwise_or.reduceat(bits, new) if len(new) else bits
            yield pa.RecordBatch.from_arrays([pa.array(all_terms[new].view(np.int64)), *(pa.array(c) for c in counts), pa.array(follow.view(np.int64))], names=["term", "a", "b", "follows"])

    counts = {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0), n1 + n0
    p, q = F.col("a") / n1, F.col("b") / n0
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    sigmas = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    found = chosen.select(text, "y").mapInArrow(run, "term long, a long, b long, follows long")
    found = found.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_count(F.bit_or("follows")).alias("contexts"))
    found = cut(found.where(F.col("a") + F.col("b") >= _LEAST))
    chance = float(np.sqrt(2 * np.log(max(2, found.count()))))  # deviations that the luckiest of so many untied terms reaches
    tied = found.where((F.col("a") >= _LEAST) & (F.col("contexts") >= _LEAST) & (ratio >= _RATIO) & (sigmas >= chance)).select("term", (F.col("a") + F.col("b")).alias("n"), sigmas.alias("z"))
    rows = tied.orderBy(F.desc("z"), "term").limit(limit).collect()
    hashes = np.array([r.term for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in rows], np.float64)[order], n1 + n0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LIMIT, most_terms: int = TERMS) -> Lists:
    """Lists over at most `limit` labelled documents of each class and at most `most_terms` terms; both bounds also bound what
    comes to the driver and is broadcast. Scores are calibrated on the examples, each one without itself, weighted to the
    classes' shares among all labels. Without labels of one class there are no terms and every score is the base rate."""
    chosen = samples.sample(docs, labels, key, text, label, limit).select(F.col(key).cast("long").alias("k"), text, "y")
    vocabulary, having, n = _vocabulary(chosen, text, most_terms)
    totals = samples.class_counts(labels, key, label)
    idf = np.log((1 + n) / (1 + having)) + 1
    bare = build(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0), [])
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.vector(*terms(x)) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([w.astype(np.float64).tobytes() for _, w in made], pa.binary())], names=["k", "y", "at", "w"])

    found = chosen.mapInArrow(run, "k long, y int, at binary, w binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["k"], r["y"], r["at"], r["w"]))
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["w"])) for r in found]
    out = build(vocabulary, idf, np.array([r["k"] for r in found], np.int64), np.array([r["y"] for r in found], np.float64), rows)
    share = np.array([max(totals[0], 1), max(totals[1], 1)]) / np.maximum(1, np.bincount(out.toxic.astype(int), minlength=2))
    base = (totals[1] + 0.5) / (totals[0] + totals[1] + 1)
    bare_rows = np.array([not len(r[0]) for r in rows], bool)
    none = np.array([share[y] * ((out.toxic == y) & bare_rows).sum() for y in (0, 1)])
    out.empty = float((none[1] + base) / (none.sum() + 1)) if len(vocabulary) else float(base)
    with_terms = np.flatnonzero(~bare_rows)
    if len(with_terms):
        tried = np.random.default_rng(3).permutation(with_terms)[:2000]
        votes = np.array([out.vote(*out.nearest(*rows[i], without=int(i))) for i in tried])
        truth = out.toxic[tried]
        # one pseudo-example of each class keeps the curve rising when all examples agree
        weight = np.append(share[truth.astype(int)], share)
        out.slope, out.offset = platt(np.append(votes, [0.0, 1.0]), np.append(truth, [0.0, 1.0]), weight / weight.mean())
    return out


def score(docs: DataFrame, lists: Lists, keep: Iterable[str] = ("doc_id",), text: str = "text", evidence: bool = True) -> DataFrame:
    """keep, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5, else 0) and, unless evidence is false, the nearest examples
    (array of struct<example, cosine, toxic>, nearest first, ties by smaller example) for each row, by its whole text.

    Null texts count as empty; a text without any compared term has the base score of such texts and no evidence. Rows with
    nulls in keep, repeated rows and ties stay; an empty table gives an empty one; columns not in keep are left out."""
    keep = list(keep)
    rows = docs.select(*keep, docs[text].alias("__text"))
    kind = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())] + [T.StructField("evidence", kind)] * evidence)
    arrow = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.score(x) for x in text_bytes(batch.column(len(keep)))]
            p = np.array([m[0] for m in made], np.float64)
            more = [pa.array([[{"example": int(own.ids[i]), "cosine": float(c), "toxic": int(own.toxic[i])} for i, c in zip(m[1], m[2], strict=True)] for m in made], arrow)] if evidence else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *more], names=[*keep, "score", "predicted"] + ["evidence"] * evidence)
        trim()

    return rows.mapInArrow(run, schema)
