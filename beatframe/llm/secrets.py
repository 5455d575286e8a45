"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import text_bytes

#: Fixed patterns, in the order of their kinds, and how long the whole match (assign: its value) must be.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # a run of fewer cannot pass, and holds no longer one
_HINTS = (b"passw", b"secret", b"token", b"api")  # no assignment without one of these
KINDS = ("assign", "access", "hex", "markov")
VALUE, ACCESS_LENGTH = 8, 16

RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")  # what the models judge
LEARNT = re.compile(rb"[A-Za-z0-9+/_=-]{4,}")  # what they learn from
TEXTS = 2000  # different texts that the models are fitted on, at most
MADE = 2000  # made-up random strings of each alphabet
LEAST = 24.0  # log-likelihood ratio from which a run counts as random
RATE = 1.0  # and what it must come to for each character, so that long runs do not gather it from a few odd places
SAME = 0.25  # weight of one character again and again in ordinary strings, as a share of what else follows it
ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last stands for the start of a string

_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
_STARTED = _CODE.copy()
_STARTED[0] = SIZE - 1
DRAWN = (b"0123456789abcdef", b"0123456789abcdefghijklmnopqrstuvwxyz", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + b"_-")


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the fixed patterns in the bytes of a text, leftmost and non-overlapping for each kind."""
    out, small = [], data.lower()
    if any(x in small for x in _HINTS):
        out = [(*m.span(), 0, m.start(2)) for m in ASSIGN.finditer(data) if m.end() - m.start(2) >= VALUE]
    if b"AKIA" in data:
        out += [(*m.span(), 1, m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(*m.span(), 2, m.start()) for m in HEX.finditer(data)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def pairs(text: bytes) -> np.ndarray:
    """The number of each pair of neighbours of a string of the alphabet, its start included."""
    codes = _CODE[np.frombuffer(text, np.uint8)]
    return np.append(SIZE - 1, codes[:-1]) * SIZE + codes


def drawn(count: int = MADE) -> Iterator[bytes]:
    """Made-up random strings: `count` of 20 to 60 characters of each alphabet, the same on every run."""
    for number, letters in enumerate(DRAWN):
        for i in range(count):
            seed = b"".join(hashlib.sha256(f"{number}:{i}:{k}".encode()).digest() for k in range(2))
            yield bytes(letters[x * len(letters) >> 8] for x in seed[: 20 + seed[63] % 41])


def composed(word: bytes) -> Iterator[bytes]:
    """A word or identifier as it stands, and as programs, paths and options compose such words."""
    big = word.capitalize()
    yield from (word, word.upper(), word + big, word + b"_" + word, word + b"-" + word, b"/" + word + b"/" + word, b"--" + word + b"=" + word, word + b"1", word.upper() + b"_" + word.upper())


def numbers() -> Iterator[bytes]:
    """Dates, times, counters and versions."""
    for i in range(400):
        y, m, d, h = 1990 + i % 50, 1 + i % 12, 1 + i % 28, i % 24
        yield from (b"%d-%02d-%02dT%02d-%02d-%02dZ" % (y, m, d, h, i % 60, i * 7 % 60), b"%d/%02d/%02d" % (y, m, d), b"%d_%02d_%02d" % (d, m, y), b"%d%02d%02dT%02d%02d%02dZ" % (y, m, d, h, i % 60, i * 11 % 60))
        yield from (b"part-%05d" % i, b"v%d-%d_%d" % (i % 9, d, m), b"+%d-%d-%d" % (i, y, i * i), b"%d=%d" % (i, y))


def counted(strings: Iterable[bytes]) -> np.ndarray:
    """How often each pair occurs in strings of the alphabet."""
    codes = _STARTED[np.frombuffer(b"\0" + b"\0".join(strings), np.uint8)]
    inside = codes[1:] != SIZE - 1
    return np.bincount((codes[:-1] * SIZE + codes[1:])[inside], minlength=SIZE * SIZE)


@dataclass
class Model:
    ratios: np.ndarray  # log of P(random) over P(ordinary) of each pair
    least: float = LEAST
    rate: float = RATE

    def score(self, text: bytes) -> float:
        """The log-likelihood ratio of a string of the alphabet."""
        return float(self.ratios[pairs(text)].sum())

    def random_runs(self, data: bytes, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, float]]:
        """(start, end, score) of the runs of a text that overlap no span taken and look more random than ordinary."""
        out = []
        starts = [s[0] for s in taken]
        ends = np.maximum.accumulate([s[1] for s in taken]).tolist() if taken else []
        for m in RUN.finditer(data):
            a, b = m.span()
            k = bisect_right(starts, b - 1)
            if k and ends[k - 1] > a:
                continue
            if (score := self.score(m[0])) >= max(self.least, self.rate * (b - a)):
                out.append((a, b, score))
        return out


def learnt(random: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5) -> Model:
    """A model of the counts of pairs in random and in ordinary strings: each row of smoothed counts is a distribution of the next character."""
    logs = []
    for counts, same in ((random, 0), (ordinary, SAME)):
        rows = counts.reshape(SIZE, SIZE)[:, :-1] + smooth
        rows[np.arange(SIZE - 1), np.arange(SIZE - 1)] += same * rows[:-1].sum(axis=1)
        logs.append(np.log(rows / rows.sum(axis=1, keepdims=True)))
    ratios = np.zeros((SIZE, SIZE))
    ratios[:, :-1] = logs[0] - logs[1]
    return Model(ratios.ravel())


def labelled(docs: DataFrame, text: str = "text", limit: int = TEXTS) -> DataFrame:
    """(string, random): different strings of at most `limit` different texts, those whose hash is smallest: values of the fixed patterns (random), and
    the other words and identifiers. A string that is both counts as random. Null and empty texts have none."""
    rows = docs.select(docs[text].alias("text")).where("text <> ''")
    chosen = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(limit)
    rows = rows.join(F.broadcast(chosen), F.xxhash64("text") == F.col("h"), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in text_bytes(batch.column(0)):
                found = base_spans(data)
                strings: dict[bytes, bool] = {}
                at = 0
                for a, b, kind, value in [*found, (len(data), len(data), -1, 0)]:
                    strings.update((x, False) for x in LEARNT.findall(data[at:a]) if x not in strings)
                    at = max(at, b)
                    if kind >= 0:
                        strings.update((x, True) for x in LEARNT.findall(data[value:b]))
                keys = list(strings)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([strings[k] for k in keys], pa.bool_())], names=["string", "random"])

    return rows.mapInArrow(run, "string binary, random boolean").groupBy("string").agg(F.max("random").alias("random"))


def fit(strings: DataFrame) -> Model:
    """Both models from labelled strings (string binary, random boolean), ordinary ones also composed as programs do, from made-up random ones, and from
    dates and numbers. Pairs are counted where the strings are, so at most two counts for each pair come to the driver. Characters outside the
    alphabet end a string; nulls are left out; without strings only made-up ones count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            made: tuple[list, list] = ([], [])
            for text, random in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and random is not None:
                    for part in LEARNT.findall(text):
                        made[random].extend([part] if random else composed(part))
            total += [counted(x) for x in made]
        which, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(pair), pa.array(total[which, pair])], names=["random", "pair", "n"])

    counts = np.array([counted(numbers()), counted(drawn())], float)
    for r in strings.select("string", "random").mapInArrow(run, "random long, pair long, n long").groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r.random, r.pair] += r.n
    return learnt(counts[1], counts[0])


SPANS = "array<struct<kind:string,start:long,end:long,secret:string,score:double>>"


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and found (array of kind, start, end, secret, score) of every row: all spans of the fixed patterns, and those runs without one that the models
    call random (kind markov, the only ones with a score), by start, then kind. Positions are code points, ends exclusive; secret is the value of an
    assignment or the whole match. Null and empty texts have no spans; null keys and repeated rows stay, each row by itself; an empty table gives
    an empty one; other columns are left out. Whole texts are read, in time proportional to their length."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def spans(data: bytes) -> list[dict]:
        base = base_spans(data)
        every = [(a, kind, b, value, None) for a, b, kind, value in base] + [(a, 3, b, a, s) for a, b, s in model.random_runs(data, base)]
        if not every:
            return []
        every.sort(key=lambda x: x[:3])
        place: dict[int, int] = {}
        at = seen = 0
        for x in sorted({x for s in every for x in (s[0], s[2])}):  # each stretch is decoded once
            seen += x - at if data.isascii() else len(data[at:x].decode())
            place[x], at = seen, x
        return [{"kind": KINDS[k], "start": place[a], "end": place[b], "secret": data[v:b].decode(), "score": s} for a, k, b, v, s in every]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(x) for x in text_bytes(batch.column(1))], kind)], names=["key", "found"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, found {SPANS}").withColumnRenamed("key", key)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans, of what scan found."""

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts, base = [of_kind(k) for k in KINDS[:3]], F.filter("found", lambda s: s.kind != KINDS[3])
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
