"""Language ID: Bayesian fusion of text likelihoods, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm.common import blocks_of, cut, text_bytes, trim

LIMIT = 1500  # different texts of each language that likelihoods are learnt from, on average
STRENGTH = 20.0  # rows that a coarser prior counts as when a finer one is formed
FREE = 40.0  # letter groups of a text that count in full; those of a longer one are scaled down to this plus a tenth
BACKED = 1000.0  # letter groups that the background counts as in the likelihood of a language
UNKNOWN = "und"
_BITS = 16


def _table() -> np.ndarray:
    """Letters in small form, bytes from 128 on as they are, everything else as a gap."""
    table = np.zeros(256, np.uint32)
    for b in range(256):
        table[b] = b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 0
    return table


_FOLD = _table()


def grams(data: bytes) -> np.ndarray:
    """Places of a whole text's letter groups of three bytes, gaps counting as one; groups with no letter are left out."""
    out = []
    for part in blocks_of(data):
        codes = _FOLD[np.frombuffer(part, np.uint8)]
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))[: len(codes)]]
        codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
        three = (codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:]
        three = three[codes[1:-1] > 0]
        out.append((three * np.uint32(2654435761)) >> np.uint32(32 - _BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_WHOLE = re.compile(rb"<(script|style|nav|footer|head)\b", re.I)


def visible(html: bytes) -> bytes:
    """What a page shows, roughly: without scripts, styles, head, menus, footers, comments and tags. What nothing closes is a tag, or text if
    no tag ends behind it; each kind of ending that is missing is searched for once, so time is proportional to the page."""
    out, at, missing = [], 0, set()
    while (start := html.find(b"<", at)) >= 0:
        end = -1
        m = _WHOLE.match(html, start)
        name = m[1].lower() if m else None
        if name and name not in missing:
            close = re.compile(rb"</" + name + rb"\s*>", re.I).search(html, m.end())
            end = close.end() if close else -1
            if not close:
                missing.add(name)
        elif html.startswith(b"<!--", start) and b"--" not in missing:
            end = html.find(b"-->", start + 4) + 3
            if end == 2:
                missing.add(b"--")
                end = -1
        if end < 0:
            end = html.find(b">", start) + 1
            if not end:
                break
        out += [html[at:start], b" "]
        at = end
    out.append(html[at:])
    return b"".join(out)


@dataclass
class Likelihoods:
    languages: list[str]  # the last is UNKNOWN, a text in none of the others
    log_p: np.ndarray  # of each letter group in each language

    def score(self, data: bytes) -> np.ndarray | None:
        """Log likelihoods of a text by language, up to a constant; None without letters. Neighbouring letter groups depend on each
        other, so beyond the first ones they count a tenth."""
        places = grams(data)
        if not len(places) or not self.languages:
            return None
        mean = np.bincount(places, minlength=1 << _BITS).astype(np.float32) @ self.log_p if len(places) > 20_000 else self.log_p[places].sum(axis=0)
        n = len(places)
        total = mean.astype(np.float64) * (min(n, FREE + max(0.0, n - FREE) / 10) / n)
        return total - total.max()


def background(letters: np.ndarray) -> np.ndarray:
    """Probability of each place for a text in none of the languages: half of it letters of all languages, drawn one by one, half any group."""
    codes = np.unique(_FOLD)
    p = letters[codes] + 0.5
    p = p / p.sum()
    middle = np.where(codes > 0, p, 0) / p[codes > 0].sum()
    two = (codes[:, None] << np.uint32(16)) | (codes[None, :] << np.uint32(8))
    out = np.zeros(1 << _BITS)
    for last, share in zip(codes, p, strict=True):
        places = ((two | last) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        out += np.bincount(places.ravel(), (p[:, None] * middle[None, :] * share).ravel(), 1 << _BITS)
    return 0.5 * out + 0.5 / (1 << _BITS)


def learn(docs: DataFrame, text: str = "text", language: str = "lang", limit: int = LIMIT) -> Likelihoods:
    """Letter-group likelihoods from about `limit` different texts of each declared language, and those of `background` for a text in none
    of them. Texts are chosen by their hash, so the same ones serve whatever the partitioning; copies count once, in the share too."""
    tagged = docs.select(F.lower(F.trim(docs[language])).alias("lang"), docs[text].alias("text")).where(f"lang is not null and lang not in ('', '{UNKNOWN}') and text is not null")
    different = tagged.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = different.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r.lang for r in counts]
    if not languages:
        return Likelihoods([], np.zeros((1 << _BITS, 0), np.float32))
    # the texts with the smallest hashes of a language, so that one with few texts is never without any
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, limit / r.n)) for r in counts], "lang string, share double")
    least = different.groupBy("lang").agg(F.min(F.pmod("h", F.lit(1_000_000))).alias("least"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    chosen = tagged.join(F.broadcast(share.join(least, "lang")), "lang").where((place < F.col("share") * 1_000_000) | (place == F.col("least"))).select("lang", "text").distinct()
    number = {x: i for i, x in enumerate(languages)}
    k = len(languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        letters = np.zeros(256, np.int64)
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                mine = counts.setdefault(number[lang], np.zeros(1 << _BITS, np.int64))
                mine += np.bincount(grams(data), minlength=1 << _BITS)
                for part in blocks_of(data):
                    codes = _FOLD[np.frombuffer(part, np.uint8)]
                    letters += np.bincount(codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))[: len(codes)]], minlength=256)
        for of, all_n in [*counts.items(), (k, letters)]:
            where = np.flatnonzero(all_n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), of, np.int32)), pa.array(where.astype(np.int32)), pa.array(all_n[where])], names=["of", "place", "n"])
        del counts, letters
        trim()

    found = chosen.mapInArrow(run, "of int, place int, n long").groupBy("of", "place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((1 << _BITS, k))
    letters = np.zeros(256)
    if found.num_rows:
        of, place, n = (found.column(c).to_numpy() for c in ("of", "place", "n"))
        table[place[of < k], of[of < k]] += n[of < k]
        letters[place[of == k]] = n[of == k]
    other = background(letters)
    table += BACKED * other[:, None]  # so little text does not make a language less likely than none
    log_p = np.log(np.column_stack([table / table.sum(axis=0), other / other.sum()]))
    return Likelihoods([*languages, UNKNOWN], log_p.astype(np.float32))


def suffix_of(url: Column) -> Column:
    """The part of an address that tells a language: a first path segment of two letters, or else the last label of the host."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]*\.([a-zA-Z]+)(?:[:/?#]|$)", 1)
    return F.lower(F.when(path != "", F.concat(F.lit("/"), path)).when(top != "", F.concat(F.lit("."), top)))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def declared_of(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def identify(rows: DataFrame, likelihoods: Likelihoods, keep: Iterable[str], text: str, declared: str, suffix: str, host: str, least: float = 0.5, markup: bool = False) -> DataFrame:
    """keep, language, confidence (the posterior of language) and kept (language known and confidence >= least) of each row.

    Evidence is multiplied: the text's letter groups; P(declared language | language) and P(suffix | language), counted over all rows by
    the language that their texts alone give; and a prior of the host, smoothed towards that of its domain, which is smoothed
    towards all rows', each coarser one counting as STRENGTH rows. Nulls in declared, suffix or host are no evidence; a text without
    letters (null, empty) leaves the rest to decide, and with no evidence at all the language is `und`. So it is where letters drawn one by
    one explain the text better than every language does: `und` is an outcome like the others and is not kept. markup: text is HTML.
    Rows with nulls in keep and repeated rows stay; an empty table gives an empty one; other columns are left out."""
    keep = list(keep)
    k = len(likelihoods.languages)
    shared = rows.sparkSession.sparkContext.broadcast(likelihoods)
    kept = [rows[c].alias(f"__k{i}") for i, c in enumerate(keep)]
    read = rows.select(*kept, F.lower(rows[declared]).alias("declared"), rows[suffix].alias("suffix"), rows[host].alias("host"), rows[text].alias("text"))
    fields = [f for f in read.schema.fields if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(visible(x) if markup else x) for x in text_bytes(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([None if s is None else s.tolist() for s in scores], pa.list_(pa.float64()))], names=[*names, "scores"])
        trim()

    scored = cut(read.mapInArrow(run, T.StructType([*fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])))
    if not k:
        return scored.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    told = scored.where("scores is not null").select("declared", "suffix", "host", domain_of(F.col("host")).alias("domain"), best.alias("best"))
    per = [F.sum((F.col("best") == i).cast("double")).alias(f"n{i}") for i in range(k)]
    counts = lambda by: told.where(F.col(by).isNotNull()).groupBy(by).agg(*per)
    row = told.agg(*per).first()
    total = [float(row[i] or 0) for i in range(k)]
    world = [(t + 1) / (sum(total) + k) for t in total]
    array = lambda *xs: F.array(*[x.cast("double") for x in xs])
    size = lambda prefix="": sum((F.col(f"{prefix}n{i}") for i in range(1, k)), F.col(f"{prefix}n0"))
    given = lambda by: counts(by).select(by, array(*[F.log((F.col(f"n{i}") + STRENGTH * size() / (sum(total) + 1) + 0.5) / (total[i] + STRENGTH)) for i in range(k)]).alias(f"of_{by}"))
    domains = counts("domain").select("domain", array(*[(F.col(f"n{i}") + STRENGTH * world[i]) / (size() + STRENGTH) for i in range(k)]).alias("p"))
    hosts = told.where("host is not null").groupBy("host", "domain").agg(*per).join(domains, "domain")
    hosts = hosts.select("host", array(*[F.log((F.col(f"n{i}") + STRENGTH * F.col("p")[i]) / (size() + STRENGTH)) for i in range(k)]).alias("of_host"))
    # written out, so that a join with a host that holds a third of all rows can be split
    parts = {by: cut(x) for by, x in (("declared", given("declared")), ("suffix", given("suffix")), ("host", hosts))}
    all_in = scored
    for by, x in parts.items():
        all_in = all_in.join(x, by, "left")
    zero = F.array(*[F.lit(0.0)] * k)
    prior = F.coalesce("of_host", F.array(*[F.lit(float(np.log(w))) for w in world]))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.coalesce("scores", zero), prior), add(F.coalesce("of_declared", zero), F.coalesce("of_suffix", zero)))
    weighed = all_in.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    evidence = F.col("scores").isNotNull() | F.col("of_declared").isNotNull() | F.col("of_suffix").isNotNull() | F.col("of_host").isNotNull()
    tongue = F.element_at(F.array(*[F.lit(x) for x in likelihoods.languages]), F.array_position("logs", F.col("top")).cast("int"))
    out = weighed.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.when(evidence, tongue).otherwise(UNKNOWN).alias("language"), F.when(evidence, confidence).otherwise(0.0).alias("confidence"))
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= least))


def identify_documents(docs: DataFrame, likelihoods: Likelihoods | None = None, keep: Iterable[str] = ("doc_id",), text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """identify for plain documents: the language column is what they declare, the source their host."""
    rows = docs.select(*[docs[c].alias(f"__d{i}") for i, c in enumerate(keep)], docs[text].alias("text"), docs[language].alias("declared"), F.lit(None).cast("string").alias("suffix"), docs[source].alias("host"))
    out = identify(rows, likelihoods or learn(docs, text, language), [f"__d{i}" for i in range(len(list(keep)))], "text", "declared", "suffix", "host")
    return out.select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(keep)], "language", "confidence", "kept")


def identify_pages(pages: DataFrame, likelihoods: Likelihoods, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """identify for web pages: declared language of the markup, suffix and host of the address."""
    address = pages[url]
    rows = pages.select(pages[key].alias("__id"), pages[html].alias("text"), declared_of(pages[html]).alias("declared"), suffix_of(address).alias("suffix"), host_of(address).alias("host"))
    out = identify(rows, likelihoods, ["__id"], "text", "declared", "suffix", "host", markup=True)
    return out.select(F.col("__id").alias(key), "language", "confidence", "kept")
