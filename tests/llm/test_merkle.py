"""Merkle manifests against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from beatframe.llm import merkle, ordered
from beatframe.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fanout=3):
    """The root of a list of digests, and the siblings of each, level by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
    root, above = climb([H(*r) for r in runs], fanout)
    return root, [[(run[:i], run[i + 1 :]), *above[k]] for k, run in enumerate(runs) for i in range(len(run))]


def plain(rows, fanout=3):
    groups = {}
    for key, source, lang, n, text in rows:
        leaf = H(*map(field, (key, source, lang, n, text)))
        groups.setdefault(source, []).append((key is not None, key or 0, leaf, key, H(*map(field, (key, source, lang, n, text and text.replace("\n", ""))))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])], fanout) for s in order}
    root, above = climb([trees[s][0] for s in order], fanout)
    out = []
    for i, s in enumerate(order):
        for (_, _, leaf, key, bare), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            path = path + above[i]
            h = bare if key is not None and zlib.crc32(str(key).encode()) % 2 == 0 else leaf
            for before, after in path:
                h = H(*before, h, *after)
            out.append((key, leaf, trees[s][0], root, H(*[x for b, a in path for x in b + a]), h, h == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, size int")


ODD = [
    (1, None, None, None, None), (2, None, "en", 0, ""), (None, "a", "en", 3, "x\ny"), (None, "a", "en", 3, "z"), (5, "a", "en", 3, "x\ny"), (5, "a", "en", 3, "x\ny"),
    (6, "a", "en", 3, "é\n" * 9000), (7, "ä", "en", 3, "x"), (8, "Z", None, 3, "x\n"), (9, "", "en", 3, "\n"), (10, "", "en", 3, "-"),
]


@pytest.mark.parametrize("count", [0, 1, 4, 28])
def test_equals_a_plain_tree(spark, count):
    rows = ODD[:count] if count < 12 else ODD + [(i, "hot", "en", i, f"line\n{i}") for i in range(100, 100 + count)] + [(100, "hot", "en", 100, "line\n100")]
    got = sorted((tuple(r) for r in merkle.document_manifest(frame(spark, rows)).collect()), key=repr)
    assert got == (plain(rows) if rows else [])


@pytest.mark.parametrize(("fanout", "levels"), [(3, 2), (2, 3)])
def test_tiles_and_fanouts_do_not_matter(spark, fanout, levels):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"{i}\n") for i in range(150)]
    docs = frame(spark, rows)
    leaves = docs.select("doc_id", "source", merkle.leaf_of(*[docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    placed = ordered.numbered(leaves, "source", ["doc_id"]).withColumn("node", F.col("leaf"))
    stages, tops = merkle.ascend(placed, "source", merkle.most_in_a_group(placed), fanout, levels)
    above = tops.select("source", F.col("top").alias("subroot"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    found = merkle.descend(stages, "source", above, fanout, levels).select("source", "doc_id", "subroot", merkle.fold(F.col("leaf")).alias("folded"), F.size("path").alias("n")).collect()
    assert len(found) == len(rows) and all(r.folded == r.subroot for r in found)
    for s in {r.source for r in found}:
        own = sorted((i, H(*map(field, x))) for i, x in enumerate(rows) if x[1] == s)
        root, paths = climb([h for _, h in own], fanout)
        assert {r.subroot for r in found if r.source == s} == {root}
        assert {r.n for r in found if r.source == s} == {len(paths[0])}


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 7)
    rows = [(None if i % 11 == 0 else f"g{i % 2}", i * 37 % 50, i) for i in range(120)]
    found = ordered.numbered(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), "g", ["k", "v"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((k, v) for x, k, v in rows if x == g)
        assert [(r.k, r.v) for r in sorted((r for r in found if r.g == g), key=lambda r: r.pos)] == own
        assert [r.pos for r in sorted((r for r in found if r.g == g), key=lambda r: r.pos)] == list(range(len(own)))
        assert {r.size for r in found if r.g == g} == {len(own)}


def test_a_changed_text_is_found_and_others_are_verified(spark):
    found = QUERIES["op11_merkle_manifest"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain([tuple(r) for r in docs])
    changed = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")}
    assert {r.doc_id for r in found if not r.verified} == changed and changed
    assert "op11_merkle_manifest" in ORACLE
