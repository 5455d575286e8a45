"""N-gram Jaccard links, components and vector searches against plain versions."""

import itertools
import pathlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm import common, jaccard, vectors
from beatframe.llm.queries import ORACLE


def plain_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def smallest(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    common_line = " ".join(word() for _ in range(12))
    out = [None, "", " \t", "one two", "ONE two", "one two three four", "a a a a a a a a", "ABC abc Abc é É x"]
    for size in (7, 9, 16, 17, 20, 40, 64, 65, 90, 300):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(min(edits, size // 6)):
                copy[rng.randrange(size)] = word()
            if rng.random() < 0.3:
                copy = copy[: max(5, int(size * rng.uniform(0.6, 1)))]
            out.append(" ".join(copy))
            out.append(common_line + "\n" + " ".join(word() for _ in range(size)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BESIDE", 3)
    made = texts(seed)
    rows = [(i * 7 % 1009, x, i) for i, x in enumerate(made)] + [(None, "one two", 0), (7, made[1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key int")
    got = jaccard.link(docs).collect()
    assert len(got) == len(rows)
    sets = {i * 7 % 1009: plain_set(x) for i, x in enumerate(made)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    assert len(set(want.values())) < len(sets) - 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert jaccard.link(docs.limit(0)).count() == 0


def test_same_as_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"select doc_id, n_shingles, component_id from ({ORACLE['op2_ngram_jaccard']})").fetchall()
    assert sorted(tuple(r) for r in jaccard.link(docs).collect()) == sorted(want)


def test_signatures_of_linked_sets_meet():
    bands, rng = jaccard.Bands(), np.random.default_rng(4)
    for n in [*range(1, 40), 64, 65, 70, 250, 256, 257, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(10):
            drop = rng.integers(0, max(1, n // 4) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: n - drop], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                assert any(len(np.intersect1d(x, y)) for s, x in bands.signatures(a) for t, y in bands.signatures(b))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7), (7, 8), (None, 3), (2000, 2000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e for x in e}
    assert got == smallest(nodes, [e for e in edges if None not in e])


def test_hashes_of_words_do_not_depend_on_their_place():
    whole = common.word_hashes(b"  Ab\tcd ab\n\xc3\xa9x  cd")
    assert whole[0] == whole[2] and whole[1] == whole[4] and len(set(whole.tolist())) == 3
    long = b"x" * ((1 << 20) + 5)
    assert common.word_hashes(b"a " + long + b" a")[1] == common.word_hashes(long)[0]


def vector_rows(seed, n=700, size=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)).astype(np.float32)
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, size)).astype(np.float32)
    x[200:230] = x[200]
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)]
    odd = [(9000, None, "a"), (9001, [0.0] * size, "b"), (9002, [float("nan")] * size, "c"), (9003, [None] + [1.0] * (size - 1), "d"), (9004, [], "e"), (9005, [float("inf")] * size, "f"), (None, rows[3][1], "g"), (9100, [1.0, 2.0], "h")]
    return x.astype(np.float64), rows + odd


def test_nearest_neighbours(spark):
    x, rows = vector_rows(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = vectors.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=200, block_rows=40).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 700, 10))  # 9100 has no other vector of its length, the other odd ones take no part
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({r.vec_id for r in found} & set(want.tolist()))
        assert [r.rank for r in found] == list(range(1, 11)) and [r.score for r in found] == [d[r.vec_id] for r in found]
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    assert hits >= 0.9 * 10 * len(by)
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 4")
    assert vectors.nearest(few, few.where("vec_id = 0")).count() == 3


def test_near_duplicate_vectors(spark):
    x, rows = vector_rows(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shard_rows=200, block_rows=300).collect()}
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    want = smallest(range(700), links)
    right = sum(got[i].component_id == want[i] for i in range(700))
    assert right >= 0.97 * 700 and sum(got[i].n_links for i in range(700)) >= 0.9 * 2 * len(links)
    assert all(got[i].n_links <= near[i].sum() - 1 and got[i].kept == (i == got[i].component_id) for i in range(700))
    for i in (9000, 9001, 9002, 9003, 9004, 9005, 9100):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and not got[None].kept
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_rare_links_are_found(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:200] = vectors._copies(x[1000:1200], 0.9, rng)  # 1% in pairs
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shards=1).collect()}
    assert all(got[i].n_links == 0 for i in range(2000, 20_000))
    assert sum(got[i].n_links for i in range(1200)) >= vectors.RECALL * 400
    assert sum(got[1000 + i].component_id == i for i in range(200)) >= vectors.RECALL * 200


def test_a_dense_third_keeps_no_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[:1000] = x[0] + 0.02 * rng.standard_normal((1000, 16))
    own = np.linalg.norm(x, axis=1)
    unit = x / own[:, None]
    near = unit @ unit.T >= 0.9
    want = smallest_of(near)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert all(got[i].n_links == near[i].sum() - 1 for i in range(1000)) and [got[i].component_id for i in range(1000)] == want[:1000]
    world = vectors.SmallWorld(unit[:600])
    label, pairs = np.arange(600), 0
    for a, b in vectors._pairs(world, x[:600], own[:600], x[:600], own[:600], vectors.BEAM, 0.9):
        assert len(a) <= vectors._CELLS
        pairs += len(a)
        label = vectors._joined(label, a, b)
    assert pairs == near[:600, :600].sum() and (label == 0).all()


def test_graphs_travel_in_short_rows_and_serve_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((1200, 12)).astype(np.float32)
    x[:120] = x[120:240] + 0.05 * rng.standard_normal((120, 12)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    written = []
    monkeypatch.setattr(vectors, "cut", lambda t: written.append(common.cut(t)) or written[-1])
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shard_rows=300, block_rows=30).collect()}  # 4 shards, 40 blocks
    assert len(got) == 1200 and all(got[i].n_links <= near[i].sum() - 1 for i in range(1200))
    assert sum(r.n_links for r in got.values()) >= vectors.RECALL * (near.sum() - 1200)
    want = smallest_of(near)
    assert sum(got[i].component_id == want[i] for i in range(1200)) >= 0.99 * 1200
    longest = [t.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] for t in written]
    assert max(n or 0 for n in longest) < 10_000  # a whole graph in one row would have 200 kB here, and 48 MB in a full shard


@pytest.mark.parametrize("n", [1, 2, 40, 3000])
def test_graphs_are_put_together_again(n):
    x = np.random.default_rng(n).standard_normal((n, 8))
    world = vectors.SmallWorld(vectors._unit(x, vectors._norms(x)))
    at, links = vectors._flat(world, n)
    again = vectors._layers(links)
    assert at.to_pylist() == list(range(n)) and len(again) == len(world.layers)
    assert all(np.array_equal(a.nodes, b.nodes) and np.array_equal(a.links, b.links) for a, b in zip(again, world.layers, strict=True))


def test_links_of_many_nodes_are_chosen_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    of = np.arange(60)
    ids = np.stack([rng.permutation(300)[:40] for _ in of])
    ids[::3, 5:] = -1
    ids[1, 7] = 1  # itself
    monkeypatch.setattr(vectors, "_TRIALS", 40 * 40 * 7)
    got = vectors._diverse(x, of, ids, 16)
    for i, node in enumerate(of):
        mine = [int(m) for m in ids[i] if m >= 0 and m != node]
        taken: list[int] = []
        for m in mine:
            if len(taken) < 16 and all(x[m] @ x[t] <= x[m] @ x[node] for t in taken):
                taken.append(m)
        want = taken + [m for m in mine if m not in taken][: 16 - len(taken)]
        assert got[i].tolist() == want + [-1] * (16 - len(want))


def test_block_products_decide_as_double_precision():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((500, 24))
    own = np.linalg.norm(x, axis=1)
    q = np.concatenate([vectors._copies(x / own[:, None], 0.9, rng), x])
    for k in range(100):  # cosines within 1e-8 of the least one
        side = rng.standard_normal(24)
        side -= side @ x[k] * x[k] / own[k] ** 2
        c = 0.9 + (k - 50) * 2e-10
        q[k] = c * x[k] / own[k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    long = np.linalg.norm(q, axis=1)
    got = {(int(i), int(j)) for a, b in vectors._product(q, long, x, own, 0.9) for i, j in zip(a, b, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.einsum("id,jd->ij", q, x) / (long[:, None] * own) >= 0.9), strict=True)}
    assert {p for p in got ^ want if not abs(p[0] - 50) <= 1} == set() and len(want) > 900


def smallest_of(near):
    label = list(range(len(near)))
    for i in range(len(near)):
        if label[i] == i:
            open_at = [i]
            while open_at:
                for k in np.flatnonzero(near[open_at.pop()]).tolist():
                    if k > i and label[k] == k:
                        label[k] = i
                        open_at.append(k)
    return label


def test_the_second_look_does_not_grow_with_the_square(spark, monkeypatch):
    """One-line texts with 1 to 3 changed words of 60: sets held against blocks, as the texts double."""
    seen = []
    held = jaccard.held_against

    def counting(blocks, against, sets, bands):
        seen[-1].append(against.distinct().count())
        return held(blocks, against, sets, bands)

    monkeypatch.setattr(jaccard, "held_against", counting)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(600):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    for size in (300, 600):
        seen.append([])
        got = jaccard.link(spark.createDataFrame(list(enumerate(texts[:size])), "doc_id long, text string"))
        labels = {r.doc_id: r.component_id for r in got.collect()}
        if size == 300:
            sets = {i: plain_set(x) for i, x in enumerate(texts[:size])}
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            label = list(range(size))
            for _ in range(size):
                before = list(label)
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
                if label == before:
                    break
            assert labels == dict(enumerate(label))
    totals = [sum(x) for x in seen]
    assert totals[1] <= 2.6 * totals[0], seen


def test_links_do_not_depend_on_what_a_task_holds(spark):
    docs = spark.createDataFrame(list(enumerate(texts(3))), "doc_id long, text string")
    assert sorted(jaccard.link(docs, flush=50).collect()) == sorted(jaccard.link(docs).collect())


def tables_written(spark, run):
    """What run gives, and how many intermediate tables it wrote."""
    folder = pathlib.Path(common.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    return run(), len(set(folder.glob("table-*")) - before)


def test_components_end_when_all_pairs_are_stars(spark):
    stars = spark.createDataFrame([(x, 100 * (x // 100)) for x in range(100, 400)], "a long, b long")
    got, written = tables_written(spark, lambda: {r.node: r.component for r in common.components(stars).collect()})
    assert got == {x: 100 * (x // 100) for x in range(100, 400)}
    assert written == 1  # the pairs themselves; nothing has to be joined up


def test_near_copies_that_are_settled_are_not_looked_at_again(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join([*words[: i % 3], "x", *words[i % 3 :]])) for i in range(1, 13)] + [(50, "of its own " * 9), (51, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got, written = tables_written(spark, lambda: {r.doc_id: r.component_id for r in jaccard.link(docs).collect()})
    assert got == {i: 1 for i in range(1, 13)} | {50: 50, 51: 51}
    assert written <= 18  # the driver keeps a record of every job
