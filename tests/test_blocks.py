"""Block size never changes a result, whatever the size of a plan."""

import random

import pytest
from pyspark.sql import functions as F

from beatframe.operators import blocks as B, dedup as D, rank as K, sequence as Q, validate as V


def rows(df):
    return sorted(map(repr, df.collect()))


def words_of(spark, plans, seed=1):
    rnd, out = random.Random(seed), []
    for p, n in plans:
        t = 0
        for i in range(n):
            d = rnd.randint(60, 500)
            out.append((p, i, t, t + d, "w" + str(i % 7) + (rnd.choice([".", "!", ""]) if rnd.random() < 0.15 else "")))
            t += d + rnd.randint(0, 300)
    return spark.createDataFrame(out, "plan_id long, idx int, start_ms long, end_ms long, text string")


def chunks_by_hand(words, target=1700, minimum=950, maximum=2700):
    out, cur = [], []
    for w in words:
        cur.append(w)
        d = cur[-1].end_ms - cur[0].start_ms
        if d >= minimum and (d >= maximum or (d >= target and w.text[-1] in ".!?…") or d >= target + 320):
            out.append(cur)
            cur = []
    if cur:
        if out and (cur[-1].end_ms - cur[0].start_ms) * 100 < minimum * 68:
            out[-1] += cur
        else:
            out.append(cur)
    return [(c[0].start_ms, c[-1].end_ms, len(c)) for c in out]


@pytest.mark.parametrize("size", [100, 2048])
def test_chunks_match_hand_written_pass(spark, size):
    w = words_of(spark, [(1, 400), (2, 5), (3, 64), (4, 1)])
    got = Q.chunk_words(w, size=size).select("plan_id", "scene_idx", "start_ms", "end_ms", F.size("words").alias("n")).collect()
    data = w.orderBy("plan_id", "idx").collect()
    for p in (1, 2, 3, 4):
        want = chunks_by_hand([r for r in data if r.plan_id == p])
        assert [tuple(r)[2:] for r in sorted(got) if r.plan_id == p] == want


def test_uniform_words_settle_over_many_blocks(spark):
    """Words of equal length never resynchronise by themselves; the states still become exact."""
    w = spark.range(120).select(
        F.lit(1).cast("long").alias("plan_id"), F.col("id").cast("int").alias("idx"), (F.col("id") * 300).alias("start_ms"),
        (F.col("id") * 300 + 290).alias("end_ms"), F.lit("w").alias("text"),
    )
    assert rows(Q.chunk_words(w, size=32)) == rows(Q.chunk_words(w, size=2048))


def scenes_of(spark, n=40, seed=3):
    rnd, out = random.Random(seed), []
    for p in (1, 2):
        for i in range(n):
            asset = rnd.choice(["a", "b", "c", "d", None])
            kind = "blank" if asset is None else rnd.choice(["image", "video"])
            out.append((p, i, i * 1000, i * 1000 + 900, asset, kind, rnd.random() < 0.2, rnd.choice(["neutral", "tragic", "funny"])))
    return spark.createDataFrame(out, "plan_id long, scene_idx int, start_ms long, end_ms long, asset string, asset_kind string, semantic_lock boolean, tone string")


@pytest.mark.parametrize("size", [16])
def test_scene_operators_do_not_depend_on_block_size(spark, size):
    s = scenes_of(spark)
    ranges = Q.display_ranges(s, size=size)
    assert rows(ranges) == rows(Q.display_ranges(s))
    assert rows(Q.visual_spans(ranges, 5000, size)) == rows(Q.visual_spans(Q.display_ranges(s), 5000))
    assert rows(Q.repetition_runs(s, size=size)) == rows(Q.repetition_runs(s))
    assert rows(D.cover_blanks(s, size)) == rows(D.cover_blanks(s))
    assert rows(V.validate_scenes(s, size=size)) == rows(V.validate_scenes(s))
    q = s.withColumns({"query": F.coalesce("asset", F.lit("z")), "search_queries": F.array("tone", F.coalesce("asset", F.lit("z")))})
    assert rows(Q.dedupe_neighbor_queries(q, size=size)) == rows(Q.dedupe_neighbor_queries(q))


def test_cover_blanks_by_hand(spark):
    """The whole search against a direct loop over every source."""
    from beatframe.functions.rules import DARK_TONES, LIGHT_TONES

    def fits(a, b):
        if a in DARK_TONES:
            return b in (*DARK_TONES, "emotional", "mysterious", "neutral")
        return b in (*LIGHT_TONES, "neutral", "emotional") if a in LIGHT_TONES else True

    s, want = scenes_of(spark, seed=9), []
    for p in (1, 2):
        data = sorted([r for r in s.collect() if r.plan_id == p], key=lambda r: r.scene_idx)
        good, shown = [r for r in data if r.asset], {r.scene_idx: r.asset for r in data}
        for r in data:
            if r.asset:
                continue
            ok = [g for g in good if g.semantic_lock] if r.semantic_lock else [g for g in good if not g.semantic_lock and fits(r.tone, g.tone)]
            ok = ok or (good if r.semantic_lock else [])
            if not ok:
                continue
            recent = {shown[j] for j in range(max(0, r.scene_idx - 3), r.scene_idx) if shown[j]}
            pick = min([g for g in ok if g.asset not in recent] or ok, key=lambda g: (abs(g.scene_idx - r.scene_idx), g.scene_idx > r.scene_idx, g.scene_idx))
            shown[r.scene_idx] = pick.asset
            want.append((p, r.scene_idx, pick.scene_idx))
    got = D.cover_blanks(s, 16).select("plan_id", "scene_idx", "source_scene").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("size", [3, 2048])
def test_unique_assignment_in_rounds_equals_the_sequential_pass(spark, size):
    rnd, out = random.Random(5), []
    for p in (1, 2):
        for s in range(25):
            for place, c in enumerate(rnd.sample(range(15), 6), 1):
                out.append((p, s, place, c, f"u{c}", 0.1 * place))
    r = spark.createDataFrame(out, "plan_id long, scene_idx int, place int, cand_id int, url string, score double")
    want = []
    for p in (1, 2):
        used = set()
        for s in range(25):
            for row in sorted([x for x in out if x[0] == p and x[1] == s], key=lambda x: x[2]):
                if row[4] not in used:
                    used.add(row[4])
                    want.append((p, s, row[3]))
                    break
    got = K.assign_unique(r, size=size).select("plan_id", "scene_idx", "cand_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_cuts_do_not_depend_on_block_size(spark):
    w = words_of(spark, [(1, 300), (2, 40)], seed=8)
    beats = w.filter("idx % 37 = 3 or idx % 41 < 2").select("plan_id", F.col("idx").alias("start_idx"))
    assert rows(Q.normalize_cuts(beats, w, size=128)) == rows(Q.normalize_cuts(beats, w))


def test_cues_do_not_depend_on_block_size(spark):
    rnd = random.Random(2)
    c = [(1, rnd.randint(0, 9000), i, "k", rnd.choice("ab"), -1.0) for i in range(120)]
    df = spark.createDataFrame(c, "plan_id long, time_ms long, ord long, kind string, name string, gain_db double")
    assert rows(D.dedupe_cues(df, size=40)) == rows(D.dedupe_cues(df))


def test_validate_words_running_maximum_across_blocks(spark):
    w = words_of(spark, [(1, 50)])
    w = w.withColumn("start_ms", F.when(F.col("idx") % 9 == 8, F.col("start_ms") - 2000).otherwise(F.col("start_ms")))
    assert rows(V.validate_words(w, size=4)) == rows(V.validate_words(w))


def test_search_equals_scoring_every_file(spark, monkeypatch):
    """Hot tokens, several groups of queries, several partitions and ties, against a loop."""
    monkeypatch.setattr(K, "TOGETHER", 3)
    rnd = random.Random(4)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(30)]
    files = [(i, " ".join(rnd.choices(words, k=5)), rnd.choice(["the", "xx"]), rnd.choice(["video", "image"])) for i in range(150)]
    asks = [(1, "the of"), (2, "the w1 w2 w3"), (3, "w4"), (4, "nothing here"), (5, "the of w9 w8"), (6, None), (7, "xx")]
    got = K.search_library(spark.createDataFrame(asks, "query_id int, query string"), spark.createDataFrame(files, "cand_id long, name string, folders string, kind string").repartition(4), 6)
    want = []
    for q, text in asks:
        t = {w for w in (text or "").split() if len(w) > 1}
        scored = sorted((-(8.0 * len(t & set(n.split())) + 2.0 * len(t & set(f.split())) + (2.5 if kind == "video" else 0)), i) for i, n, f, kind in files)
        want += [(q, p, i, -s) for p, (s, i) in enumerate(scored[:6], 1)]
    assert sorted(map(tuple, got.collect())) == want


def test_resolution_equals_choosing_scene_by_scene(spark):
    """Five checks per scene over what earlier scenes left, against a loop in order."""
    from beatframe.plans.resolve import resolve

    rnd, pool = random.Random(11), []
    for s in range(8):
        for place, c in enumerate(rnd.sample(range(14), 9), 1):
            pool.append((1, s, place, c, f"u{c}", "t", "d", rnd.randint(0, 40) / 2.0))
    df = spark.createDataFrame(pool, "plan_id long, scene_idx int, place int, cand_id long, download_url string, title string, description string, score double")
    scenes = spark.createDataFrame([(1, s, False, "neutral", "x") for s in range(8)], "plan_id long, scene_idx int, semantic_lock boolean, tone string, scene_text string")
    guard = spark.createDataFrame([(c, 100 if c % 5 else 20, []) for c in range(14)], "cand_id long, guard_score int, issues array<string>")
    used, want = set(), []
    for s in range(8):
        seen = [r for r in pool if r[1] == s and r[3] not in used and r[3] % 5][:5]
        best = max(seen, key=lambda r: (r[7], -r[2]), default=None)
        want.append((s, best[3] if best else None))
        used.add(best[3] if best else None)
    got = resolve(scenes, {"exact": df}, guard).select("scene_idx", "cand_id").collect()
    assert sorted(map(tuple, got)) == want


def test_block_products_equal_all_pairs(spark, monkeypatch):
    """The best and pooled scores of a grid of small cells, with ties, a missing vector and a key without prompts, against every pair."""
    monkeypatch.setattr(K, "SIDE", 3)
    rnd = random.Random(9)
    vector = lambda: [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]
    prompts = [(k, p + 100 * k, vector()) for k in (0, 1) for p in range(8 - 5 * k)]
    items = [(k, i + 100 * k, i // 3, vector() if i != 4 else None) for k in (0, 1, 2) for i in range(20)]
    p = spark.createDataFrame(prompts, "scene_idx int, prompt_id long, embedding array<float>")
    i = spark.createDataFrame(items, "scene_idx int, item_id long, cand_id int, embedding array<float>")
    pairs = K.cosine_scores(p, i, ["scene_idx"]).collect()
    want = []
    for _, q, _ in prompts:
        best = sorted((r for r in pairs if r.prompt_id == q), key=lambda r: (-r.score, r.item_id))[:5]
        want += [(q, n, r.item_id, r.score) for n, r in enumerate(best, 1)]
    got = K.top_cosine(p, i, ["scene_idx"], 5).select("prompt_id", "place", "item_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    of = {(k, n): c for k, n, c, _ in items}
    groups = {}
    for r in pairs:
        groups.setdefault((r.scene_idx, r.prompt_id, of[r.scene_idx, r.item_id]), []).append(r.score)
    pooled = {(r.scene_idx, r.prompt_id, r.cand_id): r.visual for r in K.pooled_cosine(p, i, ["scene_idx"], "cand_id").collect()}
    assert pooled.keys() == groups.keys()
    assert all(pooled[k] == pytest.approx(max(v) * 0.72 + sum(v) / len(v) * 0.28) for k, v in groups.items())
    assert K.top_cosine(p.limit(0), i, ["scene_idx"], 5).count() == 0
