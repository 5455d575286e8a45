"""Choices in order with titles, manifests, and the final passes, against loops in order."""

import random

from pyspark.sql import functions as F

from beatframe.plans import finalize
from beatframe.plans.resolve import manifest, recent_titles, resolve_run

SCENE = ["plan_id", "scene_idx"]


def test_recent_titles_are_those_of_a_loop(spark):
    rnd = random.Random(2)
    titles = ["A", "a ", "B", "c", "D", "e", "F", "", None]
    rows = [(p, s, ["x", "B"] if p == 1 else [], rnd.choice(titles)) for p in range(3) for s in range(25)]
    df = spark.createDataFrame(rows, "plan_id long, scene_idx int, used_titles array<string>, title string")
    got = {(r.plan_id, r.scene_idx): r.recent for r in recent_titles(df, df, size=4).collect()}
    for p in range(3):
        used = ["x", "B"] if p == 1 else []
        for _, s, _, title in (r for r in rows if r[0] == p):
            assert got[p, s] == used[-4:]
            if title and title.strip().lower() not in [u.strip().lower() for u in used]:
                used.append(title)


def words(text):
    return set(text.lower().split())


def near(title, used):
    return max((len(words(title) & words(u)) / len(words(title) | words(u)) for u in used[-4:]), default=0.0)


def made(rnd, scenes, pool):
    library = [(c, " ".join(rnd.choices(["red", "green", "blue", "old", "new", "big"], k=3)), rnd.choice(["image", "video"])) for c in range(14)]
    cands = [(1, s, 0, "red old", n, 0, "commons", kind, title, "none", f"u{c}", 100 + 200 * (c % 6), 100, "", c) for s in range(scenes) for n, (c, title, kind) in enumerate(rnd.sample(library, pool))]
    names = "plan_id long, scene_idx int, query_idx int, query string, pos int, provider_rank int, source string, kind string, title string, description string, download_url string, width int, height int, license string, cand_id long"
    return cands, names


def plain_score(row, seen):
    title, width, height, kind = row[8], row[11], row[12], row[7]
    score = 7.0 * len({"red", "old"} & words(title)) + (2.5 if width >= 1200 else 1.0 if width >= 800 else 0.0)
    ratio = width / height
    return round(score + (3.5 if 0.45 <= ratio <= 0.8 else 1.5 if ratio <= 1.1 else 0.0) + (4.0 if kind == "image" else -1.0) - 24.0 * seen, 9)


def test_a_run_equals_choosing_scene_by_scene(spark):
    rnd = random.Random(8)
    cands, names = made(rnd, 5, 6)
    scenes = [(1, s, "image", "auto", s == 4, [], [], "", ["big red old"], "c", "neutral", "x") for s in range(5)]
    df = spark.createDataFrame(cands, names)
    s = spark.createDataFrame(scenes, "plan_id long, scene_idx int, visual_mode string, source_mode string, semantic_lock boolean, required_entities array<string>, required_context array<string>, visual_description string, used_titles array<string>, caption string, tone string, scene_text string")
    guard = spark.createDataFrame([(c, 100 if c % 5 else 20, []) for c in range(14)], "cand_id long, guard_score int, issues array<string>")
    got = {r.scene_idx: r for r in resolve_run(s, {"exact": df}, guard).collect()}
    used, titles = set(), ["big red old"]
    for i in range(5):
        own = [(r, near(r[8], titles)) for r in cands if r[1] == i and r[14] not in used and (r[7] == "image" or i != 4)]
        own = [(plain_score(r, n), r) for r, n in own if n < 0.86 or i == 4]
        own = sorted((x for x in own if x[1][14] % 5), key=lambda x: (-x[0], x[1][4]))[:5]
        best = max(own, key=lambda x: (round(x[0] + 3.5, 9), -own.index(x)), default=None)
        assert got[i].cand_id == (best[1][14] if best else None), i
        if best:
            used.add(best[1][14])
            if best[1][8] not in titles:
                titles.append(best[1][8])
        else:
            assert got[i].status == ("not_found_locked" if i == 4 else "not_found_recovery")
    result = spark.createDataFrame([(1, i, "downloaded" if i % 3 else "not_found_recovery", "exact" if i % 3 else None, i if i % 3 else None, f"u{i}" if i % 3 else None, "t" if i % 3 else None, 1.0, 1) for i in range(5)], "plan_id long, scene_idx int, status string, level string, cand_id long, download_url string, title string, combined double, checks int")
    facts = df.select(*SCENE, (F.col("scene_idx")).cast("long").alias("cand_id"), "source", "kind")
    rows = {r.scene_idx: r for r in manifest(s, result, facts).collect()}
    assert rows[3].status == "fallback_recovery_no_blank" and rows[3].fallback_from_scene == 2 and rows[3].path == "u2"
    assert rows[1].status == "downloaded" and rows[1].fallback_from_scene is None and not rows[1].recovery_used
    assert {r.scene_idx for r in manifest(s, result, facts, reuse=False).filter("path is null").collect()} == {0, 3}


def test_final_passes_end_each_plan_for_itself(spark):
    names = "plan_id long, scene_idx int, strict boolean, action_first boolean, asset string, asset_kind string, query string, caption string, visual_description string, search_queries array<string>, semantic_lock boolean, visual_mode string, source_mode string, motion_preset string, tone string"
    plans = {  # strict, action_first, assets
        1: (False, False, ["a", "A", "b"]), 2: (False, False, ["a", None, "b"]), 3: (True, True, ["a", None, None]), 4: (True, False, ["a", "a", "b"]),
        5: (True, False, [None, "x"]), 6: (None, None, ["a", "b"]), 7: (True, False, ["p", "q"]),
    }
    rows = [(p, i, s, f, a, "blank" if a is None else "image", "q", "cap", "desc", ["q"], False, "image", "generic_image", "none", "neutral") for p, (s, f, assets) in plans.items() for i, a in enumerate(assets)]
    steps = []

    def search(todo, step):
        asked = sorted((r.plan_id, r.scene_idx, r.visual_mode) for r in todo.collect())
        steps.append((step.name, step.offset, step.judged, asked))
        found = {"anti_repeat": "new", "video": None, "cross_media": None, "local": None, "duplicates": "a"}[step.name]
        rows = [(p, i, found, "image") for p, i, _ in asked if found]
        if step.name == "video":
            rows = [(3, 1, "v1", "video")]
        if step.name == "local":
            rows = [(3, 2, "l2", "image")]
        return spark.createDataFrame(rows, "plan_id long, scene_idx int, asset string, asset_kind string")

    final = finalize.finalize(spark.createDataFrame(rows, names), search)
    got = {(r.plan_id, r.scene_idx): (r.asset, r.problem) for r in final.collect()}
    assert got[1, 1] == ("new", None) and got[2, 1][0] in ("a", "b") and got[2, 1][1] in (None, "duplicate") or got[2, 1] == ("new", None)
    assert got[3, 1] == ("v1", None) and got[3, 2] == ("l2", None)
    assert got[4, 1] == ("a", "duplicate") and got[5, 0] == (None, "unresolved") and got[7, 0] == ("p", None)
    assert [s[:3] for s in steps] == [("anti_repeat", 4, True), ("video", 0, False), ("cross_media", 0, True), ("local", 0, False), ("duplicates", 0, True), ("duplicates", 0, False)]
    assert steps[1][3] == [(3, 1, "video"), (3, 2, "video")] and [x[:2] for x in steps[2][3]] == [(3, 2), (5, 0)]
    ends = {r.plan_id: (r.accepted, r.unresolved, r.duplicates) for r in finalize.verdicts(final).collect()}
    assert ends[3] == (True, 0, 0) and ends[4] == (False, 0, 1) and ends[5] == (False, 1, 0) and ends[1][0] and ends[6] == (True, 0, 0)
    assert finalize.verdicts(finalize.finalize(spark.createDataFrame([], names), search)).count() == 0
