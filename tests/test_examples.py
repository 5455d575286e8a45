"""Small worked examples of the operators, with exact rows."""

import pytest
from pyspark.sql import functions as F

from beatframe.functions import classify as C, media as M, text as T
from beatframe.operators import cues as O, dedup as D, expand as E, quality as G, rank as K, sequence as Q


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def lit(s):
    return F.lit(s)


def cards(spark, words, end=2000, caption=None):
    ws = [(int(a * 1000), int(b * 1000), t) for a, b, t in words]
    text = caption or " ".join(t for _, _, t in words)
    df = spark.createDataFrame([(1, 0, 0, end, text, ws)], "plan_id long, scene_idx int, start_ms long, end_ms long, caption string, caption_words array<struct<start_ms:long,end_ms:long,text:string>>")
    return [(r.start_ms, r.end_ms, r.text) for r in Q.caption_pages(df).orderBy("page").collect()]


def test_caption_cards(spark):
    assert cards(spark, [(0, 0.2, "Собака"), (0.2, 1.5, "внезапно"), (1.5, 2, "уснула.")]) == [(0, 200, "Собака"), (200, 1500, "внезапно"), (1500, 2000, "уснула.")]
    assert cards(spark, [(0, 0.1, "И"), (0.1, 0.5, "собака"), (1, 1.1, "в"), (1.5, 2, "комнате")]) == [(0, 500, "И собака"), (1000, 1100, "в"), (1500, 2000, "комнате")]
    assert cards(spark, [(0, 0.6, "Собака"), (0.5, 1, "внезапно")]) == [(0, 500, "Собака"), (500, 1000, "внезапно")]


@pytest.mark.parametrize(
    "bad",
    [
        [(0, 0.2, "Собака")], [(0, 0.2, "Кошка"), (0.2, 1, "спит")], [(0.5, 0.2, "Собака"), (0.5, 1, "спит")], [(0, 0.2, "Собака"), (0, 1, "спит")],
        [(-1, 0.2, "Собака"), (0.2, 1, "спит")], [(0, 0.2, "Собака"), (0.2, 3, "спит")], [(0, 0.2, "Собака"), (2, 2.0005, "спит")],
    ],
)
def test_bad_timings_fall_back_to_text_length(spark, bad):
    assert cards(spark, bad, caption="Собака спит") == cards(spark, [(9, 9, "x")], caption="Собака спит")


def test_tones(spark):
    assert one(spark, C.infer_tone(lit("восстание унесло до 30 миллионов жизней"))) == "tragic"
    assert one(spark, C.infer_tone(lit("от стресса он начал паниковать"))) == "tense"
    assert one(spark, C.infer_tone(lit("обычный день"))) == "neutral"


def test_repeat_penalty(spark):
    assert one(spark, K.repeat_penalty(lit("red old car on road now"), T.strings("red old car on road"))) == pytest.approx(20.0)
    assert one(spark, K.repeat_penalty(lit("aa bb cc dd ee"), T.strings("aa bb cc dd ff"))) == pytest.approx(16.0)


def test_library_search(spark):
    q = spark.createDataFrame([(1, "surprised reaction")], "query_id int, query string")
    lib = spark.createDataFrame([(1, "sad_face", "memes", "video"), (2, "surprised_reaction", "memes", "video"), (3, "other", "surprised", "image")], "cand_id long, name string, folders string, kind string")
    assert [(r.cand_id, r.score) for r in K.search_library(q, lib, 3).orderBy("place").collect()] == [(2, 18.5), (1, 2.5), (3, 2.0)]


def test_variants(spark):
    files = [("hd", 1080, 1920), ("small", 360, 640), ("medium", 720, 1280)]
    df = spark.createDataFrame([(files,)], "f array<struct<link:string,width:int,height:int>>")
    assert df.select(K.smallest_variant(F.col("f"), "link")["link"], K.pick_pexels_file(F.col("f"))["link"]).first() == ("small", "hd")
    files = [("large", 1920, 1080), ("medium", 1280, 720), ("small", 640, 360), ("tiny", 320, 180)]
    df = spark.createDataFrame([(files,)], "f array<struct<url:string,width:int,height:int>>")
    assert df.select(K.smallest_variant(F.col("f"), "url")["url"], K.pick_pixabay_variant(F.col("f"))["url"]).first() == ("tiny", "large")


def test_cues_and_mood(spark):
    from beatframe.operators.report import plan_mood

    s = spark.createDataFrame([(1, 0, 0, 2000, "Я провалил экзамен"), (1, 1, 2000, 4000, "Но вдруг всё изменилось")], "plan_id long, scene_idx int, start_ms long, end_ms long, caption string")
    assert [(r.name, r.time_ms) for r in O.audio_cues(s).orderBy("ord").collect()] == [("whoosh", 2000), ("impact", 2000)]
    assert plan_mood(s).first().mood == "sad"


def shots(spark, rows):
    return spark.createDataFrame(
        [(1, i, int(a * 1000), int(b * 1000), asset, "blank" if asset is None else "image", lock, "neutral") for i, (a, b, asset, lock) in enumerate(rows)],
        "plan_id long, scene_idx int, start_ms long, end_ms long, asset string, asset_kind string, semantic_lock boolean, tone string",
    )


def test_repetition_and_spans(spark):
    same = shots(spark, [(0, 1.5, "a", False), (1.5, 3, "a", False), (3, 4.5, "a", False)])
    assert [r.scene_idx for r in Q.repetition_runs(same).orderBy("scene_idx").collect()] == [1, 2]
    mixed = shots(spark, [(0, 1.5, "a", False), (1.5, 3, "a", False), (3, 4.5, "b", False)])
    assert Q.visual_spans(Q.display_ranges(mixed)).count() == 3
    assert Q.visual_spans(Q.display_ranges(mixed), 3000).count() == 2


def test_duplicates(spark):
    def found(paths):
        df = spark.createDataFrame([(1, i, p, "image", None, None) for i, p in enumerate(paths)], "plan_id long, scene_idx int, asset string, asset_kind string, digest string, ahash array<long>")
        return [(r.scene_idx, r.original_scene, r.reason) for r in D.duplicate_scenes(df).orderBy("scene_idx").collect()]

    assert found(["a", "a", "a"]) == [(1, 0, "same_path"), (2, 0, "same_path")]
    assert found(["a", "a", "b"]) == [(1, 0, "same_path")]


def test_hash_similarity(spark):
    full = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    assert one(spark, M.hash_similarity(full(0, 0, 0, 0), full(1, 0, 0, 0))) > 0.99
    assert one(spark, M.hash_similarity(full(0, 0, 0, 0), full(-1, 65535, 0, 0))) == 0.6875


def test_cover_blanks(spark):
    s = shots(spark, [(0, 1, None, False), (1, 2, None, False), (2, 3, None, False), (3, 4, "a", False)])
    assert [(r.scene_idx, r.source_scene) for r in D.cover_blanks(s).orderBy("scene_idx").collect()] == [(0, 3), (1, 3), (2, 3)]
    s = shots(spark, [(0, 1, "a", False), (1, 2, "b", False), (2, 3, "a", False), (3, 4, None, False)])
    assert [(r.scene_idx, r.source_scene) for r in D.cover_blanks(s).collect()] == [(3, 2)]


def test_locked_blank_takes_the_scene_of_its_context(spark):
    rows = [(1, 0, "near", "image", False, "neutral", [], [], "street"), (1, 1, None, "blank", True, "neutral", ["Hong Xiuquan"], ["China"], "x"), (1, 2, "c", "image", False, "neutral", [], [], "old China town")]
    s = spark.createDataFrame(rows, "plan_id long, scene_idx int, asset string, asset_kind string, semantic_lock boolean, tone string, required_entities array<string>, required_context array<string>, caption string")
    assert D.cover_blanks(s).first().source_scene == 2


def test_metadata_conflict(spark):
    scene = lit("World War I trench")
    assert one(spark, C.metadata_conflict(F.lit(True), scene, lit("Crimean War battery"))) == "wrong event/war in candidate metadata"
    assert one(spark, C.metadata_conflict(F.lit(True), scene, lit("World War I soldiers"))) is None
    assert one(spark, C.metadata_conflict(F.lit(False), scene, lit("Crimean War battery"))) is None


def test_usage(spark):
    log = [(1, 1, "register", 0, "u", "T"), (1, 2, "register", 1, "u", " t "), (1, 3, "release", 0, "", ""), (1, 4, "register", 2, "v", " ")]
    urls, titles = D.material_usage(spark.createDataFrame(log, "plan_id long, seq long, op string, scene_idx int, url string, title string"))
    assert sorted((r.url, r.uses) for r in urls.collect()) == [("u", 1), ("v", 1)]
    assert [(r.title, r.uses) for r in titles.collect()] == [("t", 1)]


def scene(spark, caption, **over):
    base = dict(
        plan_id=1, scene_idx=0, start_ms=0, end_ms=2000, caption=caption, query="q", search_queries=["q"], visual_description="d", visual_mode="image", source_mode="generic_image",
        motion_preset="slow_push", semantic_lock=False, required_entities=[], required_context=[], semantic_fallback=None, tone="neutral",
    )
    base.update(over)
    types = "plan_id long, scene_idx int, start_ms long, end_ms long, caption string, query string, search_queries array<string>, visual_description string, visual_mode string, source_mode string, motion_preset string, semantic_lock boolean, required_entities array<string>, required_context array<string>, semantic_fallback string, tone string"
    return spark.createDataFrame([tuple(base.values())], types)


def test_style(spark):
    r = E.video_first_style(scene(spark, "Он резко проснулся от сна", query="", visual_description="")).first()
    assert (r.visual_mode, r.source_mode, r.query) == ("video", "stock_video", "man waking up suddenly in bed")
    r = E.video_first_style(scene(spark, "x", semantic_lock=True)).first()
    assert (r.visual_mode, r.source_mode, r.motion_preset) == ("image", "historical_archive", "micro_push")


def test_action_first_is_idempotent_and_follows_the_caption(spark):
    s = scene(spark, "Цена выросла, а упаковка стала меньше", query="price concept", search_queries=["price concept", "taking milk"])
    a = E.action_first(s)
    r = a.first()
    assert r.search_queries[:4] == ["customer checking price tag", "hand comparing grocery prices", "shopper looking at receipt", "hands holding product package"]
    b = E.action_first(a).first()
    assert (b.visual_description, b.search_queries[:6]) == (r.visual_description, r.search_queries[:6])


def test_direction(spark):
    s = scene(spark, "Солдаты идут", query="soldiers marching", search_queries=["soldiers marching army", "b", "c"])
    reply = spark.createDataFrame(
        [(1, 0, "video", "auto", "pull_back", "view in Qing China of men", ["army troops", "Army  Troops", "kitten"], "", [])],
        "plan_id long, scene_idx int, visual_mode string, source_mode string, motion_preset string, visual_description string, search_queries array<string>, meme_filename string, meme_tags array<string>",
    )
    r = E.apply_direction(s, reply).first()
    assert (r.visual_mode, r.source_mode, r.motion_preset, r.directed) == ("image", "historical_archive", "pull_back", True)
    assert r.search_queries == ["historical rebel army engraving", "peasant soldiers historical illustration", "historical troops marching engraving", "soldiers marching army", "b"]


def test_quality_and_checks(spark):
    s = spark.createDataFrame([(1, 0, 0, 2000, None, "blank", None, "c", None, None), (1, 1, 2000, 4000, "a.jpg", "image", "face", "c", 0.3, 5.0), (1, 2, 4000, 4500, "a.jpg", "image", None, "", 0.1, 0.5)],
        "plan_id long, scene_idx int, start_ms long, end_ms long, asset string, asset_kind string, focus_source string, caption string, semantic_score double, asset_score double")
    got = {r.scene_idx: (r.ok, r.score) for r in G.inspect_scenes(s).collect()}
    assert got == {0: (False, 0.25), 1: (True, 1.0), 2: (False, 0.0)}
    m = spark.createDataFrame([("image", "Old poster", "", 600, 300)], "kind string, title string, description string, width int, height int")
    r = G.quality_guard(m).first()
    assert (r.guard_score, r.issues, r.accept) == (23, ["metadata:poster", "low_resolution", "extreme_aspect_or_tiny_short_edge"], False)


def test_effects_are_spaced_grounded_and_unique(spark):
    ws = [(0, 300, "выпил"), (300, 700, "930"), (700, 1000, "мл")]
    s = spark.createDataFrame(
        [(1, i, i * 1000, i * 1000 + 1000, "выпил 930 мл молока", [(a + i * 1000, b + i * 1000, t) for a, b, t in ws], "q", ["q"], []) for i in range(3)],
        "plan_id long, scene_idx int, start_ms long, end_ms long, caption string, caption_words array<struct<start_ms:long,end_ms:long,text:string>>, query string, search_queries array<string>, required_entities array<string>",
    )
    local = O.local_effects(s)
    assert [(r.scene_idx, r.type, r.query, r.label) for r in local.orderBy("scene_idx").collect()] == [(0, "png_text", "milk carton", "930 мл"), (1, "png", "milk carton", "")]
    empty = spark.createDataFrame([], "plan_id long, scene_idx int, type string, query string, anchor string, label string, position string, animation string, size string, duration_ms int, asset string")
    merged = O.merge_effect_sources(empty, empty, local, s)
    got = O.accept_effects(merged, s).collect()
    assert [(r.scene_idx, r.type, r.label, r.start_ms, r.end_ms) for r in got] == [(0, "png_text", "930 мл", 275, 2025)]
    more = O.fill_density(spark.createDataFrame(got), s, spark.createDataFrame([("milk carton",)], "query string")).collect()
    assert [(r.scene_idx, r.type, r.label, r.start_ms) for r in more] == [(1, "text", "930 мл", 1120)]
