"""Files and streams: what is written can be read back."""

import json

from pyspark.sql import functions as F

from beatframe.functions import text as T
from beatframe.operators import cues as O, dedup as D, quality as G, sequence as Q
from beatframe.sources import readers as S, writers as W
from beatframe.streaming import usage
from beatframe.views import Views


def test_transcripts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = {"language": "ru", "words": [{"start": 0, "end": 0.5, "text": " Да "}, {"start": 0.5, "end": 1, "text": "  "}, {"start": 1.25, "end": 2, "text": "нет."}]}
    (tmp_path / "in" / "clip.json").write_text(json.dumps(doc, ensure_ascii=False))
    w = S.read_transcripts(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in w.orderBy("idx").collect()] == [("clip", "ru", 0, 0, 500, "Да"), ("clip", "ru", 1, 1250, 2000, "нет.")]
    W.write_transcripts(w, str(tmp_path / "out"))
    r = spark.read.json(str(tmp_path / "out")).first()
    assert (r.duration, r.text, r.words[1].start) == (2.0, "Да нет.", 1.25)


def test_plans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    scene = {"start": 0, "end": 1.5, "query": "q", "asset": "media/a.jpg", "asset_kind": "image", "required_entities": [" X ", ""], "focus_x": 0.25}
    (tmp_path / "in" / "p1.json").write_text(json.dumps({"audio": "a.wav", "scenes": [scene, {"start": 1.5, "end": 2.0}]}))
    scenes, plans = S.read_plans(spark, str(tmp_path / "in"))
    a, b = scenes.orderBy("scene_idx").collect()
    assert a.asset == str(tmp_path / "in" / "media/a.jpg") and a.required_entities == ["X"] and a.end_ms == 1500 and a.caption_words == []
    assert (b.motion_preset, b.tone, b.visual_mode, b.semantic_lock) == ("slow_push", "neutral", "auto", False)
    assert tuple(plans.first())[2:5] == (1080, 1920, 30)
    W.write_plans(scenes, plans, str(tmp_path / "out"), base=str(tmp_path / "in"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert (back.scenes[0].asset, back.scenes[0].focus_x, back.scenes[1].start) == ("media/a.jpg", 0.25, 1.5)


def test_media_library(spark, tmp_path):
    for name in ("memes/funny_cat.mp4", "memes/x.txt", "b.PNG"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    f = S.scan_media_library(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.file_name, r.name, r.kind) for r in f] == [("b.PNG", "b", "image"), ("funny_cat.mp4", "funny_cat", "video")]
    assert "memes" in f[1].folders.split()
    digests = D.media_digest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)))
    assert digests.count() == 3 and all(len(r.digest) == 64 for r in digests.collect())


def test_reports_and_subtitles(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    pages = Q.caption_pages(v.scenes(), words=None)
    lines = W.subtitle_lines(pages)
    W.write_subtitles(lines, str(tmp_path / "ass"))
    out = spark.read.text(str(tmp_path / "ass"), wholetext=True)
    plans = v.scenes().select("plan_id").distinct().count()
    assert out.count() == plans
    text = out.filter("plan_id = 0").first().value
    assert "Impact,127," in text and ",50,50,768,1" in text
    assert text.count("Dialogue: 0,") == pages.filter("plan_id = 0").count()
    cues = O.audio_cues(v.scenes())
    W.write_cues(cues, v.scenes().select("plan_id").distinct().withColumn("mood", F.lit("neutral")), str(tmp_path / "cues"))
    assert spark.read.json(str(tmp_path / "cues")).count() == plans
    W.write_qc(G.inspect_scenes(v.shots()), str(tmp_path / "qc"))
    assert spark.read.json(str(tmp_path / "qc")).count() == v.shots().select("plan_id").distinct().count()
    W.write_rows(v.shots(), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == v.shots().count()


def test_overlay_lines(spark):
    pages = spark.createDataFrame([(1, 0, 0, 0, 200, "hi {x}")], "plan_id long, scene_idx int, page int, start_ms long, end_ms long, text string")
    o = spark.createDataFrame([(1, 0, "text", "930 мл", "center", "pop", "hero", 1000, 2000), (1, 1, "png", "a", "left", "fly", "large", 3000, 4000)], "plan_id long, scene_idx int, type string, label string, position string, animation string, size string, start_ms long, end_ms long")
    got = [r.line for r in W.subtitle_lines(pages, o).orderBy("layer").collect()]
    assert got[0].startswith("Dialogue: 0,0:00:00.00,0:00:00.20,Default") and got[0].endswith("hi (x)")
    assert got[1].startswith("Dialogue: 2,0:00:03.00") and "\\pos(270,537)\\fs79" in got[1]
    assert got[2].startswith("Dialogue: 3,0:00:01.00") and "\\an5\\pos(540,307)\\fs135\\bord10\\shad0\\fscx76\\fscy76" in got[2]


def test_full_entity_table(spark):
    df = spark.createDataFrame([("<b>caf&eacute;</b> &amp;&copy;",)], "t string")
    assert df.select(T.clean_html(F.col("t"), full_entities=True)).first()[0] == "café  &©"


def test_stream_equals_batch(spark, tmp_path):
    """Usage from the event stream in several batches equals the batch operator."""
    log = Views(spark, "/root/testdata/sf0.001").registry_log().orderBy("seq")
    n = log.count()
    for part in range(3):
        log.filter((F.col("seq") >= part * n / 3) & (F.col("seq") < (part + 1) * n / 3)).coalesce(1).write.parquet(str(tmp_path / "log" / f"p{part}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "p*"))
    q = usage.usage_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = usage.live_usage(spark.read.parquet(str(tmp_path / "out")))
    urls, _ = D.material_usage(log)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, urls.collect()))


def test_plans_of_equal_file_names_stay_apart(spark, tmp_path):
    for folder, word in (("a", "one"), ("b/c", "two")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "transcript.json").write_text(json.dumps({"words": [{"start": 0, "end": 1, "text": word}]}))
        (tmp_path / folder / "shot_plan.json").write_text(json.dumps({"scenes": [{"start": 0, "end": 1, "query": word}]}))
    words = S.read_transcripts(spark, str(tmp_path)).filter("text is not null")
    assert {(r.plan_id, r.text) for r in words.collect()} == {("a/transcript", "one"), ("b/c/transcript", "two")}
    scenes, _ = S.read_plans(spark, str(tmp_path))
    assert {(r.plan_id, r.query) for r in scenes.filter("query <> ''").collect()} == {("a/shot_plan", "one"), ("b/c/shot_plan", "two")}
    own = S.read_transcripts(spark, str(tmp_path), F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1))
    assert {r.plan_id for r in own.collect()} == {"a", "c"}


def test_late_events_do_not_override(spark, tmp_path):
    kind = "plan_id string, seq long, op string, scene_idx int, url string, title string"
    log = [("p", 5, "register", 0, "new", "t"), ("p", 1, "register", 1, "x", "t"), ("p", 2, "register", 0, "old", "t"), ("p", 9, "release", 1, "x", "t"), ("p", 8, "register", 1, "y", "t"), ("q", 3, "register", 0, "z", "t")]
    for i, row in enumerate(log):
        spark.createDataFrame([row], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = usage.usage_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = usage.live_usage(spark.read.parquet(str(tmp_path / "out")))
    urls, _ = D.material_usage(spark.createDataFrame(log, kind))
    assert {tuple(r) for r in live.select("plan_id", "url", "uses").collect()} == {tuple(r) for r in urls.select("plan_id", "url", "uses").collect()} == {("p", "new", 1), ("q", "z", 1)}
