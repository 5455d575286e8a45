"""Registered queries: every operator over the whole driver tables.

Texts of the driver are invented syllables, so the default word lists seldom hit.
Where an operator needs hits, ``planted`` puts one phrase of a list in front of
each caption (chosen by its turn), or a lexicon of common syllables is passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import classify as C, media as M, text as T
from ..operators import blocks as B, cues as O, dedup as D, expand as E, quality as G, rank as K, report as A, sequence as Q, validate as V
from ..sources import writers as W
from ..views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLAN = ["plan_id"]
SCENE = ["plan_id", "scene_idx"]


def query(fn: Callable[[Views], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


# Lexicons of syllables that occur in the driver's texts.
TONE_RULES = (
    ("tragic", ("thth",)), ("violent", ("erhe",)), ("funny", ("schen",)), ("positive", ("eaueau", "ciónc")), ("informational", ("whan", "thou")),
)
MOOD_RULES = (("dark", ("schsch", "ththth")), ("sad", ("eaueau",)), ("energetic", ("ionion", "thwh")))
MEME = ("thth", "schen")
VIDEO = ("erhe", "lach")
HISTORY = ("edan", "ionc")
PULLBACK = ("ninn", "eaueau")
DRAMATIC = ("onon", "ungen")
ROLES = {
    "casualty": ("thth",), "battle": ("erhe",), "army": ("schen", "lach"), "awaken": ("ionion",), "religious": ("whan", "eau"),
    "belief": ("thou", "ment"), "dream": ("enen", "onon"), "reaction": ("ing", "ung"),
}
CUES = (
    (None, 0, "transition", "whoosh", -12.0), ("(thth|erhe)", 0, "impact", "impact", -7.0), ("(schen|lach)", 80, "ui", "notification", -10.0),
    ("(eaueau|onon)", 0, "impact", "bass_hit", -6.0), ("(ionion|whan)", 100, "accent", "cash_pop", -12.0),
)
NUMBER = r"\b\d+(?:[.,]\d+)?\b"

# Phrases with hits of the default word lists.
PHRASES = (
    "Хун Сю провалил экзамен в Китае", "Тайпин: восстание унесло до 30 миллионов жизней", "Вдруг он проснулся от сна", "First World War soldiers 1914",
    "он считал себя братом Иисуса", "Телефон и деньги", "битва при Qing dynasty в 1850", "от стресса он начал паниковать", "Imperial German army in xx century",
    "почему цена 930 мл молока 15,5 %", "",
)


def planted(v: Views) -> DataFrame:
    pick = F.element_at(T.strings(*PHRASES), ((F.col("plan_id") + F.col("scene_idx")) % len(PHRASES) + 1).cast("int"))
    return v.scenes().withColumn("caption", F.concat_ws(" ", pick, "caption"))


def joined(col: Column | str, sep: str = "|") -> Column:
    return F.array_join(col, sep)


# --- validation ---------------------------------------------------------------


@query
def words_valid(v: Views) -> DataFrame:
    w = v.words()
    broken = w.withColumn("start_ms", F.when(F.col("idx") % 17 == 5, F.col("start_ms") - 900).otherwise(F.col("start_ms")))
    broken = broken.withColumn("end_ms", F.when(F.col("idx") % 23 == 7, F.col("start_ms")).otherwise(F.col("end_ms")))
    return V.validate_words(broken)


@query
def scenes_valid(v: Views) -> DataFrame:
    i = F.col("scene_idx")
    s = v.shots().withColumns(
        {
            "end_ms": F.when(i % 13 == 4, F.col("end_ms") + 1200).when(i % 29 == 3, F.col("start_ms")).otherwise(F.col("end_ms")),
            "asset_kind": F.when(F.col("asset").isNull() & (i % 2 == 0), "image").otherwise(F.col("asset_kind")),
            "visual_mode": F.when(i % 9 == 0, "hologram").otherwise("video"),
            "source_mode": F.when(i % 11 == 0, "attic").otherwise("auto"),
            "motion_preset": F.when(i % 7 == 0, "spin").otherwise("none"),
            "required_entities": F.array().cast("array<string>"), "required_context": F.array().cast("array<string>"),
            "semantic_fallback": F.when(i % 2 == 0, "text"), "focus_x": i % 12 / 10.0,
        }
    )
    return V.validate_scenes(s)


@query
def judge_gate(v: Views) -> DataFrame:
    j = v.judgements().withColumns(
        {
            "semantic_lock": F.col("cand_id") % 11 == 0, "mismatch": F.when(F.col("hard_flag"), "wrong war").otherwise("none"),
            "tone": F.when(F.col("cand_id") % 5 == 1, "tragic").otherwise("neutral"),
        }
    )
    g = V.gate_judgements(j)
    hard = V.hard_reject(*[F.col(c) for c in ("tone", "semantic_lock", "accept", "score", "tone_match", "quality_score", "mismatch")])
    return g.select("cand_id", "score", "accept", "mismatch", "reason", hard.alias("hard"))


@query
def beats_sanitized(v: Views) -> DataFrame:
    """Beat replies: one per turn, with broken, clamped and repeated starts."""
    s, i = v.turns(), F.col("turn")
    start = F.when(i % 7 == 3, F.lit("x1")).when(i % 7 == 5, (F.col("idx0") - 1000000).cast("string")).otherwise((F.col("idx0") - F.col("idx0") % 40).cast("string"))
    end = F.when(i % 5 == 2, F.lit(None).cast("string")).otherwise((F.col("idx0") + F.col("n") * 3).cast("string"))
    b = s.select("plan_id", i.alias("reply_pos"), start.alias("start_idx"), end.alias("end_idx"))
    return V.sanitize_beats(b, v.words())


@query
def roll_choices(v: Views) -> DataFrame:
    """Choices of a reply over scenes: unknown candidates, repeats and out-of-range fits."""
    e = v.table("events")
    c = e.select(
        F.col("user_id").alias("plan_id"), (F.col("event_id") % 7).cast("int").alias("scene_idx"), F.col("event_id").alias("reply_pos"),
        (F.floor("value").cast("bigint") % 5).cast("string").alias("candidate"), (F.col("value") * 3 - 20).alias("fit"), F.col("event_type").alias("reason"),
    )
    known = e.select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 5).cast("int").alias("scene_idx"), (F.col("event_id") % 4).cast("int").alias("candidate")).distinct()
    out = V.sanitize_roll_choices(c, known)
    return out.select("plan_id", "scene_idx", "candidate", "fit", "reason", "reply_pos")


@query
def top_choices(v: Views) -> DataFrame:
    e = v.table("events")
    c = e.select(
        F.col("user_id").alias("plan_id"), (F.col("event_id") % 3).cast("int").alias("scene_idx"), F.col("event_id").alias("reply_pos"),
        (F.floor("value").cast("bigint") % 11).cast("string").alias("candidate"), (F.col("value") * 3 - 20).alias("fit"), F.col("event_type").alias("reason"),
    )
    known = e.select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 3).cast("int").alias("scene_idx"), (F.col("event_id") % 9).cast("int").alias("candidate")).distinct()
    return V.sanitize_choices(c, known).select("plan_id", "scene_idx", "candidate", "fit", "place")


@query
def queries_sanitized(v: Views) -> DataFrame:
    """Lines of each document as proposed queries."""
    d = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("reply_pos", "query"))
    return V.sanitize_queries(d, ["doc_id"], banned=("the", "schen", "eaux"))


@query
def durations_checked(v: Views) -> DataFrame:
    s = v.scenes()
    want = s.select(*SCENE, (F.col("end_ms") - F.col("start_ms")).alias("expected_ms"))
    got = s.select(*SCENE, F.when(F.col("scene_idx") % 4 == 1, 0).otherwise(F.col("end_ms") - F.col("start_ms") + F.col("start_ms") % 400).cast("bigint").alias("actual_ms"))
    return V.check_durations(want, got, SCENE)


@query
def reply_json(v: Views) -> DataFrame:
    """JSON found in replies: fenced, wrapped in prose, plain, or broken."""
    body = F.to_json(F.struct("turn", "role"))
    k = F.col("turn") % 4
    fence = F.lit("```")
    text = (
        F.when(k == 0, F.concat(fence, F.lit("json\n"), body, F.lit("\n"), fence))
        .when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done.")))
        .when(k == 2, body)
        .otherwise(F.concat(F.lit("no json {"), F.col("role"), F.lit("}")))
    )
    j = V.extract_json(text)
    return v.table("conversations").select(
        "conv_id", "turn", F.get_json_object(j, "$.turn").cast("bigint").alias("reply_turn"), F.get_json_object(j, "$.role").alias("reply_role")
    )


# --- segmentation -------------------------------------------------------------


@query
def scene_chunks(v: Views) -> DataFrame:
    return Q.chunk_words(v.words()).select(*SCENE, "start_ms", "end_ms", F.size("words").alias("n_words"))


def captions(v: Views) -> DataFrame:
    c = Q.chunk_words(v.words())
    return c.select(*SCENE, "start_ms", "end_ms", T.join_words(F.transform("words", lambda w: w["text"])).alias("caption"))


@query
def caption_text(v: Views) -> DataFrame:
    return captions(v).select(*SCENE, "caption")


@query
def tone_counts(v: Views) -> DataFrame:
    s = captions(v).withColumn("tone", C.infer_tone(F.col("caption"), TONE_RULES))
    return A.tone_counts(s)


@query
def nearest_words(v: Views) -> DataFrame:
    """Per turn: the word nearest to the middle of the turn, within the turn."""
    t = v.turns()
    asks = t.select(
        "plan_id", F.col("turn").alias("ask_id"), (F.col("t0") + F.floor(F.col("total") / 2)).alias("target_ms"),
        (F.col("idx0") + 1).cast("int").alias("low"), (F.col("idx0") + F.col("n") - 1).cast("int").alias("high"),
    )
    return Q.nearest_word(asks, v.words())


@query
def asof_beat(v: Views) -> DataFrame:
    """The last view before each purchase of a user; the first view when none came before."""
    e = v.table("events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    cuts = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("cut"), F.col("ms").alias("cut_idx"))
    views = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("plan_id"), F.col("ms").alias("start_idx")).agg(F.min("event_id").alias("view_id"))
    return Q.asof_beat(cuts, views, bucket=86_400_000).select("plan_id", "cut", F.col("beat.view_id").alias("view_id"))


@query
def cuts_normalized(v: Views) -> DataFrame:
    """Cuts proposed at sentence ends only, so close cuts are dropped and long gaps split."""
    beats = v.words().filter(F.col("text").rlike("[.!?]$")).select("plan_id", F.col("idx").alias("start_idx"))
    return Q.normalize_cuts(beats, v.words())


@query
def word_containment(v: Views) -> DataFrame:
    hit = Q.contained_words(v.scenes(), v.words())
    return hit.select(*SCENE, F.size("words").alias("n_words"), F.element_at("words", 1)["idx"].alias("first_idx"))


@query
def timings_attached(v: Views) -> DataFrame:
    """Plans whose captions all match the transcript; every ninth plan has a foreign caption."""
    s = v.scenes().withColumn("caption", F.when((F.col("plan_id") % 9 == 4) & (F.col("scene_idx") == 1), "other words").otherwise(F.col("caption")))
    out = Q.attach_word_timings(s, v.words())
    return out.select(*SCENE, "timing", F.coalesce(F.size("caption_words"), F.lit(0)).alias("n_words"))


@query
def display_ranges(v: Views) -> DataFrame:
    return Q.display_ranges(v.shots()).select(*SCENE, "show_ms", "hide_ms")


@query
def visual_spans(v: Views) -> DataFrame:
    return Q.visual_spans(Q.display_ranges(v.shots()), longest=6000)


@query
def repetition_runs(v: Views) -> DataFrame:
    return Q.repetition_runs(v.shots())


def with_words(v: Views) -> DataFrame:
    s = v.scenes()
    return s.join(Q.contained_words(s, v.words()), SCENE).withColumnRenamed("words", "caption_words")


@query
def caption_pages(v: Views) -> DataFrame:
    return Q.caption_pages(with_words(v)).select(*SCENE, "page", "start_ms", "end_ms", "text")


@query
def caption_pages_weighted(v: Views) -> DataFrame:
    return Q.caption_pages(v.scenes(), words=None).select(*SCENE, "page", "start_ms", "end_ms", "text")


@query
def transcript_records(v: Views) -> DataFrame:
    """Whole transcripts as they are written, words as counts and bounds."""
    r = W.transcript_records(v.words())
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    return r.select("plan_id", "duration", "text", F.size("words").alias("words"), first["start"].alias("first_start"), last["text"].alias("last_word"))


@query
def subtitle_lines(v: Views) -> DataFrame:
    """Dialogue lines of the caption cards."""
    return W.subtitle_lines(Q.caption_pages(with_words(v))).select("plan_id", "start_ms", F.col("ord.scene").cast("int").alias("scene_idx"), F.col("ord.page").alias("page"), "line")


@query
def neighbor_queries(v: Views) -> DataFrame:
    """Scenes ask for the first word class of their caption; repeats move to an alternative."""
    first = F.array_sort(F.array_distinct(F.transform(T.tokens(F.col("caption")), lambda t: F.substring(t, 1, 2))))
    s = v.scenes().withColumn("search_queries", F.slice(F.filter(first, lambda t: F.length(t) > 1), 1, 5))
    s = s.withColumn("query", F.coalesce(F.try_element_at("search_queries", F.lit(1)), F.lit("none")))
    return Q.dedupe_neighbor_queries(s).select(*SCENE, "query", joined("search_queries").alias("queries"))


@query
def sequence_variation(v: Views) -> DataFrame:
    s = planted(v).withColumns(
        {
            "query": F.concat(F.lit("shot of "), F.element_at(T.strings("people", "soldiers", "city"), (F.floor(F.col("scene_idx") / 2) % 3 + 1).cast("int"))),
            "visual_description": F.lit(""), "semantic_lock": F.col("scene_idx") % 7 == 6,
        }
    ).withColumn("search_queries", F.array("query"))
    return Q.fill_sequence_variation(s).select(*SCENE, "query", joined("search_queries").alias("queries"), "varied")


# --- classification -----------------------------------------------------------


@query
def plan_mood(v: Views) -> DataFrame:
    return A.plan_mood(v.scenes(), MOOD_RULES)


@query
def beat_roles(v: Views) -> DataFrame:
    return v.scenes().select(*SCENE, C.beat_role(F.col("caption"), **ROLES).alias("role"))


@query
def visual_intent(v: Views) -> DataFrame:
    s = v.scenes().withColumn("mode", C.visual_mode(F.col("caption"), F.col("scene_idx"), F.col("end_ms") - F.col("start_ms"), MEME, VIDEO))
    context = F.when(F.col("plan_id") % 2 == 0, "19th century historical archival").otherwise("")
    return s.select(
        *SCENE, "mode", C.source_mode(F.col("caption"), context, F.col("mode"), HISTORY).alias("source"),
        C.motion_preset(F.col("caption"), F.col("scene_idx"), F.col("mode"), PULLBACK, DRAMATIC).alias("motion"),
    )


@query
def caption_facts(v: Views) -> DataFrame:
    """Entities, lock, tone, era, hints and flags of planted captions by the default lists."""
    c = F.col("caption")
    lock = C.semantic_lock(c)
    return planted(v).select(
        *SCENE, C.infer_tone(c).alias("tone"), joined(lock["entities"]).alias("entities"), joined(lock["context"]).alias("context"),
        lock["fallback"].alias("fallback"), lock["locked"].alias("locked"), C.detect_era(F.lower(c)).alias("era"),
        C.explicit_century(F.lower(c)).alias("century"), joined(C.visual_hints(c)).alias("hints"), C.locally_historical(c).alias("historical"),
        C.christian_reference(c).alias("christian"), C.army_action(c).alias("army"), C.taiping_story(c).alias("story"),
        joined(C.named_events(c)).alias("events"), joined(C.named_countries(c)).alias("countries"), C.beat_role(c).alias("role"),
    )


@query
def reactions(v: Views) -> DataFrame:
    r = C.reaction_prompt(F.col("caption"), F.lit(""))
    return planted(v).select(*SCENE, r["strength"].alias("strength"), r["prompt"].alias("prompt"), C.reaction_family(F.col("caption")).alias("family"))


@query
def story_context(v: Views) -> DataFrame:
    return E.story_context(planted(v))


@query
def metadata_conflicts(v: Views) -> DataFrame:
    """Each planted caption against the metadata of the following scene."""
    p = planted(v)
    nxt = p.select("plan_id", (F.col("scene_idx") - 1).alias("scene_idx"), F.col("caption").alias("meta"))
    j = p.join(nxt, SCENE)
    return j.select(*SCENE, C.metadata_conflict(F.col("scene_idx") % 2 == 0, F.col("caption"), F.col("meta")).alias("conflict"))


@query
def context_kept(v: Views) -> DataFrame:
    wanted = T.strings("China", "Qing dynasty", "19th century", "20th century", "21st century modern", "first soldiers", "war")
    return planted(v).select(*SCENE, joined(C.local_required_context(wanted, F.col("caption"))).alias("kept"))


@query
def query_intent(v: Views) -> DataFrame:
    """Does a line of a document stay on the subject of three fixed queries?"""
    base = T.strings("stressed student exam", "the that this erst", "documentary scene inge")
    d = v.table("documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    d = d.withColumn("low", F.lower("line")).withColumn("tags", C.query_tags(F.col("low")))
    return d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(C.query_matches_intent(F.col("low"), base, F.col("tags"))).alias("on_subject"),
        F.count_if(C.is_action_query(F.col("low"))).alias("actions"), F.sum(F.size("tags")).alias("tags"),
    )


@query
def bad_titles(v: Views) -> DataFrame:
    """First unwanted term of a title; a term of the list is planted in every third one."""
    terms = F.element_at(T.strings("Signboard", "Map of a sign, Logo", "watermarked", "SCREEN SHOT", "my-poster"), (F.col("cand_id") % 5 + 1).cast("int"))
    title = F.when(F.col("cand_id") % 3 == 0, F.concat_ws(" ", "title", terms)).otherwise(F.col("title"))
    return v.candidates().select("cand_id", C.bad_title(title, F.col("description")).alias("term"))


@query
def scene_compatibility(v: Views) -> DataFrame:
    """Neighbouring shots: do tones, locks and contexts fit?"""
    s = v.shots().withColumns(
        {
            "entities": F.when(F.col("semantic_lock"), F.array("asset_kind")).otherwise(F.array().cast("array<string>")),
            "context": F.when(F.col("scene_idx") % 3 == 0, F.array("tone")).otherwise(F.array().cast("array<string>")),
        }
    )
    n = s.select(
        "plan_id", (F.col("scene_idx") - 1).alias("scene_idx"), F.col("tone").alias("tone2"), F.col("entities").alias("entities2"),
        F.col("context").alias("context2"), F.concat_ws(" ", "asset_kind", "tone").alias("text2"),
    )
    j = s.join(n, SCENE)
    return j.select(
        *SCENE, C.tone_compatible(F.col("tone"), F.col("tone2")).alias("tone_ok"),
        C.lock_compatible(F.col("entities"), F.col("context"), F.col("entities2"), F.col("context2")).alias("lock_ok"),
        C.context_compatible(F.col("context"), F.col("text2")).alias("context_ok"),
    )


@query
def sources_allowed(v: Views) -> DataFrame:
    mode = F.element_at(T.strings("historical_archive", "stock_video", "meme_library", "generic_image", "auto"), (F.col("cand_id") % 5 + 1).cast("int"))
    c = v.candidates().withColumn("mode", mode)
    ok = C.source_allowed(F.col("cand_id") % 7 == 0, F.col("mode"), F.col("provider"), F.col("kind"))
    return c.withColumn("ok", ok).groupBy("mode", "provider", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("allowed"))
