"""Query expansion and scene rewrites: every operator returns scenes with new search intent.

Scenes carry ``plan_id, scene_idx, caption, query, search_queries,
visual_description, visual_mode, source_mode, motion_preset, semantic_lock,
required_entities, required_context, semantic_fallback, tone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, recipes as P, rules as R
from ..functions.lexicon import any_of, first_hit
from ..functions.text import (
    blank, clean_action_query, clean_footage_subject, clean_overlay_query, filled, first_filled, join_words, let,
    merge_queries, ordered_distinct, squash, squash_edges, strings, strip_constraints, tokens, useful_keywords,
)
from .blocks import BLOCK, checkpoint, join_per_key
from .sequence import _lag, chunk_words, fill_sequence_variation

PLAN = ["plan_id"]
NONE = F.array


def _queries() -> Column:
    return F.coalesce("search_queries", F.array().cast("array<string>"))


def _own_or_query() -> Column:
    return F.when(F.size(_queries()) > 0, _queries()).otherwise(F.array(F.col("query")))


def _with_queries(df: DataFrame, queries: Column, limit: int, cond: Column | None = None) -> DataFrame:
    """Set ``search_queries`` and make the first one the query, where ``cond`` holds."""
    cond = F.lit(True) if cond is None else cond
    new = F.when(cond, F.slice(queries, 1, limit)).otherwise(F.col("search_queries"))
    df = df.withColumn("search_queries", new)
    return df.withColumn("query", F.when(cond & (F.size("search_queries") > 0), F.element_at("search_queries", 1)).otherwise(F.col("query")))


def story_context(scenes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Context phrases per plan: ``plan_id, global_context, soft_context, taiping``.

    Rule hits are found per caption, joined with as many of the next ones as the longest
    needle has further words, so phrases across cuts count, and united per plan.
    """
    ahead = {f"__next{i}": ("caption", -i) for i in range(1, C.CONTEXT_WORDS)}
    s = _lag(scenes.select("plan_id", "scene_idx", "caption"), "scene_idx", ahead, size=size)
    text = F.concat_ws(" ", "caption", *ahead)
    tagged = s.select(
        "plan_id", C.context_parts(text).alias("g"), C.soft_context_parts(text).alias("s"), C.taiping_story(text).alias("t")
    )
    flags = F.concat(
        F.transform("g", lambda x: F.concat(F.lit("g:"), x)), F.transform("s", lambda x: F.concat(F.lit("s:"), x)),
        F.array(F.when(F.col("t"), "t:").otherwise("-")),
    )
    parts = tagged.select("plan_id", F.explode(flags).alias("p")).groupBy("plan_id").agg(F.collect_set("p").alias("p"))
    of = lambda k: F.transform(F.filter("p", lambda x: x.startswith(k)), lambda x: F.substr(x, F.lit(3)))
    return parts.select(
        "plan_id", C.context_from_parts(of("g:")).alias("global_context"), C.soft_context_from_parts(of("s:")).alias("soft_context"),
        F.array_contains("p", "t:").alias("taiping"),
    )


def visual_description(caption: Column, mode: Column, entities: Column | None = None, hints: Column | None = None) -> Column:
    """``entities`` and ``hints`` may hold what the rules find in the caption, here and in ``search_queries``."""
    entities = C.explicit_entities(caption) if entities is None else entities
    hints = C.visual_hints(caption) if hints is None else hints
    style = F.when(mode == "video", "moving documentary B-roll").when(mode == "meme", "reaction meme insert").otherwise("documentary visual")
    return F.concat_ws(
        " ", let(entities, lambda e: F.when(F.size(e) > 0, F.array_join(e, " "))),
        F.coalesce(F.try_element_at(hints, F.lit(1)), F.lit("documentary scene related to narration")), style,
    )


def search_queries(
    caption: Column, context: Column, neighborhood: Column, mode: Column, description: Column, entities: Column | None = None, hints: Column | None = None
) -> Column:
    """Up to four provider queries from entities, setting, hints and keywords."""
    suffix = F.when(mode == "video", "video b roll").when(mode == "meme", "reaction meme").otherwise("photo illustration")

    def build(p: Column) -> Column:
        head = F.coalesce(F.try_element_at(p["hints"], F.lit(1)), p["own"])
        lead = F.when(p["own"] == "", p["near"]).otherwise(p["own"])
        made = F.array(
            F.concat_ws(" ", p["named"], p["setting"], head, suffix), F.concat_ws(" ", p["setting"], description),
            F.concat_ws(" ", p["setting"], p["own"], suffix), F.concat_ws(" ", lead, suffix),
        )
        return merge_queries(made)

    parts = F.struct(
        F.array_join(C.explicit_entities(caption) if entities is None else entities, " ").alias("named"), C.setting_context(context).alias("setting"),
        (C.visual_hints(caption) if hints is None else hints).alias("hints"), F.array_join(useful_keywords(caption, 5), " ").alias("own"),
        F.array_join(useful_keywords(neighborhood, 3), " ").alias("near"),
    )
    return let(parts, build)


def build_scenes(words: DataFrame, target: int = 1700, minimum: int = 950, maximum: int = 2700, size: int = BLOCK) -> DataFrame:
    """Timed words to fully described scenes."""
    s = chunk_words(words, target, minimum, maximum, size)
    s = checkpoint(s.withColumn("caption", join_words(F.transform("words", lambda w: w["text"]))))
    s = _lag(s, "scene_idx", {"__prev": ("caption", 1), "__next": ("caption", -1)}, size=size)
    s = join_per_key(s, story_context(s, size).select("plan_id", "global_context"), PLAN, "scene_idx", size=size)
    s = s.withColumns(
        {
            "visual_mode": C.visual_mode(F.col("caption"), F.col("scene_idx"), F.col("end_ms") - F.col("start_ms")),
            "__entities": C.explicit_entities(F.col("caption")), "__hints": C.visual_hints(F.col("caption")),
        }
    )
    found = (F.col("__entities"), F.col("__hints"))
    s = s.withColumns(
        {
            "source_mode": C.source_mode(F.col("caption"), F.col("global_context"), F.col("visual_mode")),
            "motion_preset": C.motion_preset(F.col("caption"), F.col("scene_idx"), F.col("visual_mode")),
            "visual_description": visual_description(F.col("caption"), F.col("visual_mode"), *found),
            "__lock": C.semantic_lock(F.col("caption"), found[0]),
            "tone": C.infer_tone(F.col("caption")),
        }
    )
    near = F.concat_ws(" ", "__prev", "caption", "__next")
    s = s.withColumn("search_queries", search_queries(F.col("caption"), F.col("global_context"), near, F.col("visual_mode"), F.col("visual_description"), *found))
    lock = F.col("__lock.locked")
    return s.select(
        "plan_id", "scene_idx", "start_ms", "end_ms", F.element_at("search_queries", 1).alias("query"), "search_queries", "visual_description",
        F.lit("blank").alias("asset_kind"), "caption", F.col("words").alias("caption_words"),
        F.when(lock, "image").otherwise(F.col("visual_mode")).alias("visual_mode"),
        F.when(lock, "historical_archive").otherwise(F.col("source_mode")).alias("source_mode"), "motion_preset",
        lock.alias("semantic_lock"), F.col("__lock.entities").alias("required_entities"), F.col("__lock.context").alias("required_context"),
        F.col("__lock.fallback").alias("semantic_fallback"), "tone",
    )


def query_variants(scenes: DataFrame) -> DataFrame:
    """Ordered distinct provider queries of each scene: ``plan_id, scene_idx, query_idx, query``."""
    hint, desc = C.tone_hint(F.col("tone")), F.col("visual_description")
    locked = F.array_join(F.concat("required_entities", "required_context"), " ")
    base = first_filled(desc, F.col("query"))
    pair = lambda *p: F.concat_ws(" ", *p)
    head = F.when(
        F.col("semantic_lock") & (locked != ""),
        F.array(pair(locked, desc), pair(locked, F.lit("historical illustration")), pair(locked, F.lit("archival portrait")), blank(F.col("semantic_fallback"))),
    ).otherwise(F.array().cast("array<string>"))
    own = F.transform(_queries(), lambda q: pair(q, hint))
    tail = (
        F.when(F.col("source_mode") == "historical_archive", F.array(pair(base, F.lit("archival engraving")), pair(base, F.lit("historical painting"))))
        .when(F.col("visual_mode") == "video", F.array(pair(base, hint, F.lit("documentary footage")), pair(base, F.lit("b roll"))))
        .when(F.col("visual_mode") == "meme", F.array(pair(base, F.lit("reaction"))))
        .otherwise(F.array(pair(base, hint, F.lit("photo illustration"))))
    )
    variants = merge_queries(head, own, F.array(pair(desc, hint), F.col("query")), tail)
    return scenes.select("plan_id", "scene_idx", F.posexplode(variants).alias("query_idx", "query"))


def recovery_queries(scenes: DataFrame) -> DataFrame:
    """Three plain queries per scene; keywords are the first five tokens in text order."""
    text = first_filled(F.col("caption"), F.col("query"))
    words = F.array_join(F.slice(tokens(text), 1, 5), " ")
    kind = F.when(F.col("visual_mode") == "video", "real footage").otherwise("documentary photo")
    base = first_filled(F.col("visual_description"), F.col("caption"), F.col("query"))
    made = merge_queries(F.array(F.concat_ws(" ", base, kind), F.concat_ws(" ", words, kind), F.concat_ws(" ", F.lit("person"), words, F.lit("action"), kind)))
    return scenes.select("plan_id", "scene_idx", F.posexplode(made).alias("query_idx", "query"))


def variation_queries(base: Column, caption: Column, locked: Column, source_mode: Column, pass_index: int) -> Column:
    """Reframed queries for a scene whose visual repeats."""
    ends = lambda options: F.array(*[F.concat_ws(" ", base, F.lit(o)) for o in options])
    at = lambda table: table[min(pass_index, len(table) - 1)]
    v = F.lower(blank(caption))
    out = (
        F.when(locked, ends(at(P.VARIATION_LOCKED)))
        .when(any_of(v, P.VARIATION_ARMY) & (source_mode == "historical_archive"), ends(P.VARIATION_ARMY_ARCHIVE))
        .when(any_of(v, P.VARIATION_ARMY), ends(P.VARIATION_ARMY_STOCK))
        .when(any_of(v, P.VARIATION_DREAM), ends(P.VARIATION_DREAM_FIRST if pass_index == 0 else P.VARIATION_DREAM_LATER))
    )
    for needles, options in P.VARIATION_TOPICS:
        out = out.when(any_of(v, needles), ends(options))
    return out.otherwise(ends(at(P.VARIATION_PLAIN)))


def prepare_repair(scenes: DataFrame, repairs: DataFrame, pass_index: int) -> DataFrame:
    """Push the scenes listed in ``repairs`` towards a different visual; other scenes stay."""
    marked = repairs.select("plan_id", "scene_idx").distinct().withColumn("__fix", F.lit(True))
    s = scenes.join(marked, ["plan_id", "scene_idx"], "left").withColumn("__fix", F.coalesce("__fix", F.lit(False)))
    fix, locked = F.col("__fix"), F.col("semantic_lock")
    base = squash(first_filled(F.col("query"), F.col("caption"), F.col("visual_description"), F.lit("documentary scene")))
    s = s.withColumn("__base", base)
    made = variation_queries(F.col("__base"), F.col("caption"), locked, F.col("source_mode"), pass_index)
    s = _with_queries(s, merge_queries(made, _own_or_query()), 8, fix)
    text = F.regexp_replace(first_filled(F.col("visual_description"), F.col("caption"), F.col("__base")), "[ .]+$", "")
    noted = F.concat(text, F.lit(". "), F.lit(P.REPAIR_NOTE))
    to_video = fix & ~locked & F.lit(pass_index >= 1) & F.col("source_mode").isin("generic_image", "auto")
    to_image = fix & ~locked & ~to_video & F.lit(pass_index >= 2) & (F.col("visual_mode") == "video") & (F.col("source_mode") == "stock_video")
    switch = lambda v, i, own: F.when(F.col("__v"), v).when(F.col("__i"), i).otherwise(F.col(own))
    s = s.withColumn("__v", to_video).withColumn("__i", to_image)
    return s.withColumns(
        {
            "visual_description": F.when(fix & ~locked, noted).otherwise(F.col("visual_description")),
            "visual_mode": switch("video", "image", "visual_mode"),
            "source_mode": switch("stock_video", "generic_image", "source_mode"),
        }
    ).drop("__fix", "__base", "__v", "__i")


def action_queries() -> Column:
    """Queries for visible actions: subjects of the caption by first mention, then the scene's own queries."""
    caption = F.lower(blank(F.col("caption")))

    def hits(text: Column, by_place: bool) -> Column:
        found = []
        for i, (needles, queries) in enumerate(P.ACTION_RECIPES):
            places = [F.when(F.contains(text, F.lit(n)), F.instr(text, n)) for n in needles]
            place = F.array_min(F.array_compact(F.array(*places)))
            found.append(F.when(place.isNotNull(), F.struct((place if by_place else F.lit(0)).alias("p"), F.lit(i).alias("i"), strings(*queries).alias("q"))))
        return F.flatten(F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda r: r["q"]))

    wider = F.lower(F.concat_ws(" ", blank(F.col("query")), F.array_join(_queries(), " ")))
    ruled = let(hits(caption, True), lambda h: F.when(F.size(h) > 0, h).otherwise(hits(wider, False)))
    own = F.slice(merge_queries(F.array(F.col("query")), _queries(), clean=clean_action_query), 1, 3)
    wrapped = F.flatten(
        F.transform(
            own,
            lambda b: F.when(C.is_action_query(b), F.array(b)).otherwise(
                F.array(F.concat(F.lit("person interacting with "), b), F.concat(F.lit("hands using "), b, F.lit(" close up")), F.concat(b, F.lit(" real action footage")))
            ),
        )
    )
    subject = clean_action_query(first_filled(F.col("visual_description"), F.col("query"), F.col("caption")))
    last = F.when(
        filled(subject), F.array(F.concat(F.lit("person "), subject, F.lit(" action")), F.concat(subject, F.lit(" hands close up")), F.concat(subject, F.lit(" real footage")))
    ).otherwise(F.array().cast("array<string>"))
    return let(F.concat(ruled, wrapped), lambda q: F.when(F.size(q) > 0, q).otherwise(last))


def action_first(scenes: DataFrame) -> DataFrame:
    """Unlocked scenes ask stock providers for visible actions; applying it twice changes nothing more."""
    locked, meme = F.col("semantic_lock"), (F.col("visual_mode") == "meme") & (F.col("source_mode") == "meme_library")
    s = scenes.withColumn("__on", ~(locked | (F.col("source_mode") == "historical_archive") | meme))
    on = F.col("__on")
    s = _with_queries(s, merge_queries(action_queries(), _queries(), F.array(F.col("query")), clean=clean_action_query), 9, on)
    base = F.regexp_replace(squash(first_filled(F.col("visual_description"), F.col("caption"), F.col("query"), F.lit("real moving subject"))), "^[ .]+|[ .]+$", "")
    noted = F.substring(F.concat_ws(" ", F.concat(base, F.lit(".")), F.lit(P.ACTION_MARKER), F.lit(P.ACTION_NOTE)), 1, 700)
    return s.withColumns(
        {
            "visual_description": F.when(on & ~F.contains(base, F.lit(P.ACTION_MARKER)), noted).otherwise(F.col("visual_description")),
            "visual_mode": F.when(on, "video").otherwise(F.col("visual_mode")),
            "source_mode": F.when(on, "stock_video").otherwise(F.col("source_mode")),
            "motion_preset": F.when(on, "none").otherwise(F.col("motion_preset")),
        }
    ).drop("__on")


def style_queries() -> Column:
    text = F.lower(F.concat_ws(" ", blank(F.col("caption")), blank(F.col("visual_description")), blank(F.col("query"))))
    out = None
    for needles, queries in P.STYLE_RECIPES:
        value = strings(*queries)
        if "проснул" in needles:
            value = F.when(any_of(text, P.STYLE_AWAKE), strings(*P.STYLE_AWAKE_QUERIES)).otherwise(value)
        out = F.when(any_of(text, needles), value) if out is None else out.when(any_of(text, needles), value)
    plain = clean_footage_subject(first_filled(F.col("visual_description"), F.col("query")))
    subject = clean_footage_subject(first_filled(F.col("visual_description"), F.col("caption"), F.col("query")))
    ends = lambda base, *e: F.array(*[F.concat_ws(" ", base, F.lit(x)) for x in e])
    return out.when(any_of(text, P.STYLE_ACTION), ends(plain, "real footage", "action b roll")).otherwise(
        ends(subject, "real footage", "vertical b roll", "people action")
    )


def video_first_style(scenes: DataFrame) -> DataFrame:
    """Real footage for every unlocked beat; locked facts stay archive images, memes stay memes."""
    locked = F.col("semantic_lock")
    meme = ~locked & (F.col("visual_mode") == "meme") & (F.col("source_mode") == "meme_library")
    s = scenes.withColumn("__on", ~(locked | meme)).withColumn("__old_query", F.col("query"))
    s = s.withColumn("__text", first_filled(F.col("visual_description"), F.col("caption")))
    on = F.col("__on")
    s = _with_queries(s, merge_queries(style_queries(), _own_or_query()), 7, on)
    base = F.regexp_replace(first_filled(F.col("__text"), F.col("query"), F.lit("real human action")), "[ .]+$", "")
    return s.withColumns(
        {
            "visual_description": F.when(on, F.concat(base, F.lit(". "), F.lit(P.STYLE_NOTE))).otherwise(F.col("visual_description")),
            "visual_mode": F.when(on, "video").when(locked, "image").otherwise(F.col("visual_mode")),
            "source_mode": F.when(on, "stock_video").when(locked, "historical_archive").otherwise(F.col("source_mode")),
            "motion_preset": F.when(locked, "micro_push").otherwise("none"),
        }
    ).drop("__on", "__old_query", "__text")


def beat_grammar(scenes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Turn captions into edit-friendly beats by role; repeated neighbours get a variation.

    Adds ``rewritten``.
    """
    flags = story_context(scenes, size).select("plan_id", "taiping")
    s = join_per_key(scenes, flags, PLAN, "scene_idx", size=size)
    role, story, locked = C.beat_role(F.col("caption")), F.col("taiping"), F.col("semantic_lock")
    told = lambda a, b: F.when(story, strings(*a)).otherwise(strings(*b))
    recipe = None
    for name, (queries, text, mode, source) in P.GRAMMAR.items():
        value = F.struct(strings(*queries).alias("q"), F.lit(text).alias("d"), F.lit(mode).alias("m"), F.lit(source).alias("s"))
        recipe = F.when(role == name, value) if recipe is None else recipe.when(role == name, value)
    made = lambda q, d, source: F.struct(q.alias("q"), F.lit(d).alias("d"), F.lit("image").alias("m"), source.alias("s"))
    archive = F.lit("historical_archive")
    recipe = (
        recipe.when(role == "army", made(told(P.ARMY_STORY, P.ARMY_PLAIN), P.GRAMMAR_ARMY, archive))
        .when(role == "aftermath", made(told(P.AFTERMATH_STORY, P.AFTERMATH_PLAIN), P.GRAMMAR_AFTERMATH, F.when(story, archive).otherwise(F.col("source_mode"))))
        .when(role == "battle", made(told(P.BATTLE_STORY, P.BATTLE_PLAIN), P.GRAMMAR_BATTLE, archive))
    )
    s = s.withColumn("__r", F.when(~locked, recipe))
    on = F.col("__r").isNotNull()
    s = _with_queries(s, merge_queries(F.col("__r.q"), _queries()), 5, on)
    take = lambda f, own: F.when(on, F.col(f"__r.{f}")).otherwise(F.col(own))
    s = s.withColumns(
        {"visual_description": take("d", "visual_description"), "visual_mode": take("m", "visual_mode"), "source_mode": take("s", "source_mode"), "__on": on}
    ).drop("taiping", "__r")
    s = checkpoint(s)
    varied = fill_sequence_variation(s, size)
    out = s.drop("query", "search_queries").join(varied, ["plan_id", "scene_idx"])
    return out.select(*scenes.columns, (F.col("__on") | F.col("varied")).alias("rewritten"))


def apply_direction(scenes: DataFrame, replies: DataFrame, memes: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Apply external direction rows to scenes; rule facts and rule intent stay in charge.

    ``replies`` has ``plan_id, scene_idx, visual_mode, source_mode, motion_preset,
    visual_description, search_queries, meme_filename, meme_tags``; ``memes`` lists
    the known ``meme_filename``. Adds ``directed``.
    """
    reply = F.struct(*[c for c in replies.columns if c not in ("plan_id", "scene_idx")])
    s = scenes.join(replies.select("plan_id", "scene_idx", reply.alias("__d")), ["plan_id", "scene_idx"], "left")
    s = join_per_key(s, story_context(scenes, size).select("plan_id", "taiping"), PLAN, "scene_idx", size=size)
    if "meme_filename" not in scenes.columns:
        s = s.withColumn("meme_filename", F.lit(None).cast("string"))
    if memes is not None:
        known = memes.select(F.col("meme_filename").alias("__file")).distinct()
        s = s.join(known, F.col("__d.meme_filename") == F.col("__file"), "left")
    else:
        s = s.withColumn("__file", F.lit(None).cast("string"))
    on, locked = F.col("__d").isNotNull(), F.col("semantic_lock")
    local = C.locally_historical(F.col("caption"))
    free = ~locked & ~local

    def allowed(name: str, values: tuple) -> Column:
        said = F.trim(F.lower(F.col(f"__d.{name}")))
        return F.when(on & said.isin(*values), said).otherwise(F.col(name))

    text = F.trim(blank(F.col("__d.visual_description")))
    text = F.substring(F.when(free, strip_constraints(text)).otherwise(text), 1, 500)
    new = F.transform(F.coalesce("__d.search_queries", F.array().cast("array<string>")), lambda q: squash(blank(q)))
    new = F.transform(new, lambda q: F.when(free, strip_constraints(q)).otherwise(q))
    fits = lambda q: locked | (F.size(_queries()) == 0) | C.query_matches_intent(q, _queries())
    new = F.slice(ordered_distinct(F.filter(new, lambda q: (q != "") & fits(q))), 1, 4)
    new = F.transform(new, lambda q: F.substring(q, 1, 180))
    rules = _queries()
    merged = merge_queries(F.slice(rules, 1, 2), new, F.slice(rules, 3, F.size(rules) + 1))
    s = s.withColumn("__merged", merged).withColumns(
        {
            "visual_mode": allowed("visual_mode", R.VISUAL_MODES), "source_mode": allowed("source_mode", R.SOURCE_MODES),
            "motion_preset": allowed("motion_preset", R.MOTION_PRESETS),
            "visual_description": F.when(on & (F.trim(blank(F.col("__d.visual_description"))) != ""), text).otherwise(F.col("visual_description")),
        }
    )
    s = _with_queries(s, F.col("__merged"), 5, on & (F.size("__merged") > 0))
    none = F.array().cast("array<string>")
    stray = on & ~locked & (F.col("source_mode") == "historical_archive") & ~local
    s = s.withColumns(
        {
            "semantic_fallback": F.when(on & locked, first_filled(F.col("semantic_fallback"), F.col("visual_description")))
            .when(on, F.lit(None)).otherwise(F.col("semantic_fallback")),
            "required_entities": F.when(on & ~locked, none).otherwise(F.col("required_entities")),
            "required_context": F.when(on & ~locked, none).otherwise(F.col("required_context")),
            "source_mode": F.when(on & locked, "historical_archive").when(stray & (F.col("visual_mode") == "video"), "stock_video")
            .when(stray, "generic_image").otherwise(F.col("source_mode")),
            "visual_mode": F.when(on & locked, "image").otherwise(F.col("visual_mode")),
            "meme_filename": F.when(~(on & locked), F.col("meme_filename")),
        }
    )
    christian = on & ~locked & C.christian_reference(F.col("caption"))
    s = s.withColumns(
        {
            "visual_mode": F.when(christian, "image").otherwise(F.col("visual_mode")),
            "source_mode": F.when(christian, "generic_image").otherwise(F.col("source_mode")),
            "visual_description": F.when(christian, P.DIRECTION_CHRISTIAN_TEXT).otherwise(F.col("visual_description")),
        }
    )
    s = _with_queries(s, merge_queries(strings(*P.DIRECTION_CHRISTIAN), _queries()), 5, christian)
    army = on & ~locked & C.army_action(F.col("caption"))
    s = s.withColumns(
        {
            "source_mode": F.when(army, "historical_archive").otherwise(F.col("source_mode")),
            "visual_mode": F.when(army, "image").otherwise(F.col("visual_mode")),
            "visual_description": F.when(army, P.DIRECTION_ARMY_TEXT).otherwise(F.col("visual_description")),
        }
    )
    soldiers = F.when(F.col("taiping"), strings(*P.ARMY_STORY)).otherwise(strings(*P.ARMY_PLAIN))
    s = _with_queries(s, merge_queries(soldiers, _queries()), 5, army)
    meme = on & ~locked & (F.col("visual_mode") == "meme")
    tags = F.array_join(F.filter(F.transform(F.coalesce("__d.meme_tags", none), lambda t: F.trim(blank(t))), lambda t: t != ""), " ")
    s = s.withColumns(
        {
            "source_mode": F.when(meme, "meme_library").otherwise(F.col("source_mode")),
            "meme_filename": F.when(meme & F.col("__file").isNotNull(), F.col("__file")).otherwise(F.col("meme_filename")),
            "visual_description": F.when(
                meme & (tags != ""), F.trim(F.concat_ws(" ", blank(F.col("visual_description")), tags, F.lit("reaction meme")))
            ).otherwise(F.col("visual_description")),
        }
    )
    still = on & (F.col("source_mode") == "historical_archive") & (F.col("visual_mode") == "video")
    s = s.withColumn("visual_mode", F.when(still, "image").otherwise(F.col("visual_mode"))).withColumn("directed", on)
    return s.drop("__d", "__file", "__merged", "taiping")


def object_query(caption: Column, query: Column, queries: Column, entities: Column) -> Column:
    """Concrete prop for a foreground insert; empty when the scene offers only actions."""
    hay = F.lower(F.concat_ws(" ", blank(caption), blank(query), F.array_join(queries, " ")))
    cleaned = F.filter(
        F.transform(F.concat(entities, queries, F.array(blank(query))), lambda q: clean_overlay_query(q)), lambda q: q != ""
    )

    def rated(value: Column, i: Column) -> Column:
        words = F.split(F.lower(value), " ")
        n = F.size(words)
        bad = F.size(F.filter(words, lambda w: w.isin(*P.PROP_WEAK_WORDS)))
        ok = n.between(1, 5) & ~F.lower(value).isin(*P.PROP_BAD_PHRASES) & (n - bad > 0)
        score = 18 - n * 2 + (n - bad) * 4 - bad * 7 + F.when(n <= 3, 5).otherwise(0)
        return F.when(ok, F.struct(score.alias("s"), (-i).alias("o"), value.alias("v")))

    best = F.array_max(F.array_compact(F.transform(ordered_distinct(cleaned), rated)))["v"]

    def thing(v: Column) -> Column:
        words = F.split(F.lower(v), " ")
        moves = F.size(F.filter(words, lambda w: w.isin(*P.PROP_ACTION_WORDS)))
        return F.when(v.isNull() | (F.size(words) > 3) | (moves >= 2), "").otherwise(v)

    return first_hit(hay, P.PROPS, let(best, thing))
