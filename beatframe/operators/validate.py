"""Checks of words, scenes and replies, and the cleaning of model replies held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R
from ..functions.lexicon import any_of
from ..functions.media import clamp
from ..functions.text import blank, filled, squash_edges
from .blocks import BLOCK, block_window, halo, own_rows, prefix

PLAN = ["plan_id"]


def validate_words(words: DataFrame, plans: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Faults of timed words: ``plan_id, idx, fault``; plans without words only when ``plans`` is given."""
    w = prefix(words, PLAN, "idx", {"__seen": ("max", F.col("end_ms"))}, size)
    fault = F.when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "invalid time range").when(
        F.col("start_ms") + 250 < F.coalesce("__seen", F.lit(0)), "timestamps are not monotonic"
    )
    found = w.select("plan_id", "idx", fault.alias("fault")).filter("fault is not null")
    if plans is None:
        return found
    none = plans.select("plan_id").join(words.select("plan_id").distinct(), "plan_id", "left_anti")
    return found.unionByName(none.select("plan_id", F.lit(None).cast("int").alias("idx"), F.lit("no timed words").alias("fault")))


def validate_scenes(scenes: DataFrame, plans: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """All faults of the scenes of each plan: ``plan_id, scene_idx, fault``.

    Columns that are absent are not checked. ``plans`` brings the canvas and plans without scenes.
    """
    have = set(scenes.columns)
    s = own_rows(halo(scenes, "scene_idx", back=1, size=size).withColumn("__prev", F.lag("end_ms").over(block_window(PLAN, "scene_idx"))))
    checks = [
        ((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "invalid time range"),
        (F.col("start_ms") < F.col("__prev"), "overlaps previous scene"),
    ]
    if {"asset", "asset_kind"} <= have:
        checks.append(((F.col("asset_kind") != "blank") & ~filled(F.col("asset")), "asset kind requires asset"))
    for name, allowed in (
        ("visual_mode", R.VISUAL_MODES), ("source_mode", R.SOURCE_MODES), ("motion_preset", R.MOTION_PRESETS), ("tone", R.TONES),
    ):
        if name in have:
            checks.append((~F.col(name).isin(*allowed), f"invalid {name}"))
    if {"semantic_lock", "required_entities", "required_context", "semantic_fallback"} <= have:
        backed = (F.size("required_entities") > 0) | (F.size("required_context") > 0) | filled(F.col("semantic_fallback"))
        checks.append((F.col("semantic_lock") & ~backed, "lock requires entities, context or fallback"))
    for name in ("focus_x", "focus_y"):
        if name in have:
            checks.append((~F.col(name).between(0.0, 1.0), f"{name} must be between 0 and 1"))
    faults = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    found = s.select("plan_id", "scene_idx", F.explode(faults).alias("fault"))
    if plans is None:
        return found
    at_plan = lambda df, t: df.select("plan_id", F.lit(None).cast("int").alias("scene_idx"), F.lit(t).alias("fault"))
    empty = plans.join(scenes.select("plan_id").distinct(), "plan_id", "left_anti")
    canvas = plans.filter((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("fps") <= 0))
    return found.unionByName(at_plan(empty, "no scenes")).unionByName(at_plan(canvas, "canvas must be positive"))


def extract_json(col: Column) -> Column:
    """JSON text of a reply: fences removed; otherwise the part from the first { to the last }."""
    bare = F.trim(F.regexp_replace(F.trim(col), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when((bare != "") & valid(bare), bare).when((inner != "") & valid(inner), inner)


def as_integer(df: DataFrame, name: str) -> Column:
    """Whole number of a reply field: text must be an integer, numbers are cut."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.trim(F.col(name)).try_cast("int")
    return F.when(F.col(name) < 0, F.ceil(name)).otherwise(F.floor(name)).try_cast("int")


def as_fit(col: Column) -> Column:
    """Score of a reply cut to an integer from 0 to 100; a missing one is 0."""
    return clamp(F.floor(F.coalesce(col.cast("string"), F.lit("0")).try_cast("double")), 0, 100).cast("int")


def _first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return one.select(*keys, "__row.*")


def sanitize_beats(beats: DataFrame, words: DataFrame) -> DataFrame:
    """Valid beats of a reply: integer range, clamped to the words, first reply per start.

    ``beats`` has ``plan_id, reply_pos, start_idx, end_idx`` and any other columns.
    """
    last = words.groupBy("plan_id").agg(F.max("idx").alias("__last"))
    b = beats.withColumn("__s", F.coalesce(as_integer(beats, "start_idx"), F.when(F.col("start_idx").isNull(), F.lit(-1))))
    b = b.withColumn("__e", F.coalesce(as_integer(beats, "end_idx"), F.when(F.col("end_idx").isNull(), F.col("__s"))))
    b = b.filter(F.col("__s").isNotNull() & F.col("__e").isNotNull()).join(last, "plan_id")
    b = b.withColumn("start_idx", F.greatest(F.lit(0), F.least("__last", "__s"))).withColumn(
        "end_idx", F.greatest("start_idx", F.least("__last", "__e"))
    )
    return _first(b.select(*beats.columns), ["plan_id", "start_idx"], "reply_pos")


def _kept_choices(choices: DataFrame, candidates: DataFrame, keys: list[str], none_allowed: bool) -> DataFrame:
    c = choices.withColumn("candidate", as_integer(choices, "candidate")).withColumn("fit", as_fit(F.col("fit")))
    c = c.filter(F.col("candidate").isNotNull() & F.col("fit").isNotNull())
    known = candidates.select(*keys, "candidate").distinct().withColumn("__known", F.lit(True))
    c = c.join(known, [*keys, "candidate"], "left")
    ok = F.coalesce("__known", F.lit(False))
    if none_allowed:
        scenes = candidates.select(*keys).distinct()
        c = c.filter(ok | (F.col("candidate") == 0)).join(scenes, keys, "left_semi")
    else:
        c = c.filter(ok)
    return c.drop("__known").withColumn("reason", F.substring(blank(F.col("reason")), 1, 220))


def sanitize_choices(choices: DataFrame, candidates: DataFrame, keep: int = 5) -> DataFrame:
    """Known candidates of a reply, first mention each, the first five.

    ``choices`` has ``plan_id, scene_idx, reply_pos, candidate, fit, reason``.
    """
    keys = ["plan_id", "scene_idx"]
    first = _first(_kept_choices(choices, candidates, keys, False), [*keys, "candidate"], "reply_pos")
    order = Window.partitionBy(*keys).orderBy("reply_pos")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def sanitize_roll_choices(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """One choice per scene of a reply over many scenes; candidate 0 means none."""
    keys = ["plan_id", "scene_idx"]
    return _first(_kept_choices(choices, candidates, keys, True), keys, "reply_pos")


def sanitize_queries(
    replies: DataFrame, keys: list[str], least: int = 2, most: int = 9, banned=R.BANNED_QUERY_TERMS, keep: int = 4, longest: int = 140
) -> DataFrame:
    """Usable search queries of a reply: word count, banned words, first mention, the first few.

    ``replies`` has the keys, ``reply_pos`` and ``query``. Adds ``place``.
    """
    q = replies.withColumn("query", squash_edges(F.col("query")))
    n = F.regexp_count("query", F.lit("[A-Za-z0-9'-]+"))
    q = q.filter(n.between(least, most)).withColumn("__key", F.lower("query"))
    if banned:
        q = q.filter(~F.col("__key").rlike(rf"(?U)\b(?:{'|'.join(banned)})\b"))
    first = _first(q.select(*keys, "__key", "reply_pos", "query"), [*keys, "__key"], "reply_pos")
    order = Window.partitionBy(*keys).orderBy("reply_pos")
    top = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    return top.select(*keys, "place", F.substring("query", 1, longest).alias("query"))


def gate_judgements(judged: DataFrame) -> DataFrame:
    """Apply relevance floors and acceptance thresholds to judge replies.

    Needs ``score, tone_match, quality_score, accept, match_level, semantic_lock``
    and optionally ``mismatch, reason``. Rewrites ``score, mismatch, reason, accept``.
    """
    level, locked = F.col("match_level"), F.col("semantic_lock")
    pick = lambda exact, close, context: F.when(level == "exact", exact).when(level == "close", close).otherwise(context)
    raw = as_fit(F.col("score"))
    low = ~locked & (raw < pick(45, 34, 25))
    score = F.when(low, F.least(raw, pick(29, 23, 19))).otherwise(raw).cast("int")
    tone, quality = as_fit(F.col("tone_match")), as_fit(F.col("quality_score"))
    own = F.coalesce(F.col("accept"), F.lit(False))
    accept = (
        F.when(locked, own & (score >= 72) & (quality >= 45))
        .when(level == "exact", own & (score >= 48) & (tone >= 42) & (quality >= 42))
        .when(level == "close", (score >= 40) & (tone >= 35) & (quality >= 40))
        .otherwise((score >= 32) & (tone >= 30) & (quality >= 38))
    )
    have = set(judged.columns)
    mismatch = F.substring(blank(F.col("mismatch")), 1, 200) if "mismatch" in have else F.lit("")
    reason = F.substring(blank(F.col("reason")), 1, 300) if "reason" in have else F.lit("")
    noted = F.when(low & ((mismatch == "") | (F.lower(mismatch) == "none")), "semantic relevance below minimum").otherwise(mismatch)
    told = F.when(low, F.trim(F.concat(F.lit("Low semantic relevance ("), raw.cast("string"), F.lit("/100). "), reason))).otherwise(reason)
    return judged.withColumns(
        {"score": score, "tone_match": tone, "quality_score": quality, "accept": accept, "mismatch": noted, "reason": told}
    )


def hard_reject(tone: Column, locked: Column, accept: Column, score: Column, tone_match: Column, quality: Column, mismatch: Column) -> Column:
    """Is a judged candidate out for good?"""
    return (
        F.when((quality < 28) | (score < 30), True)
        .when(tone.isin(*R.DARK_TONES) & (tone_match < 28), True)
        .when(locked, ~accept | (score < 70))
        .otherwise(any_of(F.lower(blank(mismatch)), R.RED_FLAGS))
    )


def check_durations(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs whose length is missing or off by more than 0.2 s."""
    both = expected.join(actual, keys, "left")
    got = F.coalesce("actual_ms", F.lit(0))
    return both.filter((got <= 0) | (F.abs(got - F.col("expected_ms")) > 200))
