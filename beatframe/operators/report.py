"""Per-plan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R
from ..functions.lexicon import any_of
from ..functions.text import blank


def tone_counts(scenes: DataFrame) -> DataFrame:
    """Scenes of each tone per plan: ``plan_id, tone, n``."""
    return scenes.groupBy("plan_id", "tone").agg(F.count(F.lit(1)).alias("n"))


def tone_map(counts: DataFrame) -> DataFrame:
    """Tone counts of a plan as one map (at most as many entries as there are tones)."""
    return counts.groupBy("plan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tone", "n")))).alias("tone_counts"))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Judge and guard statistics per plan.

    ``manifest`` has per scene ``judge`` (struct of ``accept, fallback``; null when
    not judged), ``judge_rejected`` (array of ``tone_match, quality_score``) and
    ``local_rejected`` (number).
    """
    rejected = F.coalesce(F.size("judge_rejected"), F.lit(0))
    count = lambda cond: F.aggregate(
        F.coalesce("judge_rejected", F.array().cast("array<struct<tone_match:int,quality_score:int>>")),
        F.lit(0), lambda s, r: s + F.when(cond(r), 1).otherwise(0),
    )
    return manifest.groupBy("plan_id").agg(
        F.count_if(F.col("judge").isNotNull()).alias("judged"),
        F.count_if(F.coalesce("judge.accept", F.lit(False))).alias("accepted"),
        F.sum(rejected).alias("rejected"),
        F.count_if(F.coalesce("judge.fallback", F.lit(False))).alias("fallback"),
        F.sum(count(lambda r: F.coalesce(r["tone_match"], F.lit(100)) < 58)).alias("tone_rejected"),
        F.sum(count(lambda r: F.coalesce(r["quality_score"], F.lit(100)) < 55)).alias("quality_rejected"),
        F.sum(F.coalesce("local_rejected", F.lit(0))).alias("local_rejected"),
    )


def lock_stats(scenes: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Locked scenes per plan and those left without a visual."""
    s = scenes.groupBy("plan_id").agg(F.count_if("semantic_lock").alias("locked"))
    if manifest is None:
        return s.withColumn("unresolved", F.lit(0).cast("bigint"))
    open_ = manifest.groupBy("plan_id").agg(F.count_if(F.col("status") == "not_found_locked").alias("unresolved"))
    return s.join(open_, "plan_id", "left").fillna(0, ["unresolved"])


def locked_entities(scenes: DataFrame) -> DataFrame:
    """Entities of each locked scene, one row per scene."""
    return scenes.filter("semantic_lock").select("plan_id", "scene_idx", "required_entities")


def plan_summary(scenes: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Scenes, end of the timeline and visuals per plan; canvas when ``plans`` is given."""
    out = scenes.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.max_by("end_ms", "scene_idx").alias("timeline_end_ms"),
        F.count_if(F.coalesce(F.col("asset_kind") != "blank", F.lit(False))).alias("visuals"),
    )
    return out if plans is None else out.join(plans.select("plan_id", "width", "height", "fps"), "plan_id")


def asset_summary(manifest: DataFrame) -> DataFrame:
    """Scenes of each manifest status per plan."""
    return manifest.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("status").startswith("downloaded")).alias("downloaded"),
        F.count_if(F.col("status") == "downloaded_recovery").alias("recovered"), F.count_if(F.col("status").startswith("not_found")).alias("missing"),
    )


def shot_rhythm(spans: DataFrame) -> DataFrame:
    """Number, mean, median and range of the shots of a plan, and the share of video time."""
    length = F.col("hide_ms") - F.col("show_ms")
    video = F.sum(F.when(F.col("asset_kind") == "video", length).otherwise(0))
    return spans.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("shots"), F.round(F.avg(length), 3).alias("mean_ms"), F.median(length).alias("median_ms"),
        F.min(length).alias("min_ms"), F.max(length).alias("max_ms"), F.round(video / F.sum(length), 6).alias("video_share"),
    )


def plan_mood(scenes: DataFrame, rules=R.MOOD_RULES) -> DataFrame:
    """Mood of each plan: the first rule that hits any caption (needles hold no spaces)."""
    v = F.lower(blank(F.col("caption")))
    hits = scenes.groupBy("plan_id").agg(*[F.bool_or(any_of(v, needles)).alias(f"__{i}") for i, (_, needles) in enumerate(rules)])
    mood = F.coalesce(*[F.when(F.col(f"__{i}"), label) for i, (label, _) in enumerate(rules)], F.lit("neutral"))
    return hits.select("plan_id", mood.alias("mood"))
