"""Quality of media files and of the finished scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import bad_title
from ..functions.media import clamp, flat_gray, image_signature
from ..functions.text import filled
from .blocks import BLOCK, prefix

PLAN = ["plan_id"]


def quality_guard(media: DataFrame) -> DataFrame:
    """Score media by metadata: ``guard_score`` (100 at best), ``issues``, ``accept``.

    ``media`` has ``kind, title, description, width, height`` and optionally
    ``probed_width, probed_height`` (of the decoded file; default the stated size),
    ``duration_ms, frames, size, head, decodable``.
    """
    have = set(media.columns)
    col = lambda n, d: F.col(n) if n in have else d
    image, video = F.col("kind") == "image", F.col("kind") == "video"
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    pw, ph = F.coalesce(col("probed_width", w), F.lit(0)), F.coalesce(col("probed_height", h), F.lit(0))
    readable = F.coalesce(col("decodable", F.lit(True)), F.lit(True)) & (F.coalesce(col("size", F.lit(512)), F.lit(0)) >= 512)
    if "head" in have:
        readable = readable & image_signature(F.col("head")).isNotNull()
    known = (w > 0) & (h > 0)
    dead = F.when(image & (~readable | (~known & ((pw == 0) | (ph == 0)))), "undecodable_image").when(
        video & ((pw == 0) | (ph == 0)), "undecodable_video"
    )
    term = bad_title(F.col("title"), F.col("description"))
    long, short = F.greatest(w, h), F.least(w, h)
    duration = F.coalesce(col("duration_ms", F.lit(None).cast("bigint")), F.lit(0))
    rules = [
        (term.isNotNull(), F.concat(F.lit("metadata:"), term), 24),
        (image & F.when(known, long < 700).otherwise(F.greatest(pw, ph) < 700), F.lit("low_resolution"), 35),
        (image & known & long.between(700, 999), F.lit("medium_resolution"), 10),
        (image & known & (short < 320), F.lit("extreme_aspect_or_tiny_short_edge"), 18),
        (video & (F.greatest(pw, ph) < 720), F.lit("low_video_resolution"), 20),
        (video & (duration > 0) & (duration < 650), F.lit("too_short"), 25),
    ]
    if "frames" in have:
        rules.append((video & flat_gray(F.col("frames")), F.lit("flat_gray_video"), 60))
    score = F.lit(100)
    for cond, _, points in rules:
        score = score - F.when(cond, points).otherwise(0)
    issues = F.array_compact(F.array(*[F.when(c, name) for c, name, _ in rules]))
    score = F.when(dead.isNotNull(), 0).otherwise(score)
    return media.withColumns(
        {
            "guard_score": F.greatest(F.lit(0), score),
            "issues": F.when(dead.isNotNull(), F.array(dead)).otherwise(issues),
            "accept": score >= 55,
        }
    )


def inspect_scenes(scenes: DataFrame, media: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Check finished scenes: ``plan_id, scene_idx, ok, score, reasons``.

    ``media`` lists the existing files by ``asset``; without it every asset exists.
    Optional columns: ``focus_source, caption, semantic_score, asset_score``.
    """
    have = set(scenes.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    shown = filled(F.col("asset")) & (F.col("asset_kind") != "blank")
    s = scenes.withColumn("__shown", F.coalesce(shown, F.lit(False)))
    s = prefix(s, PLAN, "scene_idx", {"__prev": ("last", F.when(F.col("__shown"), F.col("asset")))}, size)
    if media is not None:
        s = s.join(media.select("asset").distinct().withColumn("__there", F.lit(True)), "asset", "left")
    missing = F.col("__there").isNull() if media is not None else F.lit(False)
    length, sem = F.col("end_ms") - F.col("start_ms"), col("semantic_score", "double")
    shown = F.col("__shown")
    rules = [
        (~shown, "missing visual asset", 0.75),
        (shown & missing, "asset path does not exist", 0.75),
        (shown & (F.col("asset") == F.col("__prev")), "same asset as previous scene", 0.35),
        (length < 800, "scene too short", 0.15),
        (length > 4000, "scene too long", 0.15),
        ((F.col("asset_kind") == "image") & col("focus_source", "string").isNull(), "no visual focus metadata", 0.1),
        (~filled(col("caption", "string")), "no caption text", 0.08),
        (sem < 0.16, "very weak text-image semantic match", 0.35),
        ((sem >= 0.16) & (sem < 0.20), "weak text-image semantic match", 0.18),
        (col("asset_score", "double") < 1.0, "weak retrieval score", 0.12),
    ]
    score = F.lit(1.0) + F.when(sem >= 0.28, 0.05).otherwise(0.0)
    for cond, _, points in rules:
        score = score - F.when(cond, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t, _ in rules]))
    # Rounded first, so sums of decimal points compare exactly.
    score = F.bround(clamp(score, 0.0, 1.0), 3)
    return s.select("plan_id", "scene_idx", (score >= 0.55).alias("ok"), score.alias("score"), reasons.alias("reasons"))


def qc_summary(qc: DataFrame) -> DataFrame:
    """Per plan: all fine, mean score, number of failed scenes."""
    return qc.groupBy("plan_id").agg(
        F.bool_and("ok").alias("ok"), F.bround(F.avg("score"), 3).alias("average_score"), F.count_if(~F.col("ok")).alias("failed")
    )


def failed_scenes(qc: DataFrame) -> DataFrame:
    return qc.filter(~F.col("ok")).select("plan_id", "scene_idx")
