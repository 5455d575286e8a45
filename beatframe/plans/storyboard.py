"""Beat replies over a transcript to a gap-free list of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C
from ..functions.text import blank, clean_beat_query, fallback_query, first_filled, join_words, merge_queries, squash
from ..operators.blocks import BLOCK, checkpoint, dense_pos
from ..operators.sequence import asof_beat, dedupe_neighbor_queries, normalize_cuts, words_between_cuts
from ..operators.validate import sanitize_beats


def storyboard(words: DataFrame, beats: DataFrame, memes: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Scenes from replies.

    ``beats`` has ``plan_id, reply_pos, start_idx, end_idx, kind, query,
    alternatives, visual_description, meme_filename``; ``memes`` lists the known files.
    """
    clean = checkpoint(sanitize_beats(beats, words))
    cuts = checkpoint(normalize_cuts(clean.select("plan_id", "start_idx"), words, size=size))
    pieces = words_between_cuts(words, cuts, size)
    with_beat = asof_beat(cuts, clean, size)
    s = pieces.join(with_beat, ["plan_id", "cut_idx"])
    s = s.withColumn("caption", join_words(F.transform("words", lambda w: w["text"])))
    if memes is not None:
        known = memes.select(F.col("meme_filename").alias("__file")).distinct()
        s = s.join(known, F.trim(F.col("beat.meme_filename")) == F.col("__file"), "left")
    else:
        s = s.withColumn("__file", F.lit(None).cast("string"))
    kind = F.trim(F.lower(F.coalesce("beat.kind", F.lit("video"))))
    kind = F.when(~kind.isin("video", "image", "meme"), "video").otherwise(kind)
    kind = F.when((kind == "meme") & F.col("__file").isNull(), "video").otherwise(kind)
    s = s.withColumn("__lock", C.semantic_lock(F.col("caption"))).withColumn("__kind", kind)
    lock, kind = F.col("__lock.locked"), F.col("__kind")
    s = s.withColumns(
        {
            "visual_mode": F.when(lock, "image").otherwise(kind),
            "source_mode": F.when(lock, "historical_archive").when(kind == "meme", "meme_library").when(kind == "image", "generic_image").otherwise("stock_video"),
            "motion_preset": F.when(lock, "micro_push").when(kind == "image", "slow_push").otherwise("none"),
            "meme_filename": F.when(~lock & (kind == "meme"), F.col("__file")),
        }
    )
    spare = fallback_query(F.col("caption"), F.col("visual_mode"))
    asked = first_filled(clean_beat_query(F.col("beat.query")), spare)
    queries = merge_queries(F.array(asked), F.coalesce("beat.alternatives", F.array().cast("array<string>")), F.array(spare), clean=clean_beat_query)
    text = first_filled(squash(blank(F.col("beat.visual_description"))), F.col("caption"))
    s = s.withColumn("search_queries", F.slice(queries, 1, 6)).withColumn("query", F.element_at("search_queries", 1))
    s = s.select(
        "plan_id", "cut_idx", "start_ms", "end_ms", "query", "search_queries", F.substring(text, 1, 500).alias("visual_description"), F.lit("blank").alias("asset_kind"),
        "caption", F.col("words").alias("caption_words"), "visual_mode", "source_mode", "motion_preset", "meme_filename", lock.alias("semantic_lock"),
        F.col("__lock.entities").alias("required_entities"), F.col("__lock.context").alias("required_context"), F.col("__lock.fallback").alias("semantic_fallback"),
        C.infer_tone(F.col("caption")).alias("tone"),
    )
    s = dense_pos(checkpoint(s), ["plan_id"], [F.col("cut_idx")], F.floor(F.col("cut_idx") / F.lit(size * 8)), "scene_idx")
    s = checkpoint(s.withColumn("scene_idx", F.col("scene_idx").cast("int")).drop("cut_idx"))
    moved = dedupe_neighbor_queries(s, size=size)
    return s.drop("query", "search_queries").join(moved, ["plan_id", "scene_idx"])
