"""Sinks: transcripts, plans, reports and subtitles, one record or file part per plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.media import ass_time
from ..functions.text import blank


def seconds(ms: Column) -> Column:
    return F.round(ms / 1000.0, 3)


def _words(words: Column) -> Column:
    return F.transform(
        words, lambda w: F.struct(seconds(w["start_ms"]).alias("start"), seconds(w["end_ms"]).alias("end"), w["text"].alias("text"))
    )


def transcript_records(words: DataFrame) -> DataFrame:
    """One record per plan: language, duration, joined text and words."""
    language = F.first("language", ignorenulls=True) if "language" in words.columns else F.lit(None).cast("string")
    t = words.groupBy("plan_id").agg(
        language.alias("language"), F.sort_array(F.collect_list(F.struct("idx", "start_ms", "end_ms", "text"))).alias("w")
    )
    return t.select(
        "plan_id", "language", seconds(F.element_at("w", -1)["end_ms"]).alias("duration"),
        F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), _words(F.col("w")).alias("words"),
    )


def write_transcripts(words: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with whole transcripts; a transcript is one record by its format."""
    transcript_records(words).write.mode(mode).json(path)


_SCENE = (
    "query", "asset", "asset_kind", "motion", "caption", "visual_description", "search_queries", "visual_mode", "source_mode", "motion_preset",
    "meme_filename", "semantic_lock", "required_entities", "required_context", "semantic_fallback", "tone", "focus_x", "focus_y", "focus_source",
    "asset_score", "semantic_score",
)


def plan_records(scenes: DataFrame, plans: DataFrame, base: str = "") -> DataFrame:
    """One nested record per plan; asset paths below ``base`` become relative."""
    have = set(scenes.columns)
    if base and "asset" in have:
        root = base.rstrip("/") + "/"
        short = F.when(F.col("asset").startswith(root), F.substr("asset", F.lit(len(root) + 1))).otherwise(F.col("asset"))
        scenes = scenes.withColumn("asset", short)
    fields = [seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), *[F.col(c) for c in _SCENE if c in have]]
    if "caption_words" in have:
        fields.append(_words(F.col("caption_words")).alias("caption_words"))
    listed = scenes.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("scene_idx", F.struct(*fields).alias("s")))).alias("r"))
    listed = listed.select("plan_id", F.transform("r", lambda x: x["s"]).alias("scenes"))
    return plans.join(listed, "plan_id")


def write_plans(scenes: DataFrame, plans: DataFrame, path: str, base: str = "", mode: str = "error") -> None:
    plan_records(scenes, plans, base).write.mode(mode).option("ignoreNullFields", False).json(path)


def cue_records(cues: DataFrame, moods: DataFrame) -> DataFrame:
    """Sound plan per plan: mood, music gain and the cues in order (null where a plan has none)."""
    cue = F.struct("time_ms", "ord", seconds(F.col("time_ms")).alias("time"), "kind", "name", "gain_db")
    listed = cues.groupBy("plan_id").agg(F.sort_array(F.collect_list(cue)).alias("cues"))
    out = moods.join(listed, "plan_id", "left").withColumn("music_gain_db", F.lit(-22.0))
    return out.withColumn("cues", F.transform("cues", lambda c: c.dropFields("time_ms", "ord")))


def write_cues(cues: DataFrame, moods: DataFrame, path: str, mode: str = "error") -> None:
    cue_records(cues, moods).write.mode(mode).json(path)


def qc_records(qc: DataFrame) -> DataFrame:
    """Check results per plan with their summary."""
    row = F.struct("scene_idx", "ok", "score", "reasons")
    return qc.groupBy("plan_id").agg(
        F.bool_and("ok").alias("ok"), F.bround(F.avg("score"), 3).alias("average_score"), F.sort_array(F.collect_list(row)).alias("scenes")
    )


def write_qc(qc: DataFrame, path: str, mode: str = "error") -> None:
    qc_records(qc).write.mode(mode).json(path)


def write_rows(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Manifest or overlay rows as a table, clustered by plan."""
    rows.write.mode(mode).parquet(path)


def _plain(text: Column) -> Column:
    return F.translate(text, "{}", "()")


def subtitle_lines(pages: DataFrame, overlays: DataFrame | None = None, width: int = 1080, height: int = 1920, polish: bool = False) -> DataFrame:
    """Dialogue lines: ``plan_id, layer, start_ms, ord, line``."""
    if polish:
        scale = F.when(F.size(F.split("text", " ")) == 1, 92).otherwise(95)
        style = F.format_string("{\\\\fscx%d\\\\fscy%d\\\\t(0,70,\\\\fscx100\\\\fscy100)\\\\fad(4,8)}", scale, scale)
    else:
        style = F.lit("{\\\\fad(8,12)}")
    line = F.concat(
        F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), style, _plain(F.col("text"))
    )
    out = pages.select("plan_id", F.lit(0).alias("layer"), "start_ms", F.struct(F.col("scene_idx").cast("bigint").alias("scene"), F.col("page").cast("bigint").alias("page")).alias("ord"), line.alias("line"))
    if overlays is None:
        return out
    o = overlays.filter((F.length(F.trim(blank(F.col("label")))) > 0) & (F.col("end_ms") > F.col("start_ms")))
    hero, words = F.col("size") == "hero", F.col("type") == "text"
    label = F.replace(_plain(F.trim("label")), F.lit("\\"), F.lit("\\\\"))
    big = F.greatest(F.lit(92), F.floor(width * F.when(hero, 0.125).otherwise(0.105)))
    scale = F.when(F.col("animation") == "pop", 76).otherwise(88)
    callout = F.format_string(
        f"{{\\an5\\pos({int(width * 0.50)},{int(height * 0.16)})\\fs%d\\bord10\\shad0\\fscx%d\\fscy%d\\t(0,90,\\fscx100\\fscy100)\\fad(2,8)}}", big, scale, scale
    )
    x = F.when(F.col("position") == "left", int(width * 0.25)).when(F.col("position") == "right", int(width * 0.75)).otherwise(int(width * 0.50))
    y = F.when(hero, int(height * 0.30)).otherwise(int(height * 0.28))
    small = F.greatest(F.lit(68), F.floor(width * F.when(hero, 0.088).otherwise(0.074)))
    tag = F.format_string("{\\an5\\pos(%d,%d)\\fs%d\\bord8\\shad0}", x, y, small)
    line = F.concat(
        F.when(words, "Dialogue: 3,").otherwise("Dialogue: 2,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")),
        F.lit(",Default,,0,0,0,,"), F.when(words, callout).otherwise(tag), label,
    )
    lines = o.select("plan_id", F.when(words, 3).otherwise(2).alias("layer"), "start_ms", F.struct(F.col("scene_idx").cast("bigint").alias("scene"), F.lit(0).cast("bigint").alias("page")).alias("ord"), line.alias("line"))
    return out.unionByName(lines)


# Fixed value: the style header of a subtitle file.
SUBTITLE_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: {width}
PlayResY: {height}
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding
Style: Default,Impact,{font},&H00FFFFFF,&H00FFFFFF,&H00000000,&H20000000,-1,0,0,0,96,100,-2,0,1,{outline},0,2,50,50,{margin},1

[Events]
Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text
"""


def subtitle_header(width: int = 1080, height: int = 1920) -> str:
    return SUBTITLE_HEADER.format(
        width=width, height=height, font=max(96, int(width * 0.118)), outline=max(9, int(width * 0.010)), margin=int(height * 0.40)
    )


def write_subtitles(lines: DataFrame, path: str, width: int = 1080, height: int = 1920, mode: str = "error") -> None:
    """One subtitle file per plan, header first, below ``plan_id=...`` folders."""
    body = lines.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct((F.col("layer") > 0).alias("o"), "ord", "start_ms", "line"))).alias("r"))
    text = F.concat(F.lit(subtitle_header(width, height)), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    body.select("plan_id", text.alias("value")).write.mode(mode).partitionBy("plan_id").text(path)
