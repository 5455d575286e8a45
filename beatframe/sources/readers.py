"""Readers: transcripts, plans, provider payloads and media folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.media import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, kind_from_extension, kind_from_mime
from ..functions.text import blank, clean_html, first_filled, squash
from ..operators.blocks import dense_pos
from ..operators.rank import pick_pexels_file, pick_pixabay_variant, smallest_variant

WORDS = "array<struct<start:double,end:double,text:string>>"
TRANSCRIPT = f"language string, words {WORDS}"
SCENE_FIELDS = (
    "start:double,end:double,query:string,asset:string,asset_kind:string,motion:string,caption:string,visual_description:string,"
    "search_queries:array<string>,visual_mode:string,source_mode:string,motion_preset:string,meme_filename:string,semantic_lock:boolean,"
    "required_entities:array<string>,required_context:array<string>,semantic_fallback:string,tone:string,focus_x:double,focus_y:double,"
    f"focus_source:string,asset_score:double,semantic_score:double,caption_words:{WORDS}"
)
PLAN = f"audio string, width int, height int, fps int, director_source string, director_model string, scenes array<struct<{SCENE_FIELDS}>>"
MAX_VIDEO_BYTES = 120 * 1024 * 1024

COMMONS = (
    "query struct<pages:array<struct<title:string,imageinfo:array<struct<mime:string,size:bigint,url:string,thumburl:string,width:int,height:int,"
    "descriptionurl:string,extmetadata:map<string,struct<value:string>>>>>>>"
)
OPENVERSE = (
    "results array<struct<thumbnail:string,url:string,title:string,creator:string,tags:array<struct<name:string>>,width:int,height:int,"
    "license:string,license_url:string,foreign_landing_url:string,detail_url:string>>"
)
PEXELS = "videos array<struct<id:string,url:string,width:int,height:int,duration:double,video_files:array<struct<link:string,width:int,height:int>>>>"
PIXABAY = "hits array<struct<id:string,tags:string,pageURL:string,duration:double,videos:map<string,struct<url:string,width:int,height:int>>>>"


def to_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000).cast("bigint")


def _plan_id(path: Column, root: str) -> Column:
    """Path below the folder that is read, without the extension; plans of equal file names in different folders stay apart."""
    folder = re.sub(r"^[a-z]+:/*(?=/)", "", root).rstrip("/") + "/"
    at = F.locate(folder, path)
    below = F.when(at > 0, F.substr(path, at + len(folder))).otherwise(F.regexp_replace(path, r"^.*/", ""))
    return F.regexp_replace(below, r"\.[^./]*$", "")


def _documents(spark: SparkSession, path: str, schema: str, plan_id: Column | None) -> DataFrame:
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.withColumn("plan_id", _plan_id(F.col("_metadata.file_path"), path) if plan_id is None else plan_id)


def word_structs(words: Column) -> Column:
    """Words of a file as ``start_ms, end_ms, text``; blank words are dropped."""
    made = F.transform(
        F.coalesce(words, F.array().cast(WORDS)),
        lambda w: F.struct(to_ms(w["start"]).alias("start_ms"), to_ms(w["end"]).alias("end_ms"), F.trim(blank(w["text"])).alias("text")),
    )
    return F.filter(made, lambda w: w["text"] != "")


def read_transcripts(spark: SparkSession, path: str, plan_id: Column | None = None) -> DataFrame:
    """Timed words of transcript files, one file per plan: ``plan_id, language, idx, start_ms, end_ms, text``.

    ``plan_id`` is the path below ``path`` without the extension, or the given expression (over ``_metadata.file_path`` and the fields).
    """
    raw = _documents(spark, path, TRANSCRIPT, plan_id)
    return raw.select("plan_id", "language", F.posexplode(word_structs(F.col("words"))).alias("idx", "w")).select(
        "plan_id", "language", "idx", "w.*"
    )


def read_plans(spark: SparkSession, path: str, plan_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenes and plan headers of plan files; missing fields take their defaults."""
    raw = _documents(spark, path, PLAN, plan_id)
    base = F.regexp_replace("_metadata.file_path", r"[^/]*$", "")
    raw = raw.withColumn("__dir", F.regexp_replace(base, "^file:(//)?", ""))
    plans = raw.select(
        "plan_id", "audio", F.coalesce("width", F.lit(1080)).alias("width"), F.coalesce("height", F.lit(1920)).alias("height"),
        F.coalesce("fps", F.lit(30)).alias("fps"), F.coalesce("director_source", F.lit("rules")).alias("director_source"), "director_model",
    )
    s = raw.select("plan_id", "__dir", F.posexplode("scenes").alias("scene_idx", "s"))
    none = F.array().cast("array<string>")
    texts = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(blank(x))), lambda x: x != "")
    either = lambda c, d: F.coalesce(F.col(f"s.{c}"), F.lit(d)).alias(c)
    local = F.col("s.asset").isNotNull() & ~F.col("s.asset").rlike("^(/|[A-Za-z]:|[a-z]+://)")
    scenes = s.select(
        "plan_id", "scene_idx", to_ms(F.col("s.start")).alias("start_ms"), to_ms(F.col("s.end")).alias("end_ms"),
        either("query", ""), F.when(local, F.concat("__dir", "s.asset")).otherwise(F.col("s.asset")).alias("asset"),
        either("asset_kind", "image"), either("motion", "none"), "s.caption", "s.visual_description",
        F.coalesce("s.search_queries", none).alias("search_queries"), either("visual_mode", "auto"), either("source_mode", "auto"),
        either("motion_preset", "slow_push"), "s.meme_filename", either("semantic_lock", False), texts(F.col("s.required_entities")).alias("required_entities"),
        texts(F.col("s.required_context")).alias("required_context"), "s.semantic_fallback", either("tone", "neutral"), "s.focus_x", "s.focus_y",
        "s.focus_source", "s.asset_score", "s.semantic_score", word_structs(F.col("s.caption_words")).alias("caption_words"),
    )
    return scenes, plans


_KEYS = ("plan_id", "scene_idx", "query_idx", "query")


def _candidate(rank: int, source: str, **fields: Column | str | int) -> list[Column]:
    base = {
        "provider_rank": F.lit(rank), "source": F.lit(source), "kind": F.lit("image"), "title": F.lit(""), "description": F.lit(""),
        "download_url": F.lit(""), "page_url": F.lit(""), "preview_url": F.lit(""), "mime": F.lit(""), "width": F.lit(0), "height": F.lit(0),
        "size": F.lit(0).cast("bigint"), "duration": F.lit(None).cast("double"), "license": F.lit(""), "license_url": F.lit(""), "artist": F.lit(""),
    }
    base.update({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()})
    whole = {"width", "height"}
    return [(blank(v) if k not in (*whole, "size", "duration", "provider_rank") else F.coalesce(v, F.lit(0)) if k in whole else v).alias(k) for k, v in base.items()]


def _items(raw: DataFrame, schema: str, path: str) -> DataFrame:
    keys = [k for k in _KEYS if k in raw.columns]
    parsed = raw.select(*keys, F.from_json("payload", schema).alias("p"))
    return parsed.select(*keys, F.posexplode(f"p.{path}").alias("pos", "r"))


def _out(items: DataFrame, cols: list[Column]) -> DataFrame:
    keys = [k for k in (*_KEYS, "pos") if k in items.columns]
    return items.select(*keys, *cols).filter(F.length("download_url") > 0)


def parse_archive_payloads(raw: DataFrame) -> DataFrame:
    """Archive search answers (column ``payload``) to candidate rows."""
    i = _items(raw, COMMONS, "query.pages").withColumn("i", F.try_element_at("r.imageinfo", F.lit(1))).filter("i is not null")
    mime = F.lower(blank(F.col("i.mime")))
    i = i.withColumn("mime", mime).withColumn("kind", kind_from_mime(mime)).filter("kind is not null")
    i = i.filter((F.col("kind") != "video") | (F.coalesce("i.size", F.lit(0)) <= MAX_VIDEO_BYTES))
    meta = lambda k: blank(F.try_element_at("i.extmetadata", F.lit(k))["value"])
    told = F.filter(F.array(*[clean_html(meta(k)) for k in ("ImageDescription", "ObjectName", "Categories")]), lambda x: x != "")
    url = F.when(F.col("kind") == "image", first_filled(F.col("i.thumburl"), F.col("i.url"))).otherwise(F.col("i.url"))
    return _out(
        i,
        _candidate(
            0, "commons", kind=F.col("kind"), mime=F.col("mime"), title=F.regexp_replace(blank(F.col("r.title")), "^File:", ""),
            description=F.array_join(told, " "), download_url=url, page_url=F.col("i.descriptionurl"), width=F.col("i.width"), height=F.col("i.height"),
            size=F.coalesce("i.size", F.lit(0)), license=meta("LicenseShortName"), license_url=meta("LicenseUrl"), artist=clean_html(meta("Artist")),
        ),
    )


def parse_openverse_payloads(raw: DataFrame) -> DataFrame:
    """Image search answers to candidate rows; the thumbnail is preferred."""
    i = _items(raw, OPENVERSE, "results")
    tags = F.array_join(F.transform(F.slice(F.coalesce("r.tags", F.array().cast("array<struct<name:string>>")), 1, 12), lambda t: blank(t["name"])), " ")
    title, creator = F.trim(blank(F.col("r.title"))), F.trim(blank(F.col("r.creator")))
    told = F.filter(F.array(title, creator, tags), lambda x: x != "")
    return _out(
        i,
        _candidate(
            1, "openverse", mime="image/jpeg", title=first_filled(title, F.lit("Openverse image")), description=F.array_join(told, " "),
            download_url=F.trim(first_filled(F.col("r.thumbnail"), F.col("r.url"))), page_url=first_filled(F.col("r.foreign_landing_url"), F.col("r.detail_url")),
            width=F.col("r.width"), height=F.col("r.height"), license=F.col("r.license"), license_url=F.col("r.license_url"), artist=creator,
        ),
    )


def parse_pexels_payloads(raw: DataFrame) -> DataFrame:
    """Video search answers with a list of files: best file and smallest preview."""
    i = _items(raw, PEXELS, "videos")
    files = F.coalesce("r.video_files", F.array().cast("array<struct<link:string,width:int,height:int>>"))
    i = i.withColumn("f", pick_pexels_file(files)).withColumn("s", smallest_variant(files, "link"))
    positive = lambda a, b: F.when(F.col(a) > 0, F.col(a)).otherwise(F.col(b))
    return _out(
        i,
        _candidate(
            2, "pexels", kind="video", mime="video/mp4", title=F.concat(F.lit("Pexels video "), blank(F.col("r.id"))),
            description=F.col("query") if "query" in raw.columns else F.lit(""), download_url=F.col("f.link"), page_url=F.col("r.url"),
            preview_url=first_filled(F.col("s.link"), F.col("f.link")), width=positive("f.width", "r.width"), height=positive("f.height", "r.height"),
            duration=F.coalesce("r.duration", F.lit(0.0)), license="Pexels License",
        ),
    )


def parse_pixabay_payloads(raw: DataFrame) -> DataFrame:
    """Video search answers with named variants: portrait first, then resolution."""
    i = _items(raw, PIXABAY, "hits")
    named = lambda *names: F.array_compact(F.array(*[F.try_element_at("r.videos", F.lit(n)) for n in names]))
    i = i.withColumn("f", pick_pixabay_variant(named("medium", "small", "large", "tiny")))
    i = i.withColumn("s", smallest_variant(named("tiny", "small", "medium", "large"), "url"))
    return _out(
        i,
        _candidate(
            3, "pixabay", kind="video", mime="video/mp4", title=first_filled(F.col("r.tags"), F.concat(F.lit("Pixabay video "), blank(F.col("r.id")))),
            description=F.col("query") if "query" in raw.columns else F.lit(""), download_url=F.col("f.url"), page_url=F.col("r.pageURL"),
            preview_url=first_filled(F.col("s.url"), F.col("f.url")), width=F.col("f.width"), height=F.col("f.height"),
            duration=F.coalesce("r.duration", F.lit(0.0)), license="Pixabay Content License",
        ),
    )


def scan_media_library(spark: SparkSession, folder: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS + IMAGE_EXTENSIONS) -> DataFrame:
    """Files of a media folder without their content: ``path, name, folders, kind, size``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)).select(
        "path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("name"),
        F.translate(F.regexp_replace(F.regexp_extract("path", r"^(?:[a-z]+:)?/*(.*)/[^/]+$", 1), "/+", " "), "", "").alias("folders"),
        kind_from_extension(F.col("path")).alias("kind"), F.col("length").alias("size"),
    )
