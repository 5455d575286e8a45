"""Registered queries: text, media and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import media as M, text as T
from ..operators import dedup as D, quality as G, rank as K
from ..sources import readers as S
from ..sources import writers as W
from ..views import Views
from .catalog import NUMBER, PLAN, SCENE, joined, planted, query


@query
def keywords(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", joined(T.useful_keywords(F.col("text"), 8)).alias("keywords"))


@query
def token_stats(v: Views) -> DataFrame:
    """Sizes of the token sets of each document by the four token rules."""
    t = F.col("text")
    return v.table("documents").select(
        "doc_id", F.size(T.tokens(t)).alias("tokens"), F.size(T.fx_tokens(t)).alias("fx"), F.size(F.array_distinct(T.english_tokens(t))).alias("english"),
        T.query_signature(t).alias("signature"),
    )


@query
def cleaned_queries(v: Views) -> DataFrame:
    """The query cleaners over whole documents with planted boilerplate."""
    t = F.concat(F.lit(" -- Stock  Footage, b roll of "), "text", F.lit(" engraving in Qing China, 1800s. "))
    return v.table("documents").select(
        "doc_id", T.clean_action_query(t).alias("action"), T.clean_beat_query(t).alias("beat"), T.clean_overlay_query(t).alias("overlay"),
        F.md5(T.clean_footage_subject(t)).alias("subject"), F.md5(T.strip_constraints(t)).alias("freed"),
    )


@query
def merged_queries(v: Views) -> DataFrame:
    """Lines and sentences of each document merged, first occurrence regardless of case."""
    lines = F.split("text", "\n")
    made = T.merge_queries(lines, F.transform(lines, lambda x: F.lower(x)), F.split("text", "[.!?]"))
    return v.table("documents").select("doc_id", F.size(made).alias("n"), F.md5(joined(made)).alias("digest"))


@query
def quantities(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", T.explicit_quantity(F.col("text"), NUMBER).alias("quantity"))
    return d.filter("quantity is not null")


@query
def spoken_quantities(v: Views) -> DataFrame:
    p = planted(v).select(*SCENE, T.explicit_quantity(F.col("caption")).alias("quantity"))
    return p.filter("quantity is not null")


@query
def caption_queries(v: Views) -> DataFrame:
    """Fallback query, short label and spoken-label test of each planted caption."""
    c = F.col("caption")
    mode = F.when(F.col("scene_idx") % 2 == 0, "video").otherwise("image")
    start = F.array_join(F.slice(T.split_words(c), 1, 3), " ")
    return planted(v).select(
        *SCENE, T.fallback_query(c, mode).alias("fallback"), T.short_label(start).alias("label"), T.label_is_spoken(c, start).alias("spoken"),
        T.label_is_spoken(c, F.lit("Иисуса")).alias("name_spoken"),
    )


@query
def anchor_starts(v: Views) -> DataFrame:
    """Where the last two words of each turn are first spoken in it."""
    w = v.words().groupBy("plan_id", F.col("turn").alias("scene_idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "start_ms", "text"))).alias("ws"))
    anchor = F.array_join(F.transform(F.slice("ws", -2, 2), lambda x: x["text"]), " ")
    return w.filter(F.size("ws") > 1).select(*SCENE, T.anchor_start(F.col("ws"), anchor).alias("at_ms"))


@query
def judge_intents(v: Views) -> DataFrame:
    desc = F.concat(F.col("role"), F.lit(" shot. Soft historical setting: old town, 1850. Wide view -"))
    out = T.judge_intent(desc, F.lit("query"), F.col("caption"), F.col("scene_idx") % 3 == 0)
    return v.scenes().select(*SCENE, out.alias("intent"))


@query
def title_jaccard(v: Views) -> DataFrame:
    """Each title against the four titles before it in its source, and the repeat penalty."""
    c = v.table("documents").select("doc_id", "source", F.regexp_extract("text", "^[^\n]*", 0).alias("title"))
    w = Window.partitionBy("source").orderBy("doc_id")
    before = F.array_compact(F.array(*[F.lag("title", n).over(w) for n in (4, 3, 2, 1)]))
    c = c.withColumn("before", before)
    return c.select(
        "doc_id", F.round(T.title_similarity(F.col("title"), F.col("before")), 6).alias("similarity"),
        F.round(K.repeat_penalty(F.col("title"), F.col("before")), 6).alias("penalty"),
    )


@query
def clean_html(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.md5(T.clean_html(F.col("html"))).alias("digest"), F.length(T.clean_html(F.col("html"))).alias("n"))


@query
def media_values(v: Views) -> DataFrame:
    """Gains, delays, subtitle times, budgets and suffixes from the events."""
    x = F.col("value")
    url = F.concat(F.lit("https://host/a.b/"), "event_type", F.element_at(T.strings(".JPG?x=1.mp4", ".webm", "", ".tar.ogg", ".png#y"), (F.col("event_id") % 5 + 1).cast("int")))
    kind = F.when(F.col("event_id") % 2 == 0, "image").otherwise("video")
    preset = F.element_at(T.strings("none", "reveal_left", "pull_back"), (F.col("event_id") % 3 + 1).cast("int"))
    motion = F.element_at(T.strings("zoom_in", "zoom_out", "pan_left", "pan_right", "none"), (F.col("event_id") % 5 + 1).cast("int"))
    mime = F.element_at(T.strings("image/PNG", "video/ogg", "text/html"), (F.col("event_id") % 3 + 1).cast("int"))
    return v.table("events").select(
        "event_id", F.round(M.db_to_gain(-x), 6).alias("gain"), M.delay_ms(x - 5).alias("delay"), M.ass_time((x * 1234).cast("bigint")).alias("ass"),
        M.beat_budget(x).alias("beats"), M.fx_budget(x).alias("effects"), M.fx_min_target(x, M.fx_budget(x)).alias("wanted"),
        M.target_suffix(url, kind).alias("suffix"), M.kind_from_mime(mime).alias("mime_kind"), M.kind_from_extension(url).alias("ext_kind"),
        M.composition_preset(preset, motion, x % 1).alias("composition"), M.clamp_or_default(F.when(F.col("event_id") % 4 == 0, "bad").otherwise(x.cast("string")), 1.35, 20.0, 1.75).alias("bounded"),
    )


def gray(v: Views) -> DataFrame:
    """A 16 x 16 gray picture of each vector: its 64 values as four rows of differing light."""

    def row(k: int) -> Column:
        return F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * (100 + 9 * k)).cast("int"))

    px = F.flatten(F.array(*[row(k) for k in range(4)]))
    return v.table("embeddings").select("vec_id", F.col("label").alias("plan_id"), px.alias("pixels"))


@query
def picture_hashes(v: Views) -> DataFrame:
    """Bits set in each limb of the average hash, and the similarity to the hash of the inverted picture."""
    g = gray(v).select("vec_id", M.ahash(F.col("pixels")).alias("h"), M.ahash(F.transform("pixels", lambda p: 255 - p)).alias("i"))
    bits = [F.bit_count(F.element_at("h", k + 1)).alias(f"bits{k}") for k in range(4)]
    return g.select("vec_id", *bits, F.round(M.hash_similarity(F.col("h"), F.col("i")), 6).alias("similarity"))


@query
def focus_points(v: Views) -> DataFrame:
    """Centre of a 12 x 12 edge grid drawn from each vector."""
    grid = F.slice(F.flatten(F.array(*[F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.round(x.cast("double"), 3)))] * 3)), 1, 144)
    c = M.edge_centroid(F.when(F.col("vec_id") % 50 == 3, F.transform(grid, lambda _: F.lit(0.0))).otherwise(grid))
    return v.table("embeddings").select("vec_id", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), c["source"].alias("source"))


@query
def image_types(v: Views) -> DataFrame:
    """File types by first bytes, over bytes made from the page ids."""
    head = F.element_at(T.strings("89504E470D0A1A0A00", "FFD8FFE000104A46", "524946460000000057454250", "3C68746D6C3E"), (F.col("page_id") % 4 + 1).cast("int"))
    return v.table("pages").select("page_id", M.image_signature(F.unhex(head)).alias("type"))


@query
def cutouts(v: Views) -> DataFrame:
    """Cut-out test over alpha histograms made from the documents' sizes."""
    d, n = v.table("documents"), F.col("n_chars")
    hist = F.concat(F.array_repeat(F.lit(0), 100), F.array((n % 9000).cast("int")), F.array_repeat(F.lit(0), 154), F.array((10000 - n % 9000).cast("int")))
    ok = M.is_cutout(hist, n % 300, F.lit(100), F.lit(100), n % 101, n % 97)
    return d.select("doc_id", ok.alias("cutout"))


@query
def flat_frames(v: Views) -> DataFrame:
    """Flat-gray test over three sampled frames per user and event type."""
    e = v.table("events")
    f = F.struct(
        F.when(F.col("event_id") % 6 > 0, F.col("value") * 2).alias("satavg"), F.when(F.col("event_id") % 5 > 0, 10.0).alias("ymin"), (10.0 + F.col("value") * 3).alias("ymax")
    )
    g = e.groupBy("user_id", "event_type").agg(F.max_by(f, "event_id").alias("a"), F.min_by(f, "event_id").alias("b"), F.max_by(f, F.col("value")).alias("c"))
    return g.select("user_id", "event_type", M.flat_gray(F.array("a", "b", "c")).alias("flat"))


# --- provider payloads: built from documents, then read back ----------------------


def _payload(v: Views, body: Column) -> DataFrame:
    d = v.candidates().withColumn("payload", F.to_json(body))
    return d.select(F.lit(0).cast("bigint").alias("plan_id"), F.col("cand_id").cast("int").alias("scene_idx"), F.lit(0).alias("query_idx"), F.col("lang").alias("query"), "payload")


def _listed(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("scene_idx", "pos", *cols)


@query
def archive_payloads(v: Views) -> DataFrame:
    i = F.col("cand_id")
    mime = F.element_at(T.strings("image/jpeg", "video/webm", "application/pdf", "image/png"), (i % 4 + 1).cast("int"))
    note = lambda c: F.struct(c.alias("value"))
    meta = F.create_map(
        F.lit("ImageDescription"), note(F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more"))), F.lit("ObjectName"), note(F.lit(" ")),
        F.lit("Categories"), note(F.col("lang")), F.lit("LicenseShortName"), note(F.col("license")),
    )
    info = F.struct(
        mime.alias("mime"), (F.col("size") * 40000).alias("size"), F.col("download_url").alias("url"), F.when(i % 3 > 0, F.concat("download_url", F.lit("/t"))).alias("thumburl"),
        "width", "height", F.concat(F.lit("page/"), "download_url").alias("descriptionurl"), meta.alias("extmetadata"),
    )
    page = F.struct(F.concat(F.lit("File:"), "title").alias("title"), F.when(i % 10 > 0, F.array(info)).alias("imageinfo"))
    out = S.parse_archive_payloads(_payload(v, F.struct(F.struct(F.array(page).alias("pages")).alias("query"))))
    return _listed(out, "kind", "mime", "title", "description", "download_url", "width", "height", "size", "license")


@query
def image_payloads(v: Views) -> DataFrame:
    i = F.col("cand_id")
    tags = F.transform(F.split("title", " "), lambda t: F.struct(t.alias("name")))
    r = F.struct(
        F.when(i % 3 > 0, F.concat("download_url", F.lit("/t"))).alias("thumbnail"), F.when(i % 5 > 0, F.col("download_url")).alias("url"), F.when(i % 4 > 0, F.col("lang")).alias("title"),
        F.col("provider").alias("creator"), tags.alias("tags"), "width", "height", "license", F.lit("land").alias("foreign_landing_url"),
    )
    out = S.parse_openverse_payloads(_payload(v, F.struct(F.array(r).alias("results"))))
    return _listed(out, "title", "description", "download_url", "width", "height", "license", "page_url")


@query
def stock_file_payloads(v: Views) -> DataFrame:
    """Stock videos with three files each: the best one to use and the smallest preview."""
    w, h = F.col("width"), F.col("height")
    file = lambda link, a, b: F.struct(link.alias("link"), a.cast("int").alias("width"), b.cast("int").alias("height"))
    files = F.array(
        file(F.concat("download_url", F.lit("/a")), w, h), file(F.when(F.col("cand_id") % 4 > 0, F.concat("download_url", F.lit("/b"))), h, w),
        file(F.concat("download_url", F.lit("/c")), F.when(F.col("cand_id") % 6 > 0, w / 2).otherwise(0), h / 2),
    )
    r = F.struct(F.col("cand_id").alias("id"), F.lit("u").alias("url"), "width", "height", (F.col("size") / 100.0).alias("duration"), files.alias("video_files"))
    out = S.parse_pexels_payloads(_payload(v, F.struct(F.array(r).alias("videos"))))
    return _listed(out, "title", "description", "download_url", "preview_url", "width", "height")


@query
def stock_variant_payloads(v: Views) -> DataFrame:
    w, h, i = F.col("width"), F.col("height"), F.col("cand_id")
    file = lambda link, a, b: F.struct(link.alias("url"), a.cast("int").alias("width"), b.cast("int").alias("height"))
    videos = F.map_from_arrays(
        T.strings("large", "medium", "small", "tiny"),
        F.array(
            file(F.when(i % 3 > 0, F.concat("download_url", F.lit("/l"))), w, h), file(F.concat("download_url", F.lit("/m")), h, w),
            file(F.concat("download_url", F.lit("/s")), w / 2, h / 2), file(F.when(i % 5 > 0, F.concat("download_url", F.lit("/t"))), h / 4, w / 4),
        ),
    )
    r = F.struct(F.col("cand_id").alias("id"), F.when(i % 2 == 0, F.col("lang")).alias("tags"), F.lit("u").alias("pageURL"), videos.alias("videos"))
    out = S.parse_pixabay_payloads(_payload(v, F.struct(F.array(r).alias("hits"))))
    return _listed(out, "title", "download_url", "preview_url", "width", "height")


# --- quality ------------------------------------------------------------------


@query
def quality_guard(v: Views) -> DataFrame:
    i = F.col("cand_id")
    m = v.candidates().withColumns(
        {
            "title": F.when(i % 9 == 0, F.concat_ws(" ", F.lit("Old poster"), "title")).otherwise(F.col("title")), "duration_ms": (i % 40) * 50,
            "width": F.when(i % 31 == 0, 0).otherwise(F.col("width")),
            "frames": F.when(i % 8 == 0, F.array_repeat(F.struct(F.lit(1.0).alias("satavg"), F.lit(0.0).alias("ymin"), F.lit(20.0).alias("ymax")), 3)),
        }
    )
    return G.quality_guard(m).select("cand_id", "guard_score", joined("issues").alias("issues"), "accept")


def checked(v: Views) -> DataFrame:
    s = v.shots().withColumns(
        {
            "caption": F.when(F.col("scene_idx") % 6 > 0, "text"), "focus_source": F.when(F.col("scene_idx") % 4 > 0, "saliency"),
            "semantic_score": F.when(F.col("scene_idx") % 3 > 0, (F.col("scene_idx") % 40) / 100.0), "asset_score": (F.col("scene_idx") % 7) / 2.0,
        }
    )
    there = v.table("events").filter("event_type <> 'signup'").select(F.col("event_type").alias("asset")).distinct()
    return G.inspect_scenes(s, there)


@query
def scene_qc(v: Views) -> DataFrame:
    return checked(v).select(*SCENE, "ok", "score", joined("reasons").alias("reasons"))


@query
def qc_records(v: Views) -> DataFrame:
    """Check results as they are written, scenes as counts and joined scores."""
    r = W.qc_records(checked(v))
    scores = F.array_join(F.transform("scenes", lambda x: F.floor(x["score"] * 100 + 0.5).cast("string")), "|")
    failed = F.size(F.filter("scenes", lambda x: ~x["ok"]))
    return r.select("plan_id", "ok", "average_score", F.size("scenes").alias("scenes"), scores.alias("scores"), failed.alias("failed"))


@query
def qc_summary(v: Views) -> DataFrame:
    return G.qc_summary(checked(v))
