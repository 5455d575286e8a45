"""Numeric, bit and binary functions over media metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let


def clamp(value: Column, low, high) -> Column:
    """Bounded value; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def clamp_or_default(value: Column, low: float, high: float, default: float) -> Column:
    return F.coalesce(clamp(value.cast("string").try_cast("double"), low, high), F.lit(default))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - share of different bits between two 256-bit hashes (four 64-bit limbs)."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return 1.0 - apart / 256.0


def ahash(pixels: Column) -> Column:
    """Average hash of 256 gray pixels: bit i is set when pixel i reaches the mean."""

    def pack(total: Column) -> Column:
        def limb(start: int) -> Column:
            return F.aggregate(
                F.slice(pixels, start, 64),
                F.lit(0).cast("bigint"),
                lambda acc, p: F.shiftleft(acc, 1).bitwiseOR((p * 256 >= total).cast("bigint")),
            )

        return F.array(limb(1), limb(65), limb(129), limb(193))

    total = F.aggregate(F.slice(pixels, 1, 256), F.lit(0).cast("bigint"), lambda s, p: s + p)
    return F.when(F.size(pixels) >= 256, let(total, pack))


def edge_centroid(grid: Column) -> Column:
    """Weighted centre of a 12 x 12 edge grid given row by row."""

    def centre(total: Column) -> Column:
        def axis(index) -> Column:
            moved = F.transform(grid, lambda v, i: v * (index(i) + 0.5))
            return clamp(F.aggregate(moved, F.lit(0.0), lambda s, v: s + v) / total / 12.0, 0.0, 1.0)

        return F.when(
            total > 1e-6,
            F.struct(axis(lambda i: i % 12).alias("x"), axis(lambda i: F.floor(i / 12)).alias("y"), F.lit("saliency").alias("source")),
        ).otherwise(F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit("center").alias("source")))

    return let(F.aggregate(grid, F.lit(0.0), lambda s, v: s + v), centre)


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def delay_ms(seconds: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.bround(seconds * 1000).cast("bigint"))


def ass_time(ms: Column) -> Column:
    """h:mm:ss.cc of a time in milliseconds."""
    cs = F.bround(F.greatest(ms, F.lit(0)) / 10).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100,
    )


def beat_budget(seconds: Column) -> Column:
    return clamp(F.bround(seconds / 2.15), 5.0, 18.0).cast("int")


def fx_budget(seconds: Column) -> Column:
    return clamp(F.bround(seconds / 5.5), 2.0, 8.0).cast("int")


def fx_min_target(seconds: Column, budget: Column) -> Column:
    return F.least(budget, F.greatest(F.lit(2), F.bround(seconds / 7.0).cast("int")))


def image_signature(head: Column) -> Column:
    """Image type by its first bytes; null when unknown."""
    h = F.hex(F.substring(head, 1, 16))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def kind_from_mime(mime: Column) -> Column:
    m = F.lower(mime)
    return F.when(m.isin("image/jpeg", "image/png", "image/webp"), "image").when(
        m.isin("video/webm", "video/mp4", "video/ogg"), "video"
    )


# File extensions by kind.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".webm", ".avi")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def kind_from_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*VIDEO_EXTENSIONS), "video").when(ext.isin(*IMAGE_EXTENSIONS), "image")


def target_suffix(url: Column, kind: Column) -> Column:
    """File suffix a download gets: the one of the URL path if it fits the kind."""
    ext = extension(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1))
    return (
        F.when((kind == "image") & ~ext.isin(*IMAGE_EXTENSIONS), ".jpg")
        .when((kind == "video") & ~ext.isin(*VIDEO_EXTENSIONS, ".ogv", ".ogg"), ".mp4")
        .when(ext != "", ext)
        .when(kind == "image", ".jpg")
        .otherwise(".mp4")
    )


def resolved_preset(preset: Column, motion: Column) -> Column:
    kept = F.coalesce(preset, F.lit("none"))
    return (
        F.when(~kept.isin("none", ""), kept)
        .when(motion == "zoom_in", "slow_push").when(motion == "zoom_out", "pull_back")
        .when(motion == "pan_left", "reveal_left").when(motion == "pan_right", "reveal_right")
        .otherwise("none")
    )


def composition_preset(preset: Column, motion: Column, focus_x: Column) -> Column:
    base = resolved_preset(preset, motion)
    return (
        F.when(~base.isin("reveal_left", "reveal_right"), base)
        .when(focus_x.between(0.40, 0.60), "slow_push")
        .when(focus_x < 0.40, "reveal_left")
        .otherwise("reveal_right")
    )


def flat_gray(frames: Column) -> Column:
    """True when at least two of the sampled frames are nearly colourless and flat."""
    seen = F.filter(frames, lambda f: f["ymin"].isNotNull() & f["ymax"].isNotNull())
    bad = F.filter(seen, lambda f: (F.coalesce(f["satavg"], F.lit(999.0)) < 9.0) & (f["ymax"] - f["ymin"] < 34.0))
    return F.coalesce((F.size(seen) >= 2) & (F.size(bad) >= 2), F.lit(False))


def is_cutout(hist: Column, alpha_min: Column, width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Meaningful transparency by the 256-bin alpha histogram and the bounding box."""

    def share(start: int, count: int) -> Column:
        return F.aggregate(F.slice(hist, start, count), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.lit(1), width * height)

    occupancy = F.greatest(F.lit(1), box_w) * F.greatest(F.lit(1), box_h) / F.greatest(F.lit(1), width * height)
    return F.coalesce(
        (alpha_min < 245)
        & share(1, 220).between(0.06, 0.92)
        & (share(246, 11) >= 0.05)
        & occupancy.between(0.08, 0.96),
        F.lit(False),
    )
