"""Segmentation over ordered rows: words to scenes, scenes to cards and spans.

Times are whole milliseconds. All operators work on many plans at once and keep
large plans in bounded blocks (see ``blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import beat_role
from ..functions.media import resolved_preset
from ..functions.text import blank, clean_beat_query, first_filled, let, merge_queries, query_signature, split_words, strings
from .blocks import BLOCK, asof, block_window, checkpoint, dense_pos, fold_blocks, halo, join_per_key, ordered_fold, own_rows, prefix

PLAN = ["plan_id"]
SENTENCE_END = "[.!?…]+$"
CELL_MS = 600_000


def _lag(df: DataFrame, pos: str, cols: dict[str, tuple[str, int]], keys=PLAN, size: int = BLOCK) -> DataFrame:
    """Add shifted columns: ``name -> (column, steps)``, negative steps look ahead."""
    back = max([n for _, n in cols.values() if n > 0], default=0)
    ahead = max([-n for _, n in cols.values() if n < 0], default=0)
    w = block_window(keys, pos)
    wide = halo(df, pos, back, ahead, size)
    return own_rows(wide.select("*", *[F.lag(c, n).over(w).alias(name) for name, (c, n) in cols.items()]))


def chunk_words(words: DataFrame, target: int = 1700, minimum: int = 950, maximum: int = 2700, size: int = BLOCK) -> DataFrame:
    """Cut timed words into scenes near the target length.

    Returns ``plan_id, scene_idx, start_ms, end_ms, words``; ``words`` is the
    ordered array of ``idx, start_ms, end_ms, text``. A short rest joins the last scene.
    """
    if minimum <= 0 or target < minimum or maximum < target:
        raise ValueError("scene durations must satisfy 0 < minimum <= target <= maximum")

    def step(state: Column, w: Column):
        def cut_after(first: Column) -> Column:
            long = w["end_ms"] - first
            return (long >= minimum) & ((long >= maximum) | ((long >= target) & w["stop"]) | (long >= target + 320))

        fresh = state["first_ms"].isNull()
        cut = F.when(fresh, cut_after(w["start_ms"])).otherwise(cut_after(state["first_ms"]))
        first = F.when(cut, F.lit(None)).otherwise(F.coalesce(state["first_ms"], w["start_ms"]))
        head = F.when(fresh, w["idx"]).otherwise(state["head"])
        return {"first_ms": first, "head": head}, cut, F.array(w["idx"] % size + 1)

    ready = words.withColumn("stop", F.col("text").rlike(SENTENCE_END))
    short, long = fold_blocks(
        ready, PLAN, "idx", ["start_ms", "end_ms", "text", "stop"],
        {"first_ms": ("bigint", None), "head": ("int", None)}, step, "int", size,
    )
    word = lambda w: F.struct(w["idx"].alias("idx"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["text"].alias("text"))

    def brief(first: Column, last: Column) -> Column:
        return (last["end_ms"] - first["start_ms"]) * 100 < minimum * 68

    def pieces(rows: Column, ends: Column) -> Column:
        """Word arrays between consecutive ends."""
        before = lambda k: F.when(k > 0, F.element_at(ends, k)).otherwise(0)
        return F.transform(ends, lambda e, k: F.slice(rows, before(k) + 1, e - before(k)))

    rows, out = F.col("__rows"), F.col("__out")
    n, last = F.size(rows), F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0))
    rest = (last < n) & ((last == 0) | ~brief(F.element_at(rows, last + 1), F.element_at(rows, -1)))
    ends = F.when(last == n, out).when(rest, F.array_append(out, n)).otherwise(
        F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), n)
    )
    made = short.withColumn("__ends", ends).select("plan_id", F.posexplode(pieces(rows, F.col("__ends"))).alias("scene_idx", "ws"))
    made = made.select(
        "plan_id", "scene_idx", F.element_at("ws", 1)["start_ms"].alias("start_ms"), F.element_at("ws", -1)["end_ms"].alias("end_ms"),
        F.transform("ws", word).alias("words"),
    )
    if long is None:
        return made

    # Scenes of longer plans may cross a block border: join their pieces by first word.
    ends = F.when(last == n, out).otherwise(F.array_append(out, n))
    parts = long.withColumn("__ends", ends).select("plan_id", "__entry", F.posexplode(pieces(rows, F.col("__ends"))).alias("k", "ws"))
    open_head = F.when((F.col("k") == 0) & F.col("__entry.first_ms").isNotNull(), F.col("__entry.head"))
    parts = parts.select("plan_id", F.coalesce(open_head, F.element_at("ws", 1)["idx"]).alias("head"), F.transform("ws", word).alias("ws"))
    chunks = parts.groupBy("plan_id", "head").agg(F.flatten(F.sort_array(F.collect_list("ws"))).alias("words"))
    chunks = chunks.withColumn("first", F.element_at("words", 1)).withColumn("last", F.element_at("words", -1))
    chunks = dense_pos(chunks, PLAN, [F.col("head")], F.floor(F.col("head") / F.lit(size * 8)), "pos")
    near = _lag(chunks, "pos", {"n_first": ("first", -1), "n_last": ("last", -1), "n_words": ("words", -1), "n2": ("pos", -2)}, size=size)
    short_next = F.col("n_first").isNotNull() & F.col("n2").isNull() & brief(F.col("n_first"), F.col("n_last"))
    short_self = F.col("n_first").isNull() & (F.col("pos") > 0) & brief(F.col("first"), F.col("last"))
    joined = near.filter(~short_self).select(
        "plan_id", F.col("pos").cast("int").alias("scene_idx"), "first.start_ms",
        F.when(short_next, F.col("n_last.end_ms")).otherwise(F.col("last.end_ms")).alias("end_ms"),
        F.when(short_next, F.concat("words", "n_words")).otherwise(F.col("words")).alias("words"),
    )
    return made.unionByName(joined)


def nearest_word(asks: DataFrame, words: DataFrame) -> DataFrame:
    """Index of the word that starts nearest to ``target_ms`` between ``low`` and ``high``.

    ``asks`` has ``plan_id, ask_id, target_ms, low, high``; null when the range is
    empty, the lower index on ties.
    """
    w = words.select("plan_id", "idx", "start_ms")
    point = F.struct("idx", "start_ms")
    a = asof(asks, w, PLAN, "target_ms", "start_ms", point, "__before", CELL_MS, prefer=-F.col("idx"))
    a = asof(a, w, PLAN, "target_ms", "start_ms", point, "__after", CELL_MS, after=True, prefer=-F.col("idx"))
    edge = w.select("plan_id", F.col("idx").alias("low"), point.alias("__lo"))
    a = a.join(edge, ["plan_id", "low"], "left")
    edge = w.select("plan_id", F.col("idx").alias("high"), point.alias("__hi"))
    a = a.join(edge, ["plan_id", "high"], "left")

    def bounded(p: Column) -> Column:
        return F.when(p["idx"] < F.col("low"), F.col("__lo")).when(p["idx"] > F.col("high"), F.col("__hi")).otherwise(p)

    options = F.array_compact(F.array(bounded(F.col("__before")), bounded(F.col("__after"))))
    ranked = F.transform(options, lambda p: F.struct(F.abs(p["start_ms"] - F.col("target_ms")).alias("d"), p["idx"].alias("idx")))
    return a.select(
        "plan_id", "ask_id", F.when(F.col("low") <= F.col("high"), F.array_min(ranked)["idx"]).alias("idx")
    )


def asof_beat(cuts: DataFrame, beats: DataFrame, bucket: int = BLOCK) -> DataFrame:
    """Latest beat that starts at or before each cut; the first beat for earlier cuts.

    ``cuts`` has ``plan_id, cut_idx``; ``beats`` has ``plan_id, start_idx`` and any
    other columns, returned as the struct ``beat``.
    """
    beat = F.struct(*[c for c in beats.columns if c != "plan_id"])
    found = asof(cuts, beats, PLAN, "cut_idx", "start_idx", beat, "__latest", bucket)
    found = asof(found, beats, PLAN, "cut_idx", "start_idx", beat, "__next", bucket, after=True)
    return found.withColumn("beat", F.coalesce("__latest", "__next")).drop("__latest", "__next")


def normalize_cuts(beats: DataFrame, words: DataFrame, target: int = 2150, size: int = BLOCK) -> DataFrame:
    """Cut positions of a plan: word 0, no cut within 0.85 s of the last kept one, long gaps split.

    ``beats`` has ``plan_id, start_idx``. Returns ``plan_id, cut_idx``.
    """
    w = words.select("plan_id", "idx", "start_ms", "end_ms")
    asked = beats.select("plan_id", F.col("start_idx").cast("int").alias("idx")).distinct()
    zero = w.filter("idx = 0").select("plan_id", "idx")
    cuts = asked.unionByName(zero).distinct().join(w, ["plan_id", "idx"])
    cuts = checkpoint(dense_pos(checkpoint(cuts), PLAN, [F.col("idx")], F.floor(F.col("idx") / F.lit(size * 8)), "pos"))

    def keep(state: Column, c: Column):
        kept = state["last"].isNull() | (c["start_ms"] - state["last"] >= 850)
        return {"last": F.when(kept, c["start_ms"]).otherwise(state["last"])}, kept, F.array(F.struct(c["idx"].alias("idx")))

    kept = ordered_fold(cuts, PLAN, "pos", ["idx", "start_ms"], {"last": ("bigint", None)}, keep, "struct<idx:int>", size)
    kept = checkpoint(kept.join(w, ["plan_id", "idx"]))
    kept = dense_pos(kept, PLAN, [F.col("idx")], F.floor(F.col("idx") / F.lit(size * 8)), "pos")
    kept = _lag(kept, "pos", {"next_idx": ("idx", -1), "next_ms": ("start_ms", -1)}, size=size)
    last = w.groupBy("plan_id").agg(F.max("idx").alias("last_idx"), F.max_by("end_ms", "idx").alias("plan_end"))
    gaps = join_per_key(kept, last, PLAN, "pos", size=size).select(
        "plan_id", F.col("idx").alias("gap_idx"), F.col("start_ms").alias("gap_ms"),
        F.coalesce("next_idx", F.col("last_idx") + 1).alias("until_idx"), F.coalesce("next_ms", "plan_end").alias("until_ms"),
    )
    long = checkpoint(gaps.filter(F.col("until_ms") - F.col("gap_ms") > 3500))
    inside = asof(w, long, PLAN, "idx", "gap_idx", F.struct("gap_idx", "gap_ms", "until_idx", "until_ms"), "g", size)
    inside = inside.filter((F.col("idx") > F.col("g.gap_idx")) & (F.col("idx") < F.col("g.until_idx")))
    inside = inside.select("plan_id", "g.*", "idx", "start_ms", F.lit(False).alias("stop"))
    stops = long.select("plan_id", "gap_idx", "gap_ms", "until_idx", "until_ms", F.col("until_idx").alias("idx"), F.col("until_ms").alias("start_ms"), F.lit(True).alias("stop"))
    rows = checkpoint(inside.unionByName(stops).withColumn("pos", F.col("idx") - F.col("gap_idx") - 1))

    def split(state: Column, r: Column):
        def wanted(cur: Column) -> Column:  # twice the target time, so halves stay whole
            return cur * 2 + F.least(F.lit(2 * target), r["until_ms"] - cur)

        cur = F.coalesce(state["cur"], r["gap_ms"])
        prev, prev_ms = state["prev"], state["prev_ms"]
        due = (r["until_ms"] - cur > 3500) & (r["stop"] | (r["start_ms"] * 2 >= wanted(cur)))
        use_prev = due & prev.isNotNull() & (r["stop"] | (wanted(cur) - prev_ms * 2 <= r["start_ms"] * 2 - wanted(cur)))
        at = F.when(use_prev, prev_ms).otherwise(cur)
        again = use_prev & ~r["stop"] & (r["until_ms"] - at > 3500) & (r["start_ms"] * 2 >= wanted(at))
        use_self = ~r["stop"] & ((due & ~use_prev) | again)
        out = F.array_compact(F.array(F.when(use_prev, F.struct(prev.alias("idx"))), F.when(use_self, F.struct(r["idx"].alias("idx")))))
        return (
            {
                "cur": F.when(use_self, r["start_ms"]).otherwise(at),
                "prev": F.when(~use_self, r["idx"]),
                "prev_ms": F.when(~use_self, r["start_ms"]),
            },
            use_prev | use_self,
            out,
        )

    added = ordered_fold(
        rows, ["plan_id", "gap_idx"], "pos", ["idx", "start_ms", "gap_ms", "until_ms", "stop"],
        {"cur": ("bigint", None), "prev": ("int", None), "prev_ms": ("bigint", None)}, split, "struct<idx:int>", size,
    )
    return kept.select("plan_id", F.col("idx").alias("cut_idx")).unionByName(added.select("plan_id", F.col("idx").alias("cut_idx"))).distinct()


def words_between_cuts(words: DataFrame, cuts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Words of every piece between two cuts: ``plan_id, cut_idx, start_ms, end_ms, words``."""
    placed = asof(words.select("plan_id", "idx", "start_ms", "end_ms", "text"), cuts, PLAN, "idx", "cut_idx", F.col("cut_idx"), "cut_idx", size)
    word = F.struct("idx", "start_ms", "end_ms", "text")
    return placed.groupBy("plan_id", "cut_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.sort_array(F.collect_list(word)).alias("words")
    )


def contained_words(scenes: DataFrame, words: DataFrame, cell: int = 8192) -> DataFrame:
    """Words lying inside each scene (1 ms tolerance), by an interval join on time cells.

    Returns ``plan_id, scene_idx, words``; scenes without words are absent.
    """
    lo, hi = F.col("start_ms") - 1, F.col("end_ms") + 1
    at = lambda t: F.floor(t / F.lit(cell)).cast("bigint")
    s = scenes.select("plan_id", "scene_idx", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(at(lo), at(hi))).alias("__cell"))
    w = words.select("plan_id", "idx", "start_ms", "end_ms", "text", at(F.col("start_ms")).alias("__cell"))
    hit = s.join(w, ["plan_id", "__cell"]).filter((F.col("start_ms") >= F.col("lo")) & (F.col("end_ms") <= F.col("hi")))
    word = F.struct("idx", "start_ms", "end_ms", "text")
    return hit.groupBy("plan_id", "scene_idx").agg(F.sort_array(F.collect_list(word)).alias("words"))


def attach_word_timings(scenes: DataFrame, words: DataFrame, size: int = BLOCK) -> DataFrame:
    """Attach the transcript words of each scene; a plan with any mismatch stays unchanged.

    Adds ``caption_words`` and ``timing`` ("attached", "kept" or "rejected").
    Words already stored in the scenes are kept when they are this transcript.
    """
    plain = [c for c in scenes.columns if c != "caption_words"]
    word_type = "array<struct<idx:int,start_ms:bigint,end_ms:bigint,text:string>>"
    old = F.col("caption_words").cast(word_type) if "caption_words" in scenes.columns else F.lit(None).cast(word_type)
    base = scenes.select(*plain, old.alias("__old"))
    said = split_words(blank(F.col("caption")))
    has = F.size(said) > 0

    def spoken(ws: Column) -> Column:
        return split_words(F.array_join(F.transform(ws, lambda w: w["text"]), " "))

    found = base.join(contained_words(scenes, words).withColumnRenamed("words", "__new"), ["plan_id", "scene_idx"], "left")
    found = found.withColumn("__fits", ~has | F.coalesce(spoken(F.col("__new")) == said, F.lit(False)))
    stored = base.filter(has).select("plan_id", "scene_idx", "__old", F.coalesce(spoken(F.col("__old")) == said, F.lit(False)).alias("__same"))
    stored = prefix(stored.withColumn("__n", F.coalesce(F.size("__old"), F.lit(0))), PLAN, "scene_idx", {"__at": ("sum", F.col("__n"))}, size)
    listed = stored.select("plan_id", "__at", F.posexplode("__old").alias("p", "w")).select("plan_id", (F.col("__at") + F.col("p")).cast("int").alias("idx"), "w")
    tw = words.select("plan_id", "idx", "start_ms", "end_ms", "text")
    pairs = tw.join(listed, ["plan_id", "idx"], "full_outer")
    equal = F.coalesce(
        (F.col("w.text") == F.col("text")) & (F.abs(F.col("w.start_ms") - F.col("start_ms")) <= 1) & (F.abs(F.col("w.end_ms") - F.col("end_ms")) <= 1),
        F.lit(False),
    )
    same = pairs.groupBy("plan_id").agg(F.bool_and(equal).alias("__words_same"))
    whole = stored.groupBy("plan_id").agg(F.bool_and("__same").alias("__text_same")).join(same, "plan_id", "left")
    fits = found.groupBy("plan_id").agg(F.bool_and("__fits").alias("__all"))
    state = fits.join(whole, "plan_id", "left").select(
        "plan_id",
        F.when(F.coalesce(F.col("__text_same") & F.col("__words_same"), F.lit(False)), "kept").when(F.col("__all"), "attached").otherwise("rejected").alias("timing"),
    )
    out = join_per_key(found, state, PLAN, "scene_idx", size=size)
    fresh = F.when(has, F.col("__new")).otherwise(F.array().cast(word_type))
    return out.select(*plain, F.when(F.col("timing") == "attached", fresh).otherwise(F.col("__old")).alias("caption_words"), "timing")


def display_ranges(scenes: DataFrame, plan_end: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Time on screen of each scene: up to the next start; the last one to the plan's end.

    ``plan_end`` has ``plan_id, end_ms`` (the audio length); without it the last
    scene keeps its own end. Adds ``show_ms, hide_ms``.
    """
    s = _lag(scenes, "scene_idx", {"__next": ("start_ms", -1)}, size=size)
    own = F.col("end_ms")
    if plan_end is not None:
        s = join_per_key(s, plan_end.select("plan_id", F.col("end_ms").alias("__plan_end")), PLAN, "scene_idx", size=size)
        own = F.col("__plan_end")
    show = F.when(F.col("scene_idx") == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0), F.col("start_ms")))
    s = s.withColumn("show_ms", show).withColumn("hide_ms", F.greatest(F.col("show_ms") + 50, F.coalesce(F.col("__next"), own)))
    return s.drop("__next", "__plan_end")


def visual_spans(ranges: DataFrame, longest: int = 2850, size: int = BLOCK) -> DataFrame:
    """Merge neighbouring scenes that show the same visual into spans of bounded length.

    ``ranges`` comes from ``display_ranges`` with ``asset, asset_kind`` and optionally
    ``motion_preset, motion, focus_x, focus_y``. Returns ``plan_id, first_scene,
    asset, asset_kind, show_ms, hide_ms, scenes``.
    """
    have = set(ranges.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    focus = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)) if c in have else F.lit(0.5)
    r = ranges.select(
        "plan_id", "scene_idx", "show_ms", "hide_ms", "asset", "asset_kind",
        resolved_preset(text("motion_preset"), text("motion")).alias("preset"), focus("focus_x").alias("fx"), focus("focus_y").alias("fy"),
    )

    def step(state: Column, r: Column):
        both_blank = (r["asset_kind"] == "blank") & (state["asset_kind"] == "blank")
        same = both_blank | (
            (r["asset_kind"] != "blank") & (r["asset_kind"] == state["asset_kind"]) & F.coalesce(r["asset"] == state["asset"], F.lit(False))
            & (F.length(r["asset"]) > 0) & (r["preset"] == state["preset"]) & (F.abs(r["fx"] - state["fx"]) <= 0.03) & (F.abs(r["fy"] - state["fy"]) <= 0.03)
        )
        merge = F.coalesce(
            same & (F.abs(r["show_ms"] - state["end"]) <= 80) & (r["hide_ms"] - state["start"] <= longest), F.lit(False)
        )
        keep = lambda f, v: F.when(merge, state[f]).otherwise(v)
        first = keep("first", r["scene_idx"])
        row = F.struct(
            first.alias("first_scene"), r["scene_idx"].alias("scene_idx"), r["show_ms"].alias("show_ms"), r["hide_ms"].alias("hide_ms"),
            r["asset"].alias("asset"), r["asset_kind"].alias("asset_kind"),
        )
        changed = {
            "first": first, "start": keep("start", r["show_ms"]), "end": r["hide_ms"],
            **{f: keep(f, r[f]) for f in ("asset", "asset_kind", "preset", "fx", "fy")},
        }
        return changed, F.lit(True), F.array(row)

    zero = {
        "first": ("int", None), "start": ("bigint", None), "end": ("bigint", None), "asset": ("string", None),
        "asset_kind": ("string", None), "preset": ("string", None), "fx": ("double", None), "fy": ("double", None),
    }
    rows = ordered_fold(
        r, PLAN, "scene_idx", ["show_ms", "hide_ms", "asset", "asset_kind", "preset", "fx", "fy"], zero, step,
        "struct<first_scene:int,scene_idx:int,show_ms:bigint,hide_ms:bigint,asset:string,asset_kind:string>", size,
    )
    return rows.groupBy("plan_id", "first_scene").agg(
        F.min_by("asset", "scene_idx").alias("asset"), F.min_by("asset_kind", "scene_idx").alias("asset_kind"),
        F.min_by("show_ms", "scene_idx").alias("show_ms"), F.max_by("hide_ms", "scene_idx").alias("hide_ms"), F.count(F.lit(1)).alias("scenes"),
    )


# Fixed value: characters cut from the edges of a caption word before its length counts.
# The letters t, r, n and the backslash belong to it.
CARD_EDGE = r"""[ \\trn,.;:!?—–\-()\[\]«»"']"""


def _card_token(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(word, f"^{CARD_EDGE}+", ""), f"{CARD_EDGE}+$", ""))


def _braces(text: Column) -> Column:
    return F.translate(text, "{}", "()")


def timings_aligned(words: Column, tokens: Column, start: Column, end: Column) -> Column:
    """Do the timed words describe exactly this caption inside this scene?"""

    def fine(p: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(p["ws"], i)["start_ms"]).otherwise(F.lit(-1000))
            ok = (
                (F.trim(_braces(w["text"])) == F.try_element_at(p["tok"], i + 1))
                & (w["start_ms"] >= p["s"] - 1) & (w["end_ms"] <= p["e"] + 1)
                & (w["end_ms"] > w["start_ms"]) & (w["start_ms"] > before) & (w["start_ms"] < p["e"])
            )
            return F.coalesce(ok, F.lit(False))

        same = (F.size(p["ws"]) > 0) & (F.size(p["ws"]) == F.size(p["tok"]))
        return F.coalesce(same & F.forall(F.transform(p["ws"], word), lambda x: x), F.lit(False))

    return let(F.struct(words.alias("ws"), tokens.alias("tok"), start.alias("s"), end.alias("e")), fine)


def caption_pages(scenes: DataFrame, words: str | None = "caption_words") -> DataFrame:
    """Caption cards of one or two words.

    ``scenes`` has ``plan_id, scene_idx, start_ms, end_ms, caption`` and the timed
    words. Cards follow the timings when these fit the caption; otherwise they
    share the scene by text length. Returns ``plan_id, scene_idx, page, start_ms,
    end_ms, text, aligned``.
    """
    word_type = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    timed = F.lit(None).cast(word_type) if words is None else F.transform(
        F.col(words), lambda w: F.struct(w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["text"].alias("text"))
    )
    at = lambda arr, k: F.try_element_at(arr, k)

    # Every step binds its inputs once, so nothing is split or matched again per card.
    def measured(p: Column) -> Column:
        return F.struct(
            p["tok"].alias("tok"), p["ws"].alias("ws"), p["s"].alias("s"), p["e"].alias("e"),
            timings_aligned(p["ws"], p["tok"], p["s"], p["e"]).alias("aligned"),
            F.transform(p["tok"], lambda t: F.length(_card_token(t))).alias("len"),
            F.transform(p["tok"], lambda t: t.rlike("[,;:.!?]$")).alias("brk"),
        )

    def grouped(p: Column) -> Column:
        def pair(i: Column) -> Column:
            pause = at(p["ws"], i + 1)["start_ms"] - at(p["ws"], i)["end_ms"]
            short = (at(p["len"], i) <= 3) | (at(p["len"], i + 1) <= 3)
            return F.coalesce((i < F.size(p["tok"])) & ~at(p["brk"], i) & (~p["aligned"] | (pause <= 180)) & short, F.lit(False))

        def add(acc: Column, i: Column) -> Column:
            last = F.when(pair(i), i + 1).otherwise(i)
            taken = F.struct((last + 1).alias("next"), F.array_append(acc["out"], F.struct(i.alias("a"), last.alias("b"))).alias("out"))
            return F.when(i == acc["next"], taken).otherwise(acc)

        zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
        groups = F.aggregate(F.sequence(F.lit(1), F.size(p["tok"])), zero, add)["out"]

        def grown(acc: Column, g: Column) -> Column:
            weight = F.greatest(F.lit(2), at(p["len"], g["a"])) + F.when(g["b"] > g["a"], F.greatest(F.lit(2), at(p["len"], g["b"]))).otherwise(0)
            return F.array_append(acc, F.element_at(acc, -1) + weight)

        return let(
            groups,
            lambda g: F.struct(p.alias("p"), g.alias("g"), F.aggregate(g, F.array(F.lit(0)), grown).alias("cum")),
        )

    def cards(c: Column) -> Column:
        p, s, e = c["p"], c["p"]["s"], c["p"]["e"]
        n, total = F.size(c["g"]), F.element_at(c["cum"], -1)

        def cursor(k: Column) -> Column:
            """Cursor before card ``k`` in whole ms."""
            reached = s + F.floor(F.greatest(F.lit(60), e - s) * F.element_at(c["cum"], k + 1) / total + 0.5)
            return F.when(k == 0, s).when(k == n, e).otherwise(F.least(e, reached)).cast("bigint")

        def card(g: Column, k: Column) -> Column:
            first, last = at(p["ws"], g["a"]), at(p["ws"], g["b"])
            start = F.when(p["aligned"], F.greatest(s, first["start_ms"])).otherwise(cursor(k))
            end = F.when(
                p["aligned"], F.least(e, last["end_ms"], F.coalesce(at(p["ws"], g["b"] + 1)["start_ms"], last["end_ms"]))
            ).otherwise(F.greatest(cursor(k) + 50, cursor(k + 1)))
            text = F.array_join(F.slice(p["tok"], g["a"], g["b"] - g["a"] + 1), " ")
            return F.struct(k.cast("int").alias("page"), start.alias("start_ms"), end.alias("end_ms"), text.alias("text"), p["aligned"].alias("aligned"))

        return F.transform(c["g"], card)

    bundle = F.struct(split_words(_braces(blank(F.col("caption")))).alias("tok"), timed.alias("ws"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    pages = let(bundle, lambda b: F.when(F.size(b["tok"]) > 0, let(measured(b), lambda m: let(grouped(m), cards))))
    return scenes.select("plan_id", "scene_idx", F.inline(pages))


def repetition_runs(scenes: DataFrame, longest: int = 2600, window: int = 3, size: int = BLOCK) -> DataFrame:
    """Scenes to replace because their asset runs too long or returns too soon.

    Needs ``asset, asset_kind, semantic_lock``. Returns ``plan_id, scene_idx, rule``.
    """
    key = F.when((F.col("asset_kind") != "blank") & (F.length("asset") > 0), F.lower("asset"))
    shown = display_ranges(scenes.withColumn("__key", key), size=size)
    shown = shown.withColumn("__dur", F.col("hide_ms") - F.col("show_ms"))
    near = _lag(shown, "scene_idx", {f"__k{n}": ("__key", n) for n in range(1, window + 1)}, size=size)
    near = near.withColumn("__new", ~F.coalesce(F.col("__key") == F.col("__k1"), F.lit(False)))
    run = prefix(near, PLAN, "scene_idx", {"__before": ("sum", F.col("__dur"))}, size)
    run = prefix(run, PLAN, "scene_idx", {"__run": ("last", F.when(F.col("__new"), F.col("__before")))}, size)
    length = F.col("__before") + F.col("__dur") - F.col("__run")
    too_long = ~F.col("__new") & (length * 100 > F.when(F.col("semantic_lock"), longest * 135).otherwise(longest * 100))
    back = F.lit(False)
    for n in range(2, window + 1):
        back = back | F.coalesce(F.col(f"__k{n}") == F.col("__key"), F.lit(False))
    returns = F.col("__key").isNotNull() & ~F.col("semantic_lock") & back
    return run.filter(too_long | returns).select(
        "plan_id", "scene_idx", F.when(too_long, "run").otherwise("return").alias("rule")
    )


def dedupe_neighbor_queries(scenes: DataFrame, memory: int = 4, size: int = BLOCK) -> DataFrame:
    """A scene whose query was chosen in the last few scenes moves to an unused alternative.

    Returns ``plan_id, scene_idx, query, search_queries``.
    """
    key = lambda q: F.lower(F.trim(q))

    def step(state: Column, s: Column):
        unused = F.filter(s["search_queries"], lambda q: ~F.array_contains(state["recent"], key(q)))
        move = F.array_contains(state["recent"], key(s["query"])) & (F.size(unused) > 0)
        queries = F.when(move, merge_queries(unused, s["search_queries"], clean=clean_beat_query)).otherwise(s["search_queries"])
        made = F.struct(F.when(move, F.try_element_at(queries, F.lit(1))).otherwise(s["query"]).alias("q"), queries.alias("qs"))
        row = let(made, lambda m: F.struct(s["scene_idx"].alias("scene_idx"), m["q"].alias("query"), m["qs"].alias("search_queries")))
        chosen = F.when(move, clean_beat_query(F.try_element_at(unused, F.lit(1)))).otherwise(s["query"])
        grown = F.array_append(state["recent"], key(chosen))
        recent = F.when(F.size(grown) > memory, F.slice(grown, -memory, memory)).otherwise(grown)
        return {"recent": recent}, F.lit(True), F.array(row)

    return ordered_fold(
        scenes, PLAN, "scene_idx", ["query", "search_queries"], {"recent": ("array<string>", [])}, step,
        "struct<scene_idx:int,query:string,search_queries:array<string>>", size,
    )


# The query that varies a repeated shot, by role.
VARIATIONS = {
    "reaction": "close emotional reaction face disappointment",
    "awakening": "close up person waking from dream",
    "vision": "human silhouette experiencing mystical vision",
    "revelation": "human silhouette experiencing mystical vision",
    "army": "historical soldiers marching close detail",
    "aftermath": "close detail destruction mourning aftermath",
    "battle": "historical battle action close detail",
}


def fill_sequence_variation(scenes: DataFrame, size: int = BLOCK) -> DataFrame:
    """An unlocked scene asking for the same shot as its predecessor gets a variation query.

    The predecessor counts as already changed. Returns ``plan_id, scene_idx,
    query, search_queries, varied``.
    """
    role = beat_role(F.col("caption"))
    detail = F.coalesce(*[F.when(role == r, F.lit(v)) for r, v in VARIATIONS.items()], F.lit(""))
    wish = lambda q: first_filled(q, F.col("visual_description"))
    ready = scenes.select(
        "plan_id", "scene_idx", "query", "search_queries", "semantic_lock", query_signature(wish(F.col("query"))).alias("sig"), detail.alias("detail")
    )
    ready = ready.withColumn("varied_queries", F.slice(merge_queries(F.array("detail"), F.col("search_queries")), 1, 5))
    ready = ready.withColumn("varied_sig", query_signature(F.col("detail")))

    def step(state: Column, s: Column):
        vary = F.coalesce(
            ~s["semantic_lock"] & ~state["locked"] & (s["sig"] != "") & (s["sig"] == state["sig"]) & (s["detail"] != ""), F.lit(False)
        )
        row = F.struct(
            s["scene_idx"].alias("scene_idx"), F.when(vary, s["detail"]).otherwise(s["query"]).alias("query"),
            F.when(vary, s["varied_queries"]).otherwise(s["search_queries"]).alias("search_queries"), vary.alias("varied"),
        )
        return {"sig": F.when(vary, s["varied_sig"]).otherwise(s["sig"]), "locked": s["semantic_lock"]}, F.lit(True), F.array(row)

    return ordered_fold(
        ready, PLAN, "scene_idx", ["query", "search_queries", "semantic_lock", "sig", "detail", "varied_queries", "varied_sig"],
        {"sig": ("string", None), "locked": ("boolean", True)}, step,
        "struct<scene_idx:int,query:string,search_queries:array<string>,varied:boolean>", size,
    )
