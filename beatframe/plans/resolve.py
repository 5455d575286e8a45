"""Resolve the scenes of many plans to unique candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import BLOCK, checkpoint, ordered_fold
from ..operators.dedup import cover_blanks
from ..operators.rank import SCENE, fallback_ladder, rank_pool, recovery_pool


def resolve(
    scenes: DataFrame, pools: dict[str, DataFrame], guard: DataFrame, judges: dict[str, DataFrame] | None = None, resolved: DataFrame | None = None
) -> DataFrame:
    """Choose a candidate per scene; within a plan a URL taken by an earlier scene is out.

    ``pools`` maps a level to its ranked pool (see ``fallback_ladder``); scenes in
    ``resolved`` are skipped. All scenes choose at once and choose again while an
    earlier scene holds one of their URLs. Scene by scene this settles on what one
    pass in order would choose. Title penalties use registered titles only.
    """
    todo = scenes if resolved is None else scenes.join(resolved.select(*SCENE), SCENE, "left_anti")
    todo = checkpoint(todo)
    held = None
    while True:
        free = pools
        if held is not None:
            first = held.groupBy("plan_id", "download_url").agg(F.min("scene_idx").alias("__first"))
            free = {}
            for level, pool in pools.items():
                j = pool.join(first, ["plan_id", "download_url"], "left")
                free[level] = j.filter(F.col("__first").isNull() | (F.col("__first") >= F.col("scene_idx"))).drop("__first")
        result = checkpoint(fallback_ladder(todo, guard, free, judges))
        now = result.filter("cand_id is not null").select(*SCENE, "download_url")
        if held is not None and held.exceptAll(now).isEmpty() and now.exceptAll(held).isEmpty():
            return result
        held = now


RANKERS = {"exact": rank_pool, "close": recovery_pool, "context": recovery_pool}


def recent_titles(scenes: DataFrame, chosen: DataFrame, size: int = BLOCK) -> DataFrame:
    """``plan_id, scene_idx, recent``: the last four titles in use before each scene.

    ``scenes`` has ``used_titles``, those registered before the run in order; ``chosen`` has ``plan_id, scene_idx, title``. A title counts where
    it is first used, whatever its case. Positions are dense in a plan; blocks are folded in parallel, four titles are all they hand on.
    """
    same = F.lower(F.trim("title"))
    firsts = chosen.filter(F.length(same) > 0).groupBy("plan_id", same.alias("__t")).agg(F.min_by("title", "scene_idx").alias("fresh"), F.min("scene_idx").alias("scene_idx"))
    known = F.exists("used_titles", lambda t: F.lower(F.trim(t)) == F.col("__t"))
    s = scenes.select(*SCENE, "used_titles").join(firsts, SCENE, "left")
    s = checkpoint(s.withColumn("fresh", F.when(~known, F.col("fresh"))).drop("__t"))

    def step(state, r):
        own = F.filter(state["run"], lambda t: t != "")
        every = F.concat(r["used_titles"], own)
        recent = F.when(F.size(every) > 4, F.slice(every, -4, 4)).otherwise(every)
        after = F.when(r["fresh"].isNotNull(), F.slice(F.array_append(state["run"], r["fresh"]), -4, 4)).otherwise(state["run"])
        return {"run": after}, F.lit(True), F.array(F.struct(r["scene_idx"].alias("scene_idx"), recent.alias("recent")))

    empty = ["", "", "", ""]
    return ordered_fold(s, ["plan_id"], "scene_idx", ["used_titles", "fresh"], {"run": ("array<string>", empty)}, step, "struct<scene_idx:int,recent:array<string>>", size)


def resolve_run(
    scenes: DataFrame, candidates: dict[str, DataFrame], guard: DataFrame, judges: dict[str, DataFrame] | None = None, used_urls: DataFrame | None = None, size: int = BLOCK
) -> DataFrame:
    """Choose a candidate per scene as one pass in order would: URLs of earlier scenes are out, and their titles count as used.

    ``candidates`` maps a level (exact, close, context) to rows as ``rank_pool`` takes them; ``scenes`` has what ``rank_pool``, ``recovery_pool`` and
    ``fallback_ladder`` read, ``used_titles`` being the titles registered before. All scenes choose at once. Then a scene chooses again while what it
    depends on has changed: the last four titles before it, or which of its own candidates earlier scenes hold. Scenes that depend on nothing that
    changed are not looked at again, and a round settles at least the first unsettled scene of every plan.
    """
    free = candidates if used_urls is None else {
        level: c.join(used_urls.select("plan_id", F.col("url").alias("download_url")).distinct(), ["plan_id", "download_url"], "left_anti") for level, c in candidates.items()
    }
    urls = None
    for c in free.values():
        part = c.select(*SCENE, "download_url")
        urls = part if urls is None else urls.unionByName(part)
    urls = checkpoint(urls.distinct())
    todo = checkpoint(scenes)
    asked = scenes.withColumn("__recent", F.when(F.size("used_titles") > 4, F.slice("used_titles", -4, 4)).otherwise(F.col("used_titles")))
    seen = checkpoint(asked.select(*SCENE, F.xxhash64("__recent").alias("__titles"), F.lit(0).cast("bigint").alias("__taken")))
    result, taken, now = None, None, todo
    while True:
        pools = {}
        for level, c in free.items():
            own = c.join(now.select(*SCENE), SCENE, "left_semi")
            if taken is not None:
                own = own.join(taken, [*SCENE, "download_url"], "left_anti")
            pools[level] = checkpoint(RANKERS[level](now, own))
        chosen = fallback_ladder(now, guard, pools, judges).select(*SCENE, "status", "level", "cand_id", "download_url", "title", "combined", "checks")
        result = checkpoint(chosen if result is None else result.join(now.select(*SCENE), SCENE, "left_anti").unionByName(chosen))
        held = result.filter("cand_id is not null").groupBy("plan_id", "download_url").agg(F.min("scene_idx").alias("__first"))
        taken = checkpoint(urls.join(held, ["plan_id", "download_url"]).filter("__first < scene_idx").select(*SCENE, "download_url"))
        recent = checkpoint(recent_titles(scenes, result, size))
        marks = taken.groupBy(*SCENE).agg(F.bit_xor(F.xxhash64("download_url")).alias("__taken"))
        state = recent.join(marks, SCENE, "left").select(*SCENE, F.xxhash64("recent").alias("__titles"), F.coalesce("__taken", F.lit(0)).alias("__taken"))
        state = checkpoint(state)
        changed = checkpoint(state.join(seen, [*SCENE, "__titles", "__taken"], "left_anti").select(*SCENE))
        if changed.isEmpty():
            return result
        now = checkpoint(scenes.join(changed, SCENE, "left_semi").join(recent, SCENE).drop("used_titles").withColumnRenamed("recent", "used_titles"))
        seen = state


def manifest(scenes: DataFrame, result: DataFrame, candidates: DataFrame, reuse: bool = True, size: int = BLOCK) -> DataFrame:
    """One row per scene: what was chosen and how, or why nothing was.

    With ``reuse`` scenes without a choice take the nearest compatible one (``cover_blanks``): their ``status`` is ``fallback_recovery_no_blank`` and
    ``fallback_from_scene`` names the source; else they stay without a path. ``candidates`` gives ``source`` and ``kind`` of the chosen.
    """
    facts = candidates.groupBy(*SCENE, "cand_id").agg(F.min(F.struct("source", "kind")).alias("__c"))
    m = scenes.join(result, SCENE).join(facts, [*SCENE, "cand_id"], "left").withColumns(
        {"path": F.col("download_url"), "source": F.col("__c.source"), "kind": F.coalesce("__c.kind", F.lit("blank")), "recovery_used": F.coalesce(F.col("level") != "exact", F.lit(False))}
    )
    m = checkpoint(m.drop("__c", "download_url").withColumn("fallback_from_scene", F.lit(None).cast("int")))
    if not reuse:
        return m
    fills = cover_blanks(m.withColumns({"asset": F.col("path"), "asset_kind": F.col("kind")}), size)
    fills = fills.select(*SCENE, F.col("source_scene").alias("__s"), F.col("asset").alias("__a"), F.col("asset_kind").alias("__k"))
    taken = F.col("__a").isNotNull()
    return m.join(fills, SCENE, "left").withColumns(
        {
            "status": F.when(taken, "fallback_recovery_no_blank").otherwise(F.col("status")), "path": F.coalesce("__a", "path"), "kind": F.when(taken, F.col("__k")).otherwise(F.col("kind")),
            "fallback_from_scene": F.when(taken, F.col("__s")),
        }
    ).drop("__s", "__a", "__k")
