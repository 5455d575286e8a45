"""Repair passes over finished plans: only scenes with a finding are searched again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import BLOCK, checkpoint
from ..operators.dedup import duplicate_scenes
from ..operators.expand import prepare_repair
from ..operators.quality import failed_scenes, inspect_scenes
from ..operators.sequence import repetition_runs

SCENE = ["plan_id", "scene_idx"]
Search = Callable[[DataFrame, int], DataFrame]


def repair_loop(scenes: DataFrame, search: Search, passes: int = 3, checks: int = 2, media: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Diversity passes, then quality passes, each until nothing is found or the passes end.

    ``search(todo, pass)`` returns ``plan_id, scene_idx, asset, asset_kind`` for
    the scenes it found something for; the others keep what they have. When
    ``media`` (``asset, digest, ahash``) is given, near-duplicates count as well. Only
    those get new queries before they are searched again; repetitions of grammar and
    failed checks are searched with the scene as it is.
    """
    s = checkpoint(scenes)

    def repeated() -> DataFrame | None:
        if media is None:
            return None
        known = s.join(media.select("asset", "digest", "ahash"), "asset", "left")
        return checkpoint(duplicate_scenes(known).select(*SCENE).distinct())

    def renewed(todo: DataFrame, number: int, rewrite: DataFrame | None = None) -> DataFrame:
        asked = s if rewrite is None else checkpoint(prepare_repair(s, rewrite, number))
        got = search(asked.join(todo, SCENE, "left_semi"), number)
        got = got.select(*SCENE, F.col("asset").alias("__a"), F.col("asset_kind").alias("__k"))
        new = asked.join(got, SCENE, "left")
        new = new.withColumn("asset", F.coalesce("__a", "asset")).withColumn("asset_kind", F.coalesce("__k", "asset_kind"))
        return checkpoint(new.select(*scenes.columns))

    for number in range(passes):
        again, runs = repeated(), repetition_runs(s, size=size).select(*SCENE)
        todo = checkpoint((runs if again is None else runs.unionByName(again)).distinct())
        if todo.isEmpty():
            break
        s = renewed(todo, number, again)
    for number in range(checks):
        todo = checkpoint(failed_scenes(inspect_scenes(s, None if media is None else media.select("asset"), size)))
        if todo.isEmpty():
            break
        s = renewed(todo, passes + number)
    return s
