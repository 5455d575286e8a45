"""The last passes over resolved plans: repeats are searched again, strict plans climb a ladder of rescues, and what is left is reported."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import BLOCK, checkpoint
from ..operators.dedup import cover_blanks, duplicate_scenes
from ..operators.expand import action_first, prepare_repair

SCENE = ["plan_id", "scene_idx"]


class Step(NamedTuple):
    """What a search is asked for: where in the ranked list to begin, how many candidates and similarity checks at least, and whether replies are judged."""

    name: str
    number: int
    offset: int
    limit: int
    top_k: int
    judged: bool


Search = Callable[[DataFrame, Step], DataFrame]


def _has_visual() -> F.Column:
    return F.coalesce((F.length("asset") > 0) & (F.col("asset_kind") != "blank"), F.lit(False))


class _Passes:
    """The scenes of many plans between passes. Each pass touches only the scenes that ask for it; a plan is done when none of its scenes does."""

    def __init__(self, scenes: DataFrame, search: Search, media: DataFrame | None, size: int):
        self.columns, self.search, self.media, self.size = scenes.columns, search, media, size
        self.now = checkpoint(scenes)

    def repeated(self, strict: bool) -> DataFrame:
        own = self.now.filter(F.col("strict") == strict)
        if self.media is None:
            none = F.lit(None)
            known = own.withColumns({"digest": none.cast("string"), "ahash": none.cast("array<bigint>")})
        else:
            known = own.join(self.media.select("asset", "digest", "ahash"), "asset", "left")
        return checkpoint(duplicate_scenes(known).select(*SCENE).distinct())

    def unresolved(self) -> DataFrame:
        return checkpoint(self.now.filter(F.col("strict") & ~_has_visual()).select(*SCENE))

    def again(self, todo: DataFrame, step: Step, asked: DataFrame) -> None:
        """Search todo with the queries of asked. Scenes without a find become blank; in plans that are not strict blanks take a near visual."""
        got = self.search(asked.join(todo, SCENE, "left_semi"), step)
        got = got.select(*SCENE, F.col("asset").alias("__a"), F.col("asset_kind").alias("__k"))
        new = asked.join(todo.withColumn("__todo", F.lit(True)), SCENE, "left").join(got, SCENE, "left")
        found = F.when(F.col("__todo").isNull(), F.col("asset")).otherwise(F.col("__a"))
        kind = F.when(F.col("__todo").isNull(), F.col("asset_kind")).otherwise(F.coalesce("__k", F.lit("blank")))
        self.now = checkpoint(new.withColumns({"asset": found, "asset_kind": kind}).select(*self.columns))
        self.cover()

    def cover(self) -> None:
        loose = self.now.filter(~F.col("strict"))
        blank = loose.filter(~_has_visual()).select("plan_id").distinct()
        if blank.isEmpty():
            return
        fills = cover_blanks(loose.join(blank, "plan_id", "left_semi"), self.size)
        fills = fills.select(*SCENE, F.col("asset").alias("__a"), F.col("asset_kind").alias("__k"), F.col("motion_preset").alias("__m"))
        new = self.now.join(fills, SCENE, "left")
        values = {"asset": "__a", "asset_kind": "__k", "motion_preset": "__m"}
        self.now = checkpoint(new.withColumns({c: F.coalesce(x, c) for c, x in values.items()}).select(*self.columns))


def finalize(
    scenes: DataFrame, search: Search, media: DataFrame | None = None, diversity_passes: int = 3, final_passes: int = 3, rescues: int = 2, limit: int = 20, top_k: int = 6, size: int = BLOCK
) -> DataFrame:
    """The final scenes with ``problem``: null, ``unresolved`` or ``duplicate``.

    ``scenes`` are full scenes with ``asset, asset_kind`` and two flags of their plan: ``strict`` (no visual may be missing or repeated) and
    ``action_first``. ``search(todo, step)`` returns ``plan_id, scene_idx, asset, asset_kind`` of what it found; ``media`` holds ``asset, digest, ahash``.

    Plans that are not strict: up to ``final_passes`` times scenes that repeat a visual get new queries and are searched again, each pass deeper in the
    ranked list; blanks are covered from near scenes after each. Strict plans climb from rung to rung with the scenes that are still without a visual:
    stock video by action queries (plans with ``action_first``), another medium, then local ranking without a judge; after that, up to ``rescues``
    times, repeats are searched again. Plans are independent: each stops where nothing of its own is left to do. Rows without a plan's flags count as
    not strict; an empty table gives an empty one.
    """
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("strict", "action_first")}
    p = _Passes(scenes.withColumns(flags), search, media, size)
    p.cover()
    for i in range(final_passes):
        todo = p.repeated(strict=False)
        if todo.isEmpty():
            break
        step = Step("anti_repeat", max(1, diversity_passes) + i, max(3, diversity_passes + 1 + i), max(limit, 28 + 4 * i), max(top_k, 8), True)
        p.again(todo, step, checkpoint(prepare_repair(p.now, todo, step.number)))
    todo = p.unresolved()
    rescued = todo.join(p.now.filter("action_first"), SCENE, "left_semi")
    if not rescued.isEmpty():
        rescued = checkpoint(rescued)
        plans = p.now.join(rescued.select("plan_id").distinct(), "plan_id", "left_semi")
        moved = action_first(plans).select(*p.columns)
        others = p.now.join(rescued.select("plan_id").distinct(), "plan_id", "left_anti")
        p.again(rescued, Step("video", 0, 0, max(limit, 40), max(top_k, 12), False), checkpoint(moved.unionByName(others)))
        todo = p.unresolved()
    if not todo.isEmpty():
        p.again(todo, Step("cross_media", 2, 0, max(limit, 32), max(top_k, 10), True), checkpoint(prepare_repair(p.now, todo, 2)))
        todo = p.unresolved()
    if not todo.isEmpty():
        p.again(todo, Step("local", 0, 0, max(limit, 40), max(top_k, 12), False), p.now)
    for i in range(rescues):
        todo = p.repeated(strict=True)
        if todo.isEmpty():
            break
        step = Step("duplicates", 2 + i, 0, max(limit, 36 + 8 * i), max(top_k, 10), i == 0)
        p.again(todo, step, checkpoint(prepare_repair(p.now, todo, step.number)))
    left = p.repeated(strict=True).unionByName(p.repeated(strict=False)).withColumn("__again", F.lit(True))
    problem = F.when(~_has_visual(), "unresolved").when(F.col("__again"), "duplicate")
    return p.now.join(left, SCENE, "left").withColumn("problem", problem).drop("__again")


def verdicts(final: DataFrame) -> DataFrame:
    """Per plan: scenes, unresolved, duplicates, and whether it may be rendered. Strict plans with a problem are refused, by a row and not by an error."""
    count = lambda what: F.count(F.when(F.col("problem") == what, 1))
    plans = final.groupBy("plan_id").agg(
        F.bool_or("strict").alias("strict"), F.count(F.lit(1)).alias("scenes"), count("unresolved").alias("unresolved"), count("duplicate").alias("duplicates")
    )
    return plans.withColumn("accepted", ~F.col("strict") | ((F.col("unresolved") == 0) & (F.col("duplicates") == 0)))
