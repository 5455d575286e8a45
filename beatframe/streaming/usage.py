"""Live usage counts of material from a stream of register and release events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def usage_changes(events: DataFrame) -> DataFrame:
    """Changes of the URL counts of each plan: ``plan_id, scene_idx, url, delta``.

    State is one row per (plan, scene): the URL it holds and the ``seq`` of the event that
    said so. Registering a scene releases what it held before. Only the latest event
    counts, whatever the order of arrival: one with a smaller ``seq`` than the state's, in a
    later batch or chunk, changes nothing. Summing the changes per plan and URL gives the live counts.
    """
    ids = events.select("plan_id", "scene_idx").schema

    def apply(key, batches, state):
        seq, held = state.get if state.exists else (None, None)
        before = held
        for pdf in batches:
            last = pdf.loc[pdf["seq"].idxmax()]
            if seq is None or last["seq"] > seq:
                seq, held = int(last["seq"]), last["url"] if last["op"] == "register" else None
        state.update((seq, held))
        rows = [(*key, before, -1)] * bool(before) + [(*key, held, 1)] * bool(held) if before != held else []
        yield pd.DataFrame(rows, columns=["plan_id", "scene_idx", "url", "delta"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids)
    return events.groupBy("plan_id", "scene_idx").applyInPandasWithState(
        apply, f"{kinds}, url string, delta int", "seq long, url string", "append", "NoTimeout"
    )


def live_usage(changes: DataFrame) -> DataFrame:
    """Counts per plan and URL above zero, from the collected changes."""
    return changes.groupBy("plan_id", "url").agg(F.sum("delta").alias("uses")).filter("uses > 0")
