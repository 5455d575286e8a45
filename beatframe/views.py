"""Views that dress the driver's tables as tables of this engine (see FIXTURES.md).

Titles are first lines, descriptions and queries are whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .operators.blocks import checkpoint, dense_pos, prefix


class Views:
    """Lazy access to the views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make) -> DataFrame:
        """Materialise a derived view that a query reads several times."""
        if name not in self._made:
            self._made[name] = checkpoint(make())
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _said(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").cast("int").alias("turn"), "text")

    def _spoken(self, said: DataFrame) -> DataFrame:
        """One row per word with its length and the pause after it, in ms; further columns of the turn are carried along."""
        turn = [c for c in said.columns if c != "text"]
        t = said.select(*turn, F.posexplode(F.split("text", "[ \\n]+")).alias("p", "text"))
        stop = F.substring("text", -1, 1).isin(".", "!", "?")
        return t.filter("text <> ''").select(
            *turn, "p", "text", (90 + 45 * F.least(F.length("text"), F.lit(12))).cast("bigint").alias("dur"),
            F.when(stop, 300).otherwise(40).cast("bigint").alias("gap"),
        )

    def _turns(self) -> DataFrame:
        """Word count, length and offsets of every turn within its plan."""
        t = self._spoken(self._said()).groupBy("plan_id", "turn").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("dur") + F.col("gap")).alias("total"), F.max_by("gap", "p").alias("rest")
        )
        return prefix(t, ["plan_id"], "turn", {"idx0": ("sum", F.col("n")), "t0": ("sum", F.col("total"))})

    def words(self) -> DataFrame:
        return self.once("words", self._words)

    def scenes(self) -> DataFrame:
        return self.once("scenes", self._scenes)

    def shots(self) -> DataFrame:
        return self.once("shots", self._shots)

    def turns(self) -> DataFrame:
        return self.once("turns", self._turns)

    def _words(self) -> DataFrame:
        inside = Window.partitionBy("plan_id", "turn").orderBy("p")
        earlier = F.sum(F.col("dur") + F.col("gap")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        # texts meet their turns before they are cut into words, so no exchange carries words
        w = self._spoken(self._said().join(self.turns().select("plan_id", "turn", "idx0", "t0"), ["plan_id", "turn"]))
        w = w.withColumn("k", F.row_number().over(inside) - 1).withColumn("start_ms", F.col("t0") + F.coalesce(earlier, F.lit(0)))
        return w.select(
            "plan_id", "turn", (F.col("idx0") + F.col("k")).cast("int").alias("idx"), "start_ms",
            (F.col("start_ms") + F.col("dur")).alias("end_ms"), "text",
        )

    def _scenes(self) -> DataFrame:
        c = self.table("conversations").select(
            F.col("conv_id").alias("plan_id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("caption"), "role"
        )
        t = self.turns().join(c, ["plan_id", "turn"])
        return t.select(
            "plan_id", F.col("turn").alias("scene_idx"), F.col("t0").alias("start_ms"),
            (F.col("t0") + F.col("total") - F.col("rest")).alias("end_ms"), "caption", "role",
        )

    def candidates(self) -> DataFrame:
        d = self.table("documents")
        slot = F.substring("source", 4, 20).cast("int") % 4
        return d.select(
            F.col("doc_id").alias("cand_id"),
            F.when(slot == 0, "commons").when(slot == 1, "openverse").when(slot == 2, "pexels").otherwise("pixabay").alias("provider"),
            F.when(slot < 2, "image").otherwise("video").alias("kind"),
            F.regexp_extract("text", "^[^\\n]*", 0).alias("title"), F.col("text").alias("description"),
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("download_url"),
            (320 + (F.col("doc_id") * 37) % 1800).cast("int").alias("width"),
            (320 + (F.col("doc_id") * 53) % 1800).cast("int").alias("height"),
            F.when(F.col("doc_id") % 3 == 0, "").otherwise("cc").alias("license"),
            F.col("n_chars").alias("size"), "lang",
        )

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").cast("int").alias("query_id"), F.col("text").alias("query")
        )

    def _shots(self) -> DataFrame:
        e = dense_pos(
            self.table("events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "scene_pos"
        )
        i, s = F.col("event_id"), F.col("scene_pos")
        start = s * 1500 + (i % 7) * 50
        return e.select(
            F.col("user_id").alias("plan_id"), s.cast("int").alias("scene_idx"), start.cast("bigint").alias("start_ms"),
            (start + 700 + (i % 5) * 100).cast("bigint").alias("end_ms"),
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("asset"),
            F.when(F.col("event_type") == "error", "blank").when(F.col("event_type") == "view", "image").otherwise("video").alias("asset_kind"),
            (i % 11 == 0).alias("semantic_lock"),
            F.when(i % 5 == 0, "neutral").when(i % 5 == 1, "tragic").when(i % 5 == 2, "funny").when(i % 5 == 3, "tense")
            .otherwise("positive").alias("tone"),
        )

    def registry_log(self) -> DataFrame:
        e = self.table("events")
        label = (F.floor("value").cast("bigint") % 20).cast("string")
        return e.select(
            F.col("user_id").alias("plan_id"), F.col("event_id").alias("seq"),
            F.when(F.col("event_type").isin("error", "signup"), "release").otherwise("register").alias("op"),
            (F.col("event_id") % 10).cast("int").alias("scene_idx"),
            F.concat(F.lit("url://"), label).alias("url"), F.concat(F.lit("Title "), label).alias("title"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.when(F.col("vec_id") % 25 == 0, "prompt").otherwise("frame").alias("role"),
            F.floor(F.col("vec_id") / 3).cast("int").alias("cand_id"), (F.col("vec_id") % 3).cast("int").alias("frame"),
            F.col("label").alias("scene_idx"), "embedding",
        )

    def judgements(self) -> DataFrame:
        i = F.col("doc_id")
        return self.table("labels").select(
            i.alias("cand_id"), ((i * 17) % 101).cast("int").alias("score"), ((i * 29) % 101).cast("int").alias("tone_match"),
            ((i * 41) % 101).cast("int").alias("quality_score"), (F.col("quality") == 1).alias("accept"),
            (F.col("toxic") == 1).alias("hard_flag"),
            F.when(i % 3 == 0, "exact").when(i % 3 == 1, "close").otherwise("context").alias("match_level"),
        )
