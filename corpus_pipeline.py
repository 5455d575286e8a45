"""The corpus pipeline: documents without toxic, unidentified and nearly repeated ones, packed into token sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatframe.llm import jaccard, language, packing, samples, toxicity
from beatframe.llm.common import checkpoint_dir, cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


BATCH = 500  # rows that a Python worker gets at once; whole documents in larger batches make workers and executors large


WORDS = 1 << 18  # words whose ids a worker keeps while it packs: workers also hold what earlier stages left


FLUSH = 400_000  # signatures that a task of near_copies holds: sorting them takes several times their size


def _small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH rows from now on, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic; rows of a null doc_id are judged by their text like others,
    and other columns of any name are carried along."""
    _small_batches(spark)
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(samples.fold_of("doc_id", 5) != 0)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = toxicity.score(plain, toxicity.fit(every, labels), keep=plain.columns, evidence=False, text=f"c{names.index('text')}")
    return scored.where("predicted = 0").select(*plain.columns).toDF(*names)


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: text, declared language and source together leave one with a posterior of 0.5 or more.

    Each row goes or stays by its own decision, whatever its doc_id. The decision follows from text, language and source alone, so only
    128-bit hashes of these are joined with the texts."""
    _small_batches(spark)
    parts = [F.xxhash64(F.lit(i), *[x for c in ("text", "lang", "source") for x in (docs[c].isNull(), docs[c])]) for i in (1, 2)]
    rows = docs.select(*docs.columns, parts[0].alias("__row_1"), parts[1].alias("__row_2"))
    decided = language.identify_documents(rows, language.learn(docs), keep=("__row_1", "__row_2"))
    rejected = cut(decided.where("not kept").select("__row_1", "__row_2").distinct())
    return rows.join(rejected, ["__row_1", "__row_2"], "left_anti").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies; rows that repeat its doc_id and those without one stay."""
    _small_batches(spark)
    linked = jaccard.link(docs.where("doc_id is not null"), flush=FLUSH).groupBy("doc_id").agg(F.min("component_id").alias("component"))
    return docs.join(cut(linked.where("component < doc_id").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 4096 tokens."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cached=WORDS, kept=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("language", of_known_language),
    ("near_copies", one_of_near_copies),
    ("packing", packed),
]

#: Scores of learnt models and first-fit packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
