"""The pipeline's stages against plain versions of what they decide."""

import corpus_pipeline
from pyspark.sql import functions as F

from beatframe.llm import jaccard, language, samples, toxicity
from beatframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "packing"]
    every = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = every
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(samples.fold_of("doc_id", 5) != 0)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = ids(docs), stage(spark, docs, SMALL)
        if name == "toxicity":
            want = ids(toxicity.score(docs, toxicity.fit(every, labels)).where("predicted = 0"))
        elif name == "language":
            want = ids(language.identify_documents(docs).where("kept"))
        elif name == "near_copies":
            want = ids(jaccard.link(docs).where("component_id = doc_id"))
        else:
            want = before
        assert ids(out) == want <= before and want
        if name != "packing":
            assert out.columns == every.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(docs)


def test_odd_rows_pass(spark):
    rows = [(1, None, "en", "s", 0, 1, "a"), (None, "the one and the other of them", None, None, None, None, None), (2, "", None, "s", 0, 2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, component_id string")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SMALL)
    assert kept.count() == 3 and corpus_pipeline.packed(spark, kept, SMALL).agg(F.sum("length")).first()[0] >= 3
    assert corpus_pipeline.without_toxic(spark, docs, SMALL).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
