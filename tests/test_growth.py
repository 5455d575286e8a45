"""Operators whose work must grow with the input: odd inputs, results beside plain versions, and plans without rows for pairs or pieces."""

import re
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from beatframe.functions import classify as C, lexicon as L, text as T
from beatframe.operators import quality as G, rank as K
from beatframe.plans import catalog_rank as R
from beatframe.views import Views

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


LEXICON = "ruleset string, priority int, label string, needle string"


def plain_lexicon(texts, rules):
    out = {}
    for key, text in texts:
        for ruleset, priority, label, needle in rules:
            if text is not None and needle is not None and needle in text.lower():
                out[key, ruleset] = min(out.get((key, ruleset), (priority, label)), (priority, label))
    return {k: v[1] for k, v in out.items()}


def test_lexicon_of_odd_needles(spark, monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 3)  # several groups of needles
    texts = [("a", "Über den Wolken über"), ("b", ""), ("c", None), ("d", "aaaaaaaaa"), ("d", "xyz"), ("e", "needles, needle"), ("f", "😀😀 eé")]
    rules = [
        ("r", 2, "long", "über den wolken"), ("r", 1, "tail", "ken über"), ("r", 1, "tie", "wolken"), ("r", 3, "one", "a"), ("s", 1, "six", "aaaaaa"), ("s", 1, "ten", "aaaaaaaaaa"),
        ("s", 0, "z", "xyz"), ("r", 5, "n", "needles"), ("r", 4, "m", "needlesx"), ("s", 9, "any", ""), ("t", 1, "smile", "😀 e"), ("t", 2, "none", None), ("t", 2, "case", "Über"),
    ]
    df, lexicon = spark.createDataFrame(texts, "key string, text string"), spark.createDataFrame(rules, LEXICON)
    found = L.match_lexicon(df, "key", "text", lexicon).collect()
    assert {(r.key, r.ruleset): r.label for r in found} == plain_lexicon(texts, rules) and len(found) == len({(r.key, r.ruleset) for r in found})
    assert L.match_lexicon(df, "key", "text", lexicon.limit(0)).isEmpty()


def test_lexicon_makes_no_rows_of_pieces_and_takes_linear_time(spark):
    text = "äthenwhan " * 40000 + "needle"
    rules = spark.createDataFrame([("r", 1, "found", "needle"), ("r", 2, "often", "thenwhan"), ("r", 0, "no", "needles")], LEXICON)
    out = L.match_lexicon(spark.createDataFrame([(1, text)], "key long, text string"), "key", "text", rules)
    assert "Generate" not in plan(out)
    start = time.time()
    assert [tuple(r) for r in out.collect()] == [(1, "r", "found")]
    assert time.time() - start < 20


def test_first_occurrences_of_a_long_list(spark):
    odd = [["b", "A", None, "a", "B", "", None, "ß", "SS", "É", "é", ""], [], None, [None]]
    df = spark.createDataFrame([(v,) for v in odd], "v array<string>")
    assert [r.o for r in df.select(T.ordered_distinct(F.col("v")).alias("o")).collect()] == [["b", "A", None, "", None, "ß", "SS", "É"], [], None, [None]]
    line = F.concat(F.when(F.col("id") < 0, "").otherwise("Line "), F.col("id").cast("string"))
    many = spark.range(40000).select(line.alias("v")).agg(F.sort_array(F.collect_list("v")).alias("v")).select(F.concat("v", F.transform("v", lambda x: F.upper(x))).alias("v"))
    start = time.time()
    assert many.select(T.ordered_distinct(F.col("v")) == F.slice("v", 1, 40000)).first()[0]
    assert time.time() - start < 20


def test_texts_are_lowered_once_for_all_needles(spark):
    df = spark.createDataFrame([("A Battle", 1), (None, 2), ("Student", 3)], "t string, n int")
    rules = (("one", ("battle", "war")), ("two", ("student", "exam", "a b")))
    low = F.lower("t")
    out = df.select("n", L.any_of(low, ("war", "battle", "exam")).alias("any"), L.first_hit(low, rules, "none").alias("first"), L.all_hits(low, rules).alias("all"))
    assert [tuple(r)[1:] for r in out.orderBy("n").collect()] == [(True, "one", ["one", "two"]), (None, "none", []), (False, "two", ["two"])]
    assert plan(out).lower().count("lower(t") == 3
    query = C.query_matches_intent(F.col("t"), T.strings("the battle", "student exam"))
    assert [r.x for r in df.orderBy("n").select(query.alias("x")).collect()] == [True, False, True]


def test_reranks_by_pooled_frames_make_their_pairs_once(spark):
    assert plan(entry.queries()["visual_rerank"](spark, FOLDER)).count("FlatMapCoGroupsInArrow") == 1


def test_titles_are_cut_into_words_before_they_meet_the_prompts(spark):
    assert "regexp_extract_all" not in plan(entry.queries()["blended_scores"](spark, FOLDER))
    rows = [(1, 0, 1, 0.5, None, "the old town", "the town of"), (1, 0, 2, 0.5, 0.9, "", "the"), (1, 0, 3, 0.4, None, "x", "")]
    df = spark.createDataFrame(rows, "plan_id int, scene_idx int, candidate int, primary double, specific double, title string, wanted string")
    given = df.withColumn("lexical", K.title_overlap(F.col("title"), F.col("wanted"))).drop("title", "wanted")
    at = lambda d: {r.candidate: (r.place, r.score) for r in K.blend_scores(d).collect()}
    assert at(df) == at(given) == {2: (1, 0.728), 1: (2, 0.506666667), 3: (3, 0.384)}


def test_best_of_a_group_needs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "SIDE", 3)
    vector = lambda i: None if i % 11 == 5 else [((i * 7 + k * 5) % 13 - 6) / 10 for k in range(4)]
    p = spark.createDataFrame([(i % 2, i, vector(i)) for i in range(1, 5)], "k int, prompt_id int, embedding array<double>")
    items = spark.createDataFrame([(i % 2, i, f"a{i % 5}", vector(i + 3)) for i in range(40)], "k int, item_id int, asset string, embedding array<double>")
    pairs = K.cosine_scores(p, items, ["k"]).join(items.select("item_id", "asset"), "item_id").groupBy("k", "prompt_id", "asset").agg(F.max("score").alias("score"))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(K.best_cosine(p, items, ["k"], "asset")) == rows(pairs)
    text = plan(entry.queries()["best_stickers"](spark, FOLDER))
    assert "zip_with" not in text and "aggregate(" not in text.lower().replace("aggregate [", "")


def test_candidates_of_one_query_meet_it_in_parts(spark):
    text = plan(entry.queries()["cutout_search"](spark, FOLDER))
    assert [line for line in text.splitlines() if "Join Inner" in line and "__part" in line]


def test_a_query_searches_the_library_once(spark, monkeypatch):
    """One search serves the candidates and the local files of a pool."""
    calls, search = [], K.search_library
    monkeypatch.setattr(K, "search_library", lambda queries, files, k=12: calls.append(k) or search(queries, files, k))
    entry.queries()["local_pool"](spark, FOLDER)
    assert calls == [24]


def test_search_of_odd_names(spark, monkeypatch):
    """Repeated words, parts between _ and -, other alphabets and more hits than are added up at a time, against a loop."""
    monkeypatch.setattr(K, "HITS", 2)
    names = ["the_the the-THE", None, "", "_-_ a b", "Straße_É ÉCOLE-é", "ход_хода ХОД", "x1_2y 22", "İstanbul ΣΟΦΟΣ-ΟΔΟΣ_ΟΔΟΣ", "e\u0301te the", "well-known well_known"]
    asks = [(1, "the straße é"), (2, "ход 22 2y x1"), (3, None), (4, "σοφος οδος é\u0301te e\u0301te"), (5, "well-known well known the"), (6, "-- __ _a"), (7, "i\u0307stanbul école")]
    files = spark.createDataFrame([(i, n, "the ход", "image") for i, n in enumerate(names)], "cand_id long, name string, folders string, kind string")
    got = K.search_library(spark.createDataFrame(asks, "query_id int, query string"), files, 4)
    cut = lambda c: T.tokens(F.translate(c, "_-", "  "))
    name = {r.cand_id: set(r.t) for r in files.select("cand_id", cut("name").alias("t")).collect()}
    want = []
    for r in spark.createDataFrame(asks, "query_id int, query string").select("query_id", T.tokens(F.col("query")).alias("t")).collect():
        scored = sorted((-(8.0 * len(set(r.t) & t) + 2.0 * len({"the", "ход"} & set(r.t))), i) for i, t in name.items())
        want += [(r.query_id, p, i, -s) for p, (s, i) in enumerate(scored[:4], 1)]
    assert sorted(map(tuple, got.collect())) == want
    assert K.search_library(spark.createDataFrame(asks[2:3], "query_id int, query string"), files, 2).count() == 2


def test_pools_score_a_candidate_once(spark):
    v = Views(spark, FOLDER)
    assert len(re.findall(r"max_by\(", plan(K.rank_pool(*R.rolls(v))))) == 1


def test_only_files_of_a_pool_are_guarded(spark):
    v = Views(spark, "/root/testdata/sf0.01")
    ids = lambda df: {r.cand_id for r in df.select("cand_id").distinct().collect()}
    guarded = R.guards(v)
    assert ids(guarded) == ids(R.found(v)) < ids(v.candidates())
    every = G.quality_guard(v.candidates().withColumn("duration_ms", (F.col("cand_id") % 40) * 50)).select(*guarded.columns)
    assert guarded.exceptAll(every).isEmpty() and guarded.count() == len(ids(guarded))
