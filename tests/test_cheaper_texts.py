"""Text rules that were made cheaper give what the plain patterns give, and texts are lowered and exchanged once."""

import pytest
from pyspark.sql import functions as F

from beatframe.functions import classify as C, rules as R, text as T
from beatframe.views import Views

ODD = [
    "", None, " ", "   ", "a b  c　 d", " -- Stock  Footage, b roll of x", "ſtock footage of ſtock", "STOCK FOOTAGE\tvIsual METAPHOR.", "ılluStration, İLLUSTRATION, engravıng",
    "in Qing China 1800s, 19TH-century; hıstorical settıng", "restock footage, metaphors", "a-_b -c- __d__ --- _ 'e' f.g", "ΟΔΟΣ, ΣΑΣ. İstanbul", "é" * 300 + "a" * 150, "x " * 130, "--'" * 50 + " ,,, b",
    "a🙂b " * 60, "\x1c a \x85 b \x0b", "ab  " * 99 + "c", "1850 xix", "в 1850-м, 19-й век", "19 век", "xx", "in 2024", "axx x20th", "2020 18 1750 xviii.", "Ⅻ 19ый век xxi", "x" * 100 + " " + "y" * 100, "!" * 120 + "z",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i int, t string").repartition(2)


def test_cleaners_equal_the_plain_patterns(odd):
    t = F.col("t")
    edge = r"^[ ,.;:\-]+|[ ,.;:\-]+$"
    squash = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    edges = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), edge, "")
    words = F.transform(T.split_words(T.blank(t)), lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r"(?U)[^\w\-]+", ""), "^[_-]+|[_-]+$", "")))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*T.STOPWORDS))
    bare = F.transform(T.split_words(T.blank(t)), lambda w: F.regexp_replace(w, r"(?U)[^\w-]+", ""))
    base = F.array_join(F.slice(F.filter(bare, lambda w: F.length(w) >= 4), 1, 4), " ")
    footage = edges(F.regexp_replace(T.blank(t), rf"(?iU)\b({T.STILL_BOILERPLATE})\b", " "))
    pairs = {
        "squash": (T.squash(t), squash(t)), "edges": (T.squash_edges(t), edges(t)),
        "action": (T.clean_action_query(t), F.substring(squash(F.regexp_replace(edges(T.blank(t)), rf"(?iU)\b({T.ACTION_BOILERPLATE})\b", " ")), 1, 120)),
        "overlay": (T.clean_overlay_query(t), F.substring(squash(F.regexp_replace(T.blank(t), r"[^a-zA-Z0-9 '\-]", " ")), 1, 100)),
        "footage": (T.clean_footage_subject(t), F.when(footage == "", "real human action").otherwise(footage)),
        "freed": (T.strip_constraints(t), edges(F.regexp_replace(t, rf"(?iU)\b(?:{T.PERIOD_PHRASES})\b", " "))),
        "keywords": (T.useful_keywords(t, 5), F.slice(F.array_distinct(kept), 1, 5)),
        "fallback": (T.fallback_query(t, F.lit("video")), F.concat_ws(" ", F.when(base == "", "human reaction").otherwise(base), F.lit("real footage"))),
    }
    for name, (new, plain) in pairs.items():
        for r in odd.select("i", new.alias("new"), plain.alias("plain")).collect():
            assert r.new == r.plain, (name, ODD[r.i])


def test_eras_equal_the_plain_patterns(odd):
    plain = F.coalesce(*[F.when(F.col("t").rlike("(?U)" + p), label) for label, p in R.ERA_PATTERNS], F.lit(""))
    rows = odd.filter("t is not null").select("t", C.detect_era(F.col("t")).alias("new"), plain.alias("plain")).collect()
    assert all(r.new == r.plain for r in rows) and len({r.new for r in rows}) == 5


def test_captions_are_lowered_once():
    c = F.col("caption")
    for rule in (C.infer_tone(c), C.explicit_entities(c), C.beat_role(c), C.context_parts(c), C.reaction_prompt(c, F.lit(""))):
        assert str(rule).count("lower(") == 1


def test_no_exchange_carries_words(spark):
    plan = Views(spark, "/root/testdata/sf0.001")._words()._jdf.queryExecution().sparkPlan().toString()
    joins, words = plan.index("Join"), plan.index("Generate")
    assert words < joins  # words are made above the join of texts and turns
