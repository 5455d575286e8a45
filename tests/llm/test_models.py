"""Classifiers, language, licenses and main text: held-out accuracy, exact searches, cases by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from beatframe.llm import language, licenses, maintext, quality, queries, samples, toxicity

SMALL = "/root/testdata/sf0.01"


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select(label, "score", "predicted").collect()
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    return np.mean([r[0] == r.predicted for r in rows]), rows


def test_quality_on_held_out_labels(spark):
    out = queries.op9_quality(spark, SMALL)
    share, rows = accuracy(out, spark.read.parquet(f"{SMALL}/labels.parquet"), "quality")
    assert share >= 0.95 and out.count() == 1000
    assert out.where("held_out <> (pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1)").count() == 0


def test_toxicity_on_held_out_labels(spark):
    out = queries.op10_toxicity(spark, SMALL)
    share, rows = accuracy(out, spark.read.parquet(f"{SMALL}/labels.parquet"), "toxic")
    assert share >= 0.95 and out.count() == 1000
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in clean]) <= 0.02


@pytest.fixture
def odd_docs(spark):
    rows = [(1, "good words here", "x"), (2, None, "x"), (3, "", "x"), (None, "bad words", "x"), (1, "good words here", "y"), (4, "w " * 200_000, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_with_odd_rows(spark, odd_docs, kind):
    label = "quality" if kind is quality else "toxic"
    none = spark.createDataFrame([(1, None), (None, 1)], f"doc_id long, {label} int")
    model = kind.fit(odd_docs, none)
    assert {r.score for r in kind.score(odd_docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0)], f"doc_id long, {label} int")
    assert kind.score(odd_docs, kind.fit(odd_docs, one)).count() == 6
    assert kind.score(odd_docs.limit(0), model).count() == 0


def test_dual_descent_separates_and_meets_the_bound():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.uint32) for _ in range(200)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    values = [np.ones(len(r)) for r in rows]
    w, b = quality.descend(rows, values, y, np.full(200, 10.0), passes=300)
    margins = np.array([w[r].sum() + b for r in rows])
    assert (np.sign(margins) == y).all()
    # the gap between primal and dual objective closes
    primal = 0.5 * (w @ w + b * b) + 10.0 * np.maximum(0, 1 - y * margins).sum()
    better = min(0.5 * ((w * s) @ (w * s) + (b * s) ** 2) + 10.0 * np.maximum(0, 1 - y * margins * s).sum() for s in (0.9, 0.95, 1.05, 1.1))
    assert primal <= 1.01 * better


def test_block_max_search_is_exact():
    rng = random.Random(5)
    words = np.sort(np.array([rng.getrandbits(63) for _ in range(60)], np.uint64))
    idf = np.array([rng.uniform(1, 6) for _ in range(60)])
    bare = toxicity.build(words, idf, np.zeros(0, np.int64), np.zeros(0), [])
    vector = lambda: bare.vector(*np.unique(np.array(rng.choices(words.tolist(), k=rng.randint(1, 9)), np.uint64), return_counts=True))
    rows = [vector() for _ in range(700)] + [(np.zeros(0, np.int64), np.zeros(0))] * 3
    lists = toxicity.build(words, idf, np.arange(703), np.array([rng.randint(0, 1) for _ in range(703)], float), rows)
    full = np.zeros((703, 60))
    for i, (at, w) in enumerate(rows):
        full[i, at] = w
    for _ in range(60):
        at, w = vector()
        query = np.zeros(60)
        query[at] = w
        cosines = full @ query
        want = [i for i in np.lexsort((np.arange(703), -cosines.round(12))) if cosines[i] > 0][:25]
        found, got = lists.nearest(at, w)
        assert np.allclose(got, cosines[want]) and len(found) == len(want)


def test_sample_takes_bounded_classes(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = samples.sample(docs, labels, "doc_id", "text", "toxic", 7).collect()
    assert {y: len({r.doc_id for r in rows if r.y == y}) for y in (0, 1)} == {0: 7, 1: 7} and all(r.doc_id % 2 == r.y for r in rows)
    assert samples.class_counts(labels, "doc_id", "toxic") == {0: 20, 1: 20}


def test_language_of_documents_and_pages(spark):
    out = queries.op4_language_id(spark, SMALL)
    docs = out.join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert docs.count() == 1000 and docs.where("language = lang and kept").count() >= 990
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", language.declared_of(F.col("html")).alias("lang"))
    assert out.join(pages, "page_id").where("language = lang").count() >= 245


def test_language_evidence(spark):
    english, german = "the cat and the dog went to the house of the king ", "der hund und die katze gingen in das haus des königs "
    docs = spark.createDataFrame([(i, english * 3, "en", "a.com") for i in range(30)] + [(100 + i, german * 3, "de", "b.de") for i in range(30)], "doc_id long, text string, lang string, source string")
    model = language.learn(docs)
    asked = spark.createDataFrame([(1, english, None, None), (2, german, "en", "a.com"), (3, "12 34", None, "b.de"), (4, None, "de", None), (5, "", None, None), (None, english, "en", "zz"), (6, "!!", None, "unseen")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify_documents(docs.union(asked), model).where("doc_id < 10 or doc_id is null").collect() if r.doc_id is None or r.doc_id < 30}
    assert got[None].language == "en"
    rows = language.identify_documents(docs.select(F.col("doc_id") + 1000, "text", "lang", "source").toDF("doc_id", "text", "lang", "source").union(asked), model).where("doc_id < 1000 or doc_id is null").collect()
    told = {r.doc_id: (r.language, r.kept) for r in rows}
    assert told[1] == ("en", True) and told[2] == ("de", True)  # a long text outweighs what it declares
    assert told[3] == ("de", True) and told[4] == ("de", True)  # without letters the other evidence decides
    assert told[5] == ("und", False) and told[6] == ("und", False)
    assert language.identify_documents(asked.limit(0), model).count() == 0
    nothing = language.learn(asked.limit(0))
    assert [r.language for r in language.identify_documents(asked, nothing).collect()] == ["und"] * 7


def test_unknown_language_and_junk_are_rejected(spark):
    rng = random.Random(4)
    pools = {"en": "the cat and dog went to house of king with many other small friends from town before it was dark".split(), "de": "der hund und die katze gingen in das haus des königs mit vielen anderen kleinen freunden aus stadt bevor es dunkel wurde".split()}
    say = lambda words, n=40: " ".join(rng.choices(words, k=n))
    known = [(i, say(pools[lang]), lang, "s") for i, lang in enumerate(["en", "de"] * 150)]
    other = "kissa ja koira menivät kuninkaan taloon ystävien kanssa ennen pimeää yksi päivä myöhemmin".split()
    junk = ["".join(rng.choices("0123456789abcdef", k=400)), "".join(rng.choices("qxzjkvwpbg", k=300)), "x## %% q$$ z@@ k!! " * 20, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(30))]
    bad = [(None if i % 2 else 1000 + i, x, None, "s") for i, x in enumerate([say(other) for _ in range(6)] + junk)]
    rare = [(2000 + i, say([w + "zsz" for w in pools["en"]]), f"x{i}", "s") for i in range(70)]
    docs = spark.createDataFrame(known + bad, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.of_known_language(spark, docs, SMALL)
    assert {r.text for r in kept.collect()} == {r[1] for r in known} and kept.columns == docs.columns
    told = language.identify_documents(docs).where("doc_id is null or doc_id >= 1000").collect()
    assert len(told) == len(bad) and {(r.language, r.kept) for r in told} == {("und", False)}
    model = language.learn(docs.union(spark.createDataFrame(rare, docs.schema)))
    assert set(model.languages) == {"en", "de", "und"} | {f"x{i}" for i in range(70)}
    assert np.allclose(np.exp(model.log_p.astype(float)).sum(axis=0), 1, atol=1e-3)


def test_a_language_of_copies_is_learnt(spark):
    rows = [(i, "one and the same text that was copied", "aa") for i in range(5000)] + [(9000 + i, f"ein anderer text nummer {i}", "bb") for i in range(50)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limit=10)
    own = model.score(b"one and the same text that was copied")
    assert model.languages[int(own.argmax())] == "aa"


def test_address_parts(spark):
    urls = ["https://m.site.example.de/en/12?x=1", "http://host.fr", "ftp://a.b/c", None, "no address", "https://x.org/enable/1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select(language.suffix_of(F.col("url")).alias("s"), language.host_of(F.col("url")).alias("h"), language.domain_of(language.host_of(F.col("url"))).alias("d")).collect()
    assert [r.s for r in rows] == ["/en", ".fr", ".b", None, None, ".org"]
    assert [r.h for r in rows] == ["m.site.example.de", "host.fr", "a.b", None, None, "x.org"] and rows[0].d == "example.de"


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    changed = mit.replace("free of charge", "free of all charge").replace("\"Software\"", "'Software'")
    cases = {
        1: ("Intro.\nReleased under the MIT License.\nMore.", [("MIT", True)]), 2: ("This work is licensed under the GNU General Public License, version 2.", [("GPL-2.0", True)]),
        3: ("Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0.", [("CC-BY-NC-4.0", True), ("CC-BY-4.0", True)]), 4: ("x " * 3000 + "\n" + changed, [("MIT", False)]),
        5: ("She has a driving license and a copyright lawyer.", []), 6: (None, []), 7: ("", []), 8: ("All rights reserved.\nLicensed under the Apache License, Version 2.0.", [("Proprietary", True), ("Apache-2.0", True)]),
    }
    docs = spark.createDataFrame([(k, v[0], 0) for k, v in cases.items()] + [(None, "All rights reserved.", 1), (1, cases[1][0], 2)], "doc_id long, text string, license int")
    rows = licenses.scan(docs).collect()
    for k, (text, want) in cases.items():
        found = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [(r.license, r.exact) for r in found][: len(want)] == want and len(found) == len(want) * (2 if k == 1 else 1)
        assert all(0 <= r.start < r.end <= len(text) and r.reduction > 0 for r in found)
    assert sum(r.doc_id is None for r in rows) == 1 and licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lines", [
    [("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Proprietary", "All rights reserved.")],
    [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("Proprietary", "All rights reserved.")],
    [("MIT", "Released under the MIT License."), ("Proprietary", "All rights reserved."), ("MIT", "Released under the MIT License."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("MIT", "Licensed under the MIT License.")],
    [("BSD-2-Clause", licenses.TEMPLATES["BSD-2-Clause"][0]), ("BSD-3-Clause", licenses.TEMPLATES["BSD-3-Clause"][0]), ("Proprietary", "All rights reserved."), ("BSD-2-Clause", licenses.TEMPLATES["BSD-2-Clause"][0])],
])
def test_stacked_licenses(lines):
    text = "\n".join(line for _, line in lines)
    found = list(licenses.Scanner(licenses.TEMPLATES).scan(text))
    assert [(f.license, f.exact) for f in found] == [(name, True) for name, _ in lines]
    assert [f.start for f in found] == [sum(len(x) + 1 for _, x in lines[:i]) for i in range(len(lines))]


def test_licenses_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    want = {(r.doc_id, name) for r in docs.collect() for line, name in lines.items() if line in r.text}
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert want and got == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="ad">Buy this.</div><article><h1>A  headline</h1><p>First &amp; second,\n with <b>bold</b> words. More of them follow here, as in any story.<p>Unclosed <i>one. It goes on, and on, and it ends.<br><ul><li>Point &lt;1&gt;, with some words.</li></ul></article><footer>&copy; Someone</footer>"""


def test_pages_of_all_kinds(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    trees = maintext.fit(pages)
    out = {r.page_id: r for r in maintext.extract(pages, trees).collect()}
    off = 0
    for r in pages.collect():
        page = maintext.Page(r.html)
        off += out[r.page_id].text != page.text(maintext.truth(page))
        assert out[r.page_id].n_chars == len(out[r.page_id].text)
    assert off <= 2
    odd = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (None, None, PAGE, 1), (3, "u", "<p>" * 3000 + "deep", 1), (3, "u", "<<a <b>> & &bogus; </x>", 1)], "page_id long, url string, html string, text int")
    rows = maintext.extract(odd, trees).collect()
    assert len(rows) == 5 and [r.text for r in rows if r.page_id in (1, 2)] == ["", ""]
    assert next(r.text for r in rows if r.page_id is None) == "A headline\nFirst & second, with bold words. More of them follow here, as in any story.\nUnclosed one. It goes on, and on, and it ends.\nPoint <1>, with some words."
    assert maintext.extract(odd.limit(0), None).count() == 0 and maintext.fit(odd.limit(0)) is None


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(2)
    page = maintext.Page("<div>aa<div>b<p>ccc</p><p>dd</p></div><section>e<div>ffff</div></section></div>")
    n = len(page.tag)
    own = np.zeros(n)
    for node, text in page.pieces:
        own[node] += len(text.strip())
    allowed = {0: (0, 1), 1: (1, 2), 2: (2,)}
    for _ in range(40):
        odds = rng.normal(0, 4, n)
        gain = odds * (0.2 + np.log1p(own))
        best, top = None, -np.inf
        for states in itertools.product((0, 1, 2), repeat=n):
            if states[0] == 2 or any(states[i] not in allowed[states[page.parent[i]]] for i in range(1, n)):
                continue
            value = sum(gain[i] for i in range(n) if states[i] == 1) - maintext._BEGIN * sum(states[i] == 1 and (i == 0 or states[page.parent[i]] == 0) for i in range(n)) - maintext._LEAVE * sum(i > 0 and states[i] == 2 and states[page.parent[i]] == 1 for i in range(n))
            if value > top:
                best, top = states, value
        if 1 in best:
            assert (page.decode(odds) == (np.array(best) == 1)).all()
