"""The registered queries of this folder: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from beatframe.llm import bpe, conversations, jaccard, language, licenses, maintext, merkle, packing, quality, samples, secrets, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document's ids and of what they decode to."""
    return bpe.byte_bpe(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; labels are learnt only where crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = samples.fold_of("doc_id", 3)
    model = quality.fit(docs, labels.where(fold != 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity; labels are learnt only where crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = samples.fold_of("doc_id", 5)
    lists = toxicity.fit(docs, labels.where(fold != 0))
    return toxicity.score(docs, lists, evidence=False).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document under links of Jaccard 0.75 or more between 5-word shingles."""
    return jaccard.link(table(spark, folder, "documents"))


#: Links by a join on shared shingles; every pair that shares one is compared.
ORACLE["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
f AS (SELECT doc_id, unnest(g) AS x FROM s),
m AS (SELECT x, min(doc_id) AS m FROM f GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE a.x IN (SELECT x FROM m) GROUP BY ALL),
e AS (SELECT p.u, p.v FROM p JOIN s a ON a.doc_id = p.u JOIN s b ON b.doc_id = p.v WHERE 100 * c >= 75 * (len(a.g) + len(b.g) - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
"""


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language, confidence and decision for every document (page_id null) and every page (doc_id null)."""
    docs = table(spark, folder, "documents")
    likelihoods = language.learn(docs)
    first = language.identify_documents(docs, likelihoods).withColumn("page_id", F.lit(None).cast("long"))
    second = language.identify_pages(table(spark, folder, "pages"), likelihoods).withColumn("doc_id", F.lit(None).cast("long"))
    return first.unionByName(second).select("doc_id", "page_id", "language", "confidence", "kept")


@query
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest rows found for every vector whose vec_id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"))


@query
def op8_vector_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9 or more."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every license notice in every document."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages")
    return maintext.extract(pages, maintext.fit(pages))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its possibly tampered form still leads to the root."""
    return merkle.document_manifest(table(spark, folder, "documents"))


#: crc32 of decimal texts, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length({0})), lambda i: ((ord(({0})[i // 8 + 1]) >> (i % 8)::INT) & 1)::UBIGINT)), lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295::UBIGINT)"""

_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = " || ".join(_FIELD.format(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}"))

ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_LEAF.format("text")}) AS leaf,
  CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_LEAF.format("replace(text, chr(10), '')")}) END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM d),
t(level, source, pos, m, h) AS (SELECT 0, source, pos, m, leaf FROM l
  UNION ALL SELECT level + 1, source, pos // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE m > 1 GROUP BY level, source, pos // 3, m),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM t WHERE m = 1),
u(level, pos, m, h) AS (SELECT 0, pos, m, subroot FROM s
  UNION ALL SELECT level + 1, pos // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE m > 1 GROUP BY level, pos // 3, m),
step AS (
  SELECT l.doc_id, l.source, l.pos, 0 AS tree, t.level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.level)::BIGINT) AS a, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.level)::BIGINT) AS b
  FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.pos // 3 = l.pos // (3 ** (t.level + 1))::BIGINT AND t.m > 1 GROUP BY ALL
  UNION ALL SELECT l.doc_id, l.source, l.pos, 1, u.level, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // (3 ** u.level)::BIGINT), string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // (3 ** u.level)::BIGINT)
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.pos // 3 = s.pos // (3 ** (u.level + 1))::BIGINT AND u.m > 1 GROUP BY ALL),
p AS (SELECT source, pos, sha256(string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY tree, level)) AS proof_sha256, list(struct_pack(a := coalesce(a, ''), b := coalesce(b, '')) ORDER BY tree, level) AS steps FROM step GROUP BY ALL),
f(source, pos, k, h) AS (SELECT source, pos, 0, coalesce(tampered, leaf) FROM l
  UNION ALL SELECT f.source, f.pos, k + 1, sha256(p.steps[k + 1].a || h || p.steps[k + 1].b) FROM f JOIN p ON p.source IS NOT DISTINCT FROM f.source AND p.pos = f.pos WHERE k < len(p.steps))
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM u WHERE m = 1) r LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.pos = l.pos AND f.k = coalesce(len(p.steps), 0)
"""


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage."""
    return conversations.repair(table(spark, folder, "conversations"))


def _option(cost: str, letter: str, text: str, of: str) -> str:
    return f"struct_pack(c := {cost} + {of}.c, a := '{letter}' || {of}.a, t := {text} || {of}.t)"


def _repair_sql() -> str:
    """Costs from the last row back, four states at a time (1 nothing yet, 2 system, 3 user, 4 assistant), each with its ASCII-least audit and its text."""
    forced, name = {1: 3, 2: 3, 3: 4, 4: 3}, {3: "user", 4: "assistant"}
    none = "struct_pack(c := 1000000000, a := '', t := '')"
    own, full = [], []
    for s, to in forced.items():
        kept = " ".join(f"WHEN k = '{k}' AND NOT gone THEN {_option('cut_off', 'K', 'chr(10) || role || chr(58) || text', f'V[{t}]')}" for (f, k), t in {(1, "s"): 2, (1, "u"): 3, (2, "u"): 3, (4, "u"): 3, (3, "a"): 4}.items() if f == s)
        rerole = f"CASE WHEN gone THEN {none} ELSE {_option('2 + cut_off', 'R', f'chr(10) || $${name[to]}:$$ || text', f'V[{to}]')} END"
        own.append(f"list_min([{_option('3', 'D', repr(''), f'V[{s}]')}, CASE {kept} ELSE {none} END, {rerole}])")
        one, two = f"chr(10) || '{name[to]}:'", f"chr(10) || '{name[to]}:' || chr(10) || '{name[forced[to]]}:'"
        full.append(f"list_min([W[{s}], {_option('2', 'I', one, f'W[{to}]')}, {_option('4', 'II', two, f'W[{forced[to]}]')}])")
    end = "[struct_pack(c := 0, a := '', t := ''), struct_pack(c := 4, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:'), struct_pack(c := 2, a := 'I', t := chr(10) || 'assistant:'), struct_pack(c := 0, a := '', t := '')]"
    code = CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {code} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, {space}) AS bare, left(role, 1) AS k FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(k) OVER (PARTITION BY conv_id ORDER BY i) || k AS pair FROM r),
g AS (SELECT conv_id, i, n, role, text, k, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cut_off FROM f),
v(conv_id, i, V) AS (SELECT conv_id, n + 1, {end} FROM g WHERE i = 1
  UNION ALL SELECT conv_id, i, [{", ".join(full)}] FROM (SELECT g.conv_id, g.i, [{", ".join(own)}] AS W FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(V[1].c, 0)::BIGINT AS cost, coalesce(V[1].a, '') AS audit, sha256(coalesce(substr(V[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1
"""


ORACLE["op13_conversation_repair"] = _repair_sql()


@query
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of the fixed patterns and strings that look random, in every document."""
    docs = table(spark, folder, "documents")
    return secrets.report(secrets.scan(docs, secrets.fit(secrets.labelled(docs))))
