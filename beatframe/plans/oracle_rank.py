"""SQL counterparts: search, ranking, assignment, duplicates, cues, rewrites, reports."""

from __future__ import annotations

from ..functions import recipes as P, rules as R, text as T
from ..operators import rank as CUT
from . import catalog as Q
from .oracle import ORACLE, CANDIDATES, CAPTIONS, CHUNKS, DEFAULT_ROLES, JUDGE, PLANTED, RANGES, SCENES, SHOTS, WORDS, context, entities, every, first, has, join, lit, role_case, sql, tone_case, toks
from .oracle_text import QTY, alt, guard, ordered, squash

# --- search ---------------------------------------------------------------------

SEARCH = CANDIDATES + f""",
qs AS (SELECT CAST(item_id AS INT) AS query_id, text AS query, {toks('text')} AS qt FROM benchmark),
lib AS (SELECT *, CASE WHEN kind = 'video' THEN 2.5::DOUBLE ELSE 0.0 END AS base, {toks("translate(description, '_-', '  ')")} AS nt, {toks("lang || ' ' || provider")} AS ft FROM candidates),
hits AS (SELECT query_id, query, cand_id, 8.0::DOUBLE * len(list_intersect(qt, nt)) + 2.0 * len(list_intersect(qt, ft)) + base AS score FROM qs, lib),
top24 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS INT) AS place FROM hits QUALIFY place <= 24)"""
sql("token_search_topk", SEARCH, "SELECT query_id, place, cand_id, score FROM top24 WHERE place <= 12")

FOUND = SEARCH + """,
found AS (SELECT CAST(query_id AS BIGINT) AS plan_id, CAST(cand_id % 3 AS INT) AS query_idx, query, place AS pos, c.* FROM top24 JOIN candidates c USING (cand_id)),
asking AS (SELECT CAST(query_id AS BIGINT) AS plan_id, CASE WHEN query_id % 2 = 0 THEN 'video' ELSE 'image' END AS vm, ['stock_video', 'generic_image', 'auto', 'historical_archive'][query_id % 4 + 1] AS sm, query_id % 7 = 3 AS lk, query AS q, qt FROM qs)"""


def score(wish: str) -> str:
    w = toks(wish)
    return (
        f"len(list_intersect({w}, {toks('title')})) * 7.0::DOUBLE + len(list_intersect({w}, {toks('description')})) * 2.5::DOUBLE + CASE WHEN width >= 1200 OR height >= 1200 THEN 2.5 WHEN width >= 800 OR height >= 800 THEN 1.0 ELSE 0 END"
        " + CASE WHEN width::DOUBLE / height BETWEEN 0.45 AND 0.8 THEN 3.5 WHEN width::DOUBLE / height <= 1.1 THEN 1.5 ELSE 0 END + CASE WHEN license <> '' THEN 0.5 ELSE 0 END"
    )


MODE = "CASE WHEN vm = 'video' THEN CASE WHEN kind = 'video' THEN 18.0 ELSE -5.0 END ELSE CASE WHEN kind = 'image' THEN 4.0 ELSE -1.0 END END"
SOURCE = "CASE sm WHEN 'historical_archive' THEN CASE provider WHEN 'commons' THEN 30.0 WHEN 'openverse' THEN 16.0 ELSE -100.0 END WHEN 'stock_video' THEN CASE WHEN kind = 'video' THEN 22.0 ELSE 2.0 END WHEN 'generic_image' THEN CASE WHEN kind = 'image' THEN 8.0 ELSE -10.0 END ELSE 0.0 END"
HAY = "lower(title || ' ' || description)"
LOCK = f"CASE WHEN lk THEN CASE WHEN contains({HAY}, 'the') THEN 14.0 ELSE -8.0 END + CASE WHEN contains({HAY}, 'ing') AND contains({HAY}, 'that') THEN 14.0 ELSE -8.0 END + CASE WHEN contains({HAY}, 'schen') THEN 5.0 ELSE 0 END ELSE 0 END"
USED = "NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = cand_id)"


def ranked(name: str, used: bool) -> str:
    return f"""
{name}_a AS (SELECT f.*, a.vm, a.sm, a.lk, round(CAST({score("f.query || ' the and that'")} + {MODE} + {SOURCE} + {LOCK} - query_idx * 0.28::DOUBLE AS DOUBLE), 9) AS score FROM found f JOIN asking a USING (plan_id)
  WHERE {USED if used else 'true'} AND CASE WHEN lk OR sm = 'historical_archive' THEN kind = 'image' WHEN sm = 'generic_image' THEN kind = 'image' ELSE true END),
{name}_b AS (SELECT *, bool_or(vm = 'video' AND sm = 'stock_video' AND kind = 'video') OVER (PARTITION BY plan_id) AS only_stock FROM {name}_a),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, query_idx, pos) AS INT) AS place FROM {name}_b WHERE NOT only_stock OR kind = 'video')"""


def recovered(name: str, used: bool) -> str:
    return f"""
{name}_a AS (SELECT f.*, a.vm, a.lk, round(CAST({score("f.query || ' ' || a.q")} + {MODE} AS DOUBLE), 9) AS score FROM found f JOIN asking a USING (plan_id) WHERE {USED if used else 'true'} AND (vm = 'video' OR kind = 'image')),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, query_idx, pos) AS INT) AS place FROM {name}_a)"""


sql("lexical_rank_topk", FOUND + "," + ranked("pool", True), "SELECT plan_id, place, cand_id, round(score, 4) AS score FROM pool")
sql("recovery_rank", FOUND + "," + recovered("pool", True), "SELECT plan_id, place, cand_id, round(score, 4) AS score FROM pool")

ASKING_MEMES = """,
asked AS (SELECT plan_id, CASE WHEN plan_id % 3 = 0 THEN 'meme' ELSE vm END AS vm, CASE WHEN plan_id % 6 = 0 THEN 'meme_library' ELSE sm END AS sm, lk, q, qt FROM asking)"""
POOL_MEMES = ranked("pool", False).replace("JOIN asking a", "JOIN asked a").replace(MODE, f"CASE WHEN vm = 'meme' THEN -10.0 ELSE {MODE} END").replace(SOURCE, f"CASE WHEN sm = 'meme_library' THEN -100.0 ELSE {SOURCE} END")
sql("local_pool", FOUND + ASKING_MEMES + "," + POOL_MEMES + """,
loc AS (SELECT t.query_id AS plan_id, t.cand_id, 30.0::DOUBLE + t.score + CASE WHEN t.query_id % 9 = 0 AND t.cand_id = t.query_id THEN 100 ELSE 0 END AS score, CASE WHEN t.query_id % 9 = 0 AND t.cand_id = t.query_id THEN 0 ELSE place END AS pos
  FROM top24 t JOIN asked a ON a.plan_id = t.query_id WHERE place <= 20 AND NOT lk AND (vm = 'meme' OR sm = 'meme_library')),
every AS (SELECT plan_id, 'local_meme' AS source, cand_id, score, -1 AS q, pos FROM loc
  UNION ALL SELECT plan_id, provider, cand_id, score, query_idx, pos FROM pool WHERE lk OR sm <> 'meme_library')""", """SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, q, pos) AS INT) AS place, source, cand_id, round(score, 4) AS score FROM every""")

sql("provider_union", CANDIDATES, """, t AS (SELECT d.lang, md5(d.text) AS download_url, provider AS source, kind, doc_id AS pos, CASE provider WHEN 'commons' THEN 0 WHEN 'openverse' THEN 1 WHEN 'pexels' THEN 2 ELSE 3 END AS r FROM documents d JOIN candidates c ON c.cand_id = d.doc_id)
SELECT lang, download_url, source, pos FROM t WHERE lang <> 'fr' OR kind <> 'video' QUALIFY row_number() OVER (PARTITION BY lang, download_url ORDER BY r, pos) = 1""")
sql("round_robin_pool", "", """WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY rn, f) AS INT) AS place, source, doc_id FROM r WHERE rn <= 8 QUALIFY place <= 24""")


def stock_round(n: int, before: list[str]) -> str:
    gone = " AND ".join(f"(plan_id, url) NOT IN (SELECT (plan_id, url) FROM s{b})" for b in before) or "true"
    return f"""o{n} AS (SELECT *, row_number() OVER (PARTITION BY plan_id, source ORDER BY pos) AS rn, min(pos) OVER (PARTITION BY plan_id, source) AS f FROM i WHERE q = {n} AND {gone}),
s{n} AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY rn, f) AS turn FROM o{n} WHERE rn <= 6 QUALIFY turn <= 6)"""


sql("stock_pool", "", f"""WITH e AS (SELECT user_id AS plan_id, event_id % 4 AS q, event_type AS source, 'u' || (CAST(floor(value * 10) AS BIGINT) % 97) AS url, event_id AS pos FROM events),
i AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY plan_id, q, url ORDER BY pos) = 1), {stock_round(0, [])}, {stock_round(1, ['0'])}, {stock_round(2, ['0', '1'])},
u AS (SELECT plan_id, q, source, pos, turn FROM s0 UNION ALL SELECT plan_id, q, source, pos, turn FROM s1 UNION ALL SELECT plan_id, q, source, pos, turn FROM s2)
SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY q, turn) AS INT) AS place, CAST(q AS INT) AS query_idx, source, pos FROM u QUALIFY place <= 18""")

# --- vectors ----------------------------------------------------------------------

SIMILAR = """
sims AS (SELECT p.label AS scene_idx, p.vec_id AS prompt_id, f.vec_id AS item_id, CAST(floor(f.vec_id / 3) AS INT) AS cand_id, round(list_dot_product(p.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS score
  FROM embeddings p JOIN embeddings f ON f.label = p.label AND p.vec_id % 25 = 0 AND f.vec_id % 25 <> 0),
pooled AS (SELECT scene_idx, prompt_id, cand_id, max(score) * 0.72::DOUBLE + avg(score) * 0.28::DOUBLE AS visual FROM sims GROUP BY 1, 2, 3)"""
sql("clip_cosine_topk", SIMILAR, "SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, item_id) AS INT) AS place, item_id, score FROM sims QUALIFY place <= 6")
sql("frame_pool", SIMILAR, "SELECT scene_idx, prompt_id, cand_id, round(visual, 9) AS visual FROM pooled")
sql("blended_scores", CANDIDATES + "," + SIMILAR, f""", b AS (SELECT prompt_id, p.cand_id, round(visual, 9) AS pr, CASE WHEN p.cand_id % 3 = 0 THEN round(visual * 0.5::DOUBLE + 0.1::DOUBLE, 9) END AS sp, {toks(lit('the of and that que la der'))} AS w, {toks('title')} AS t FROM pooled p JOIN candidates c ON c.cand_id = p.cand_id),
s AS (SELECT *, round(coalesce(sp, pr) * 0.62::DOUBLE + pr * 0.34::DOUBLE + len(list_intersect(w, t)) / len(w)::DOUBLE * 0.04::DOUBLE, 9) AS s FROM b)
SELECT prompt_id AS plan_id, cand_id AS candidate, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, cand_id DESC) AS INT) AS place, round(s, 6) AS score FROM s""")
sql("visual_rerank", SIMILAR, """, p AS (SELECT prompt_id AS plan_id, scene_idx, cand_id, round(visual, 9) AS v, cand_id % 2 = 0 AS vid, ((cand_id * 7) % 50)::DOUBLE AS sc FROM pooled),
n AS (SELECT *, row_number() OVER (PARTITION BY plan_id, vid ORDER BY cand_id) AS n FROM p)
SELECT plan_id, scene_idx, cand_id, CASE WHEN vid THEN 'video' ELSE 'image' END AS kind, round(CASE WHEN vid THEN CASE WHEN cand_id % 5 <> 0 THEN sc * 0.20::DOUBLE + v * 100.0::DOUBLE ELSE least(sc, -100) END WHEN n <= 6 THEN sc + v * 28.0::DOUBLE ELSE sc END, 9) AS score FROM n""")

RANKS = SIMILAR + """,
pr AS (SELECT label AS plan_id, vec_id AS prompt_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS s FROM embeddings WHERE vec_id % 25 = 0),
ranks AS (SELECT pr.plan_id, CAST(s AS INT) AS scene_idx, cand_id, round(visual, 9) AS score, CAST(row_number() OVER (PARTITION BY pr.plan_id, s ORDER BY round(visual, 9) DESC, cand_id) AS INT) AS place FROM pooled p JOIN pr ON pr.prompt_id = p.prompt_id QUALIFY place <= 9),
opts AS (SELECT plan_id, scene_idx, list({'c': cand_id, 'p': place, 's': score} ORDER BY place) AS o FROM ranks GROUP BY 1, 2),
greedy AS (SELECT plan_id, scene_idx, o[1] AS pick, [o[1].c] AS used FROM opts WHERE scene_idx = 0
  UNION ALL SELECT o.plan_id, o.scene_idx, list_filter(o.o, lambda x: NOT list_contains(g.used, x.c))[1], CASE WHEN list_filter(o.o, lambda x: NOT list_contains(g.used, x.c))[1] IS NULL THEN g.used ELSE list_append(g.used, list_filter(o.o, lambda x: NOT list_contains(g.used, x.c))[1].c) END
  FROM greedy g JOIN opts o ON o.plan_id = g.plan_id AND o.scene_idx = g.scene_idx + 1)"""
sql("unique_assignment", RANKS, "SELECT plan_id, scene_idx, pick.c AS cand_id, pick.p AS place, CAST(floor(least(greatest((pick.s + 0.10) * 190.0, 0), 100)) AS INT) AS fit FROM greedy WHERE pick IS NOT NULL")
sql("refined_assignment", RANKS, """, w AS (SELECT plan_id, scene_idx, cand_id AS want FROM ranks WHERE place = 2 AND (cand_id * 13) % 100 >= 35),
st AS (SELECT plan_id, list({'s': scene_idx, 'c': pick.c}) AS held FROM greedy WHERE pick IS NOT NULL GROUP BY 1), mx AS (SELECT plan_id, max(scene_idx) AS top FROM opts GROUP BY 1),
f AS (SELECT plan_id, -1 AS at, held, [NULL]::INT[] AS won FROM st
  UNION ALL SELECT f.plan_id, f.at + 1, CASE WHEN w.want IS NULL OR len(list_filter(held, lambda x: x.c = w.want AND x.s <> f.at + 1)) > 0 THEN held ELSE list_append(list_filter(held, lambda x: x.s <> f.at + 1), {'s': f.at + 1, 'c': w.want}) END,
    CASE WHEN w.want IS NULL OR len(list_filter(held, lambda x: x.c = w.want AND x.s <> f.at + 1)) > 0 THEN won ELSE list_append(won, f.at + 1) END
  FROM f JOIN mx USING (plan_id) LEFT JOIN w ON w.plan_id = f.plan_id AND w.scene_idx = f.at + 1 WHERE f.at < top),
l AS (SELECT f.plan_id, unnest(held) AS h, won FROM f JOIN mx ON mx.plan_id = f.plan_id AND f.at = mx.top)
SELECT plan_id, CAST(h.s AS INT) AS scene_idx, 'v' || h.c AS url, coalesce(list_contains(won, h.s), false) AS refined FROM l""")
sql("judge_batches", RANKS, "SELECT plan_id, scene_idx, cand_id, CAST(scene_idx // 4 AS INT) AS batch FROM ranks WHERE place <= 3")

# --- selection ----------------------------------------------------------------------

GUARDS = """
m AS (SELECT cand_id, kind, lower(title || ' ' || description) AS hay, width, height, (cand_id % 40) * 50 AS duration_ms, false AS flat, size FROM candidates), """ + guard("m") + """,
gd AS (SELECT cand_id, CASE WHEN kind = 'image' AND size < 512 THEN 0 ELSE guard_score END AS gs, NOT (kind = 'image' AND size < 512) AND list_contains(issues, 'too_short') AS severe FROM guards)"""
REPLIES = JUDGE + """,
gated AS (SELECT cand_id, tone_match AS tm, quality_score AS qu, hard_flag, CASE WHEN score < flo THEN least(score, cap) ELSE score END AS sc, accept AS own, match_level FROM (SELECT *, CASE match_level WHEN 'exact' THEN 45 WHEN 'close' THEN 34 ELSE 25 END AS flo, CASE match_level WHEN 'exact' THEN 29 WHEN 'close' THEN 23 ELSE 19 END AS cap FROM judgements)),
rep AS (SELECT *, CASE match_level WHEN 'exact' THEN own AND sc >= 48 AND tm >= 42 AND qu >= 42 WHEN 'close' THEN sc >= 40 AND tm >= 35 AND qu >= 40 ELSE sc >= 32 AND tm >= 30 AND qu >= 38 END AS acc FROM gated)"""


def selected(pool: str, name: str, checks: int) -> str:
    conflict = "CASE WHEN lk THEN CASE WHEN len(e1) > 0 AND len(e2) > 0 AND NOT list_has_any(e1, e2) THEN 'wrong event/war in candidate metadata' WHEN len(c1) > 0 AND len(c2) > 0 AND NOT list_has_any(c1, c2) THEN 'wrong country in candidate metadata' WHEN n1 <> n2 THEN 'wrong century in candidate metadata' END END"
    from .oracle import era_case

    return f"""
{name}_j AS (SELECT p.*, a.q, g.gs, g.severe, {every('lower(a.q)', R.EVENT_NAMES)} AS e1, {every(HAY, R.EVENT_NAMES)} AS e2, {every('lower(a.q)', R.COUNTRY_NAMES)} AS c1, {every(HAY, R.COUNTRY_NAMES)} AS c2,
  {era_case('lower(a.q)', R.CENTURY_PATTERNS, 'NULL', False)} AS n1, {era_case(HAY, R.CENTURY_PATTERNS, 'NULL', False)} AS n2 FROM {pool} p JOIN asking a ON a.plan_id = p.plan_id JOIN gd g ON g.cand_id = p.cand_id),
{name}_o AS (SELECT *, CASE WHEN gs < 38 OR severe THEN 'local_quality' ELSE {conflict} END AS out_r FROM {name}_j),
{name}_s AS (SELECT o.*, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY place) AS INT) AS ck FROM {name}_o o WHERE out_r IS NULL QUALIFY ck <= {checks}),
{name}_c AS (SELECT s.*, r.acc, r.cand_id IS NOT NULL AS judged, r.cand_id IS NOT NULL AND (r.qu < 28 OR r.sc < 30 OR CASE WHEN s.lk THEN NOT r.acc OR r.sc < 70 ELSE r.hard_flag END) AS hard,
  round(s.score + s.gs * 0.035::DOUBLE + coalesce(r.sc * 0.16::DOUBLE + r.tm * 0.075::DOUBLE + r.qu * 0.075::DOUBLE + CASE WHEN r.acc THEN 4.0 ELSE -4.0 END, -3.0), 9) AS combined FROM {name}_s s LEFT JOIN rep r ON r.cand_id = s.cand_id),
{name}_e AS (SELECT plan_id, max(ck) AS checks, max(place) AS stop FROM {name}_c GROUP BY 1),
{name}_r AS (SELECT o.plan_id, o.cand_id, o.place, o.out_r AS reason, o.out_r <> 'local_quality' AS hard FROM {name}_o o LEFT JOIN {name}_e e USING (plan_id) WHERE out_r IS NOT NULL AND (coalesce(checks, 0) < {checks} OR place < stop)
  UNION ALL SELECT plan_id, cand_id, place, 'judge', hard FROM {name}_c WHERE hard OR (judged AND NOT acc)),
{name} AS (SELECT c.*, checks FROM {name}_c c JOIN {name}_e USING (plan_id) WHERE NOT hard QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY combined DESC, place) = 1)"""


BEST = FOUND + "," + ranked("pool", False) + "," + GUARDS + "," + REPLIES + "," + selected("pool", "best", 5)
sql("select_best", BEST, "SELECT plan_id, cand_id, place, checks, round(combined, 4) AS combined FROM best")
sql("rejected_candidates", BEST, "SELECT plan_id, cand_id, place, reason, hard FROM best_r")


def level(name: str, pool: str, checks: int, done: list[str]) -> str:
    # Lower levels: unlocked scenes still open, without the URLs rejected before.
    open_ = " AND ".join(f"plan_id NOT IN (SELECT plan_id FROM {d})" for d in done)
    gone = " AND ".join(f"(plan_id, cand_id) NOT IN (SELECT (plan_id, cand_id) FROM {d}_r WHERE reason <> 'local_quality')" for d in done)
    return f"{name}_p AS (SELECT * FROM {pool} WHERE NOT lk AND {open_} AND {gone})," + selected(f"{name}_p", name, checks)


LADDER = (
    FOUND + "," + ranked("pool", False) + "," + recovered("rpool", False) + "," + GUARDS + "," + REPLIES + ", odd AS (SELECT * FROM pool WHERE cand_id % 2 = 1),"
    + selected("odd", "l1", 5) + "," + level("l2", "rpool", 4, ["l1"]) + "," + level("l3", "rpool", 3, ["l1", "l2"])
)
sql("fallback_ladder", LADDER, """, f AS (SELECT plan_id, cand_id, 'exact' AS level FROM l1 UNION ALL SELECT plan_id, cand_id, 'close' FROM l2 UNION ALL SELECT plan_id, cand_id, 'context' FROM l3)
SELECT plan_id, CASE WHEN level = 'exact' THEN 'downloaded' WHEN level IS NOT NULL THEN 'downloaded_recovery' WHEN lk THEN 'not_found_locked' ELSE 'not_found_recovery' END AS status, level, cand_id FROM asking LEFT JOIN f USING (plan_id)""")

sql("accepted_choices", CANDIDATES + "," + GUARDS, """, c AS (SELECT user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_id % 200 AS cand_id, CAST((event_id * 31) % 62 AS INT) AS fit FROM events),
k AS (SELECT c.* FROM c JOIN gd USING (cand_id) WHERE gs >= 55 AND fit >= 30)
SELECT plan_id, cand_id, fit, fit < 55 AS emergency FROM k QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN fit >= 55 THEN 0 ELSE 1 END, CASE WHEN fit >= 55 THEN place ELSE -fit END, place) = 1""")

sql("overlay_scores", JUDGE, """, r AS (SELECT match_level AS query_id, cand_id AS pos, ((cand_id * 7) % 20)::DOUBLE AS base, cand_id % 4 > 0 AS judged, cand_id % 5 > 0 AS has, score, quality_score, accept, tone_match / 100.0::DOUBLE AS sim FROM judgements),
s AS (SELECT *, CASE WHEN has THEN score ELSE 50 END + base AS sc, CASE WHEN has THEN quality_score ELSE 50 END AS qu FROM r),
k AS (SELECT *, CASE WHEN judged THEN sc * 0.68::DOUBLE + qu * 0.32::DOUBLE ELSE sim * 100.0::DOUBLE + base END AS t FROM s WHERE NOT judged OR NOT has OR (accept AND sc >= 45 AND qu >= 40))
SELECT query_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY t DESC, pos) AS INT) AS place, round(t, 6) AS score FROM k""")
sql("best_stickers", SIMILAR, """, s AS (SELECT prompt_id, 'a' || (item_id % 40) AS asset, max(score) AS score FROM sims GROUP BY 1, 2)
SELECT prompt_id, asset, score FROM s WHERE score > 0 AND asset <> 'a' || (prompt_id % 40) QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, asset) = 1""")

sql("cutout_search", CANDIDATES, f""", q AS (SELECT *, CASE lang WHEN 'en' THEN ['the', 'and', 'ing'] WHEN 'fr' THEN ['que', 'la', 'eau'] WHEN 'de' THEN ['der', 'sch'] ELSE ['de', 'la', 'ci', 'n'] END AS qt, lower(title || CASE WHEN cand_id % 6 = 0 THEN ' Sticker' WHEN cand_id % 7 = 0 THEN ' Flag' ELSE '' END || ' ' || description) AS meta, cand_id % 5 = 0 AND cand_id % 3 = 0 AND lang <> 'fr' AND width >= 240 AND height >= 240 AS png FROM candidates WHERE kind = 'image'),
k AS (SELECT *, len(list_filter(qt, lambda t: contains(meta, t))) * 4.0::DOUBLE + CASE WHEN png AND {has('meta', CUT.CUTOUT_STYLE)} THEN 3 ELSE 0 END AS base FROM q WHERE NOT {has('meta', CUT.CUTOUT_REJECT)} AND (png OR (width >= 420 AND height >= 320))),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, png ORDER BY cand_id) AS INT) AS place, bool_or(png) OVER (PARTITION BY lang) AS any_png FROM k)
SELECT lang AS query_id, cand_id AS pos, place, png AS cutout, base FROM n WHERE place <= CASE WHEN png THEN 8 ELSE 10 END AND (png OR NOT any_png)""".replace("['de', 'la', 'ci', 'n']", "['de', 'la', 'ci', 'n']"))

# --- duplicates and coverage ----------------------------------------------------------

sql("material_usage", "", """WITH e AS (SELECT user_id AS plan_id, CASE WHEN event_type IN ('error', 'signup') THEN 'release' ELSE 'register' END AS op, CAST(floor(value) AS BIGINT) % 20 AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id DESC) = 1)
SELECT plan_id, 'url://' || k AS name, count(*) AS uses, 'url' AS what FROM e WHERE op = 'register' GROUP BY 1, 2 UNION ALL SELECT plan_id, 'title ' || k, count(*), 'title' FROM e WHERE op = 'register' GROUP BY 1, 2""")
sql("exact_duplicates", "", """WITH d AS (SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY source, text) AS original FROM documents)
SELECT doc_id, original, digest FROM d WHERE doc_id > original""")

from .oracle_text import PX  # noqa: E402

sql("near_duplicates", f"""
pic AS (SELECT vec_id, list_transform({PX}, lambda v: CASE WHEN v * 256 >= list_sum({PX}) THEN '1' ELSE '0' END) AS h FROM embeddings),
s0 AS (SELECT vec_id // 40 AS plan_id, CAST(vec_id % 40 AS INT) AS scene_idx, (vec_id // 40) * 40 + (vec_id % 40) % 7 AS base, vec_id, [0, 5, 20, 24, 25, 26][vec_id % 6 + 1] AS flips FROM embeddings),
s AS (SELECT plan_id, scene_idx, CASE WHEN s0.vec_id % 13 = 0 THEN 'blank' WHEN s0.vec_id % 3 = 0 THEN 'video' ELSE 'image' END AS kind, 'clip' || (s0.vec_id % 37) AS path, CASE WHEN s0.vec_id % 17 > 0 THEN md5(CAST(s0.vec_id % 35 AS VARCHAR)) END AS dg,
  xor(CAST(array_to_string(h, '') AS BIT), CAST(repeat('0', 256 - flips) || repeat('1', flips) AS BIT)) AS h FROM s0 JOIN pic ON pic.vec_id = s0.base),
a AS (SELECT *, min(scene_idx) OVER (PARTITION BY plan_id, path) AS fp FROM s WHERE kind <> 'blank'),
b AS (SELECT *, CASE WHEN dg IS NOT NULL THEN min(scene_idx) OVER (PARTITION BY plan_id, dg) END AS fd FROM a WHERE scene_idx = fp),
c AS (SELECT plan_id, kind, scene_idx, h, row_number() OVER (PARTITION BY plan_id ORDER BY scene_idx) AS r FROM b WHERE scene_idx = fd),
f AS (SELECT plan_id, r, scene_idx, [{{'s': scene_idx, 'k': kind, 'h': h}}] AS kept, NULL::STRUCT(d BIGINT, s INT) AS m FROM c WHERE r = 1
  UNION ALL SELECT plan_id, r, scene_idx, CASE WHEN m IS NULL THEN list_append(kept, {{'s': scene_idx, 'k': kind, 'h': h}}) ELSE kept END, m FROM (
    SELECT c.*, f.kept, list_min(list_transform(list_filter(f.kept, lambda x: x.k = c.kind AND bit_count(xor(x.h, c.h)) <= CASE WHEN c.kind = 'video' THEN 20 ELSE 25 END), lambda x: {{'d': bit_count(xor(x.h, c.h))::BIGINT, 's': x.s}})) AS m
    FROM f JOIN c ON c.plan_id = f.plan_id AND c.r = f.r + 1))""",
    """SELECT plan_id, scene_idx, fp AS original_scene, 1.0::DOUBLE AS similarity, 'same_path' AS reason FROM a WHERE scene_idx > fp
UNION ALL SELECT plan_id, scene_idx, fd, 1.0, 'same_bytes' FROM b WHERE scene_idx > fd UNION ALL SELECT plan_id, scene_idx, m.s, round(1.0::DOUBLE - m.d / 256.0::DOUBLE, 6), 'near_duplicate' FROM f WHERE m IS NOT NULL""")


sql("diversity_summary", "", ORACLE["repetition_runs"].replace("SELECT plan_id, scene_idx, CASE WHEN lng THEN 'run' ELSE 'return' END AS rule FROM f WHERE lng OR ret", """, dup AS (SELECT plan_id, count(*) AS n FROM f WHERE lng OR ret GROUP BY 1)
SELECT s.plan_id, count(*) FILTER (asset_kind <> 'blank') AS materialized_scenes, coalesce(any_value(n), 0) AS duplicate_scenes, greatest(0, count(*) FILTER (asset_kind <> 'blank') - coalesce(any_value(n), 0)) AS unique_visuals FROM shots s LEFT JOIN dup USING (plan_id) GROUP BY 1"""))

dark = "(" + ", ".join(lit(t) for t in R.DARK_TONES) + ")"
light = "(" + ", ".join(lit(t) for t in R.LIGHT_TONES) + ")"
sql("cover_blanks", SHOTS, f""", g AS (SELECT * FROM shots WHERE asset_kind <> 'blank'),
p AS (SELECT b.plan_id, b.scene_idx, g.asset, g.asset_kind, g.scene_idx AS s, CASE WHEN NOT b.semantic_lock THEN CASE WHEN NOT g.semantic_lock AND CASE WHEN b.tone IN {dark} THEN g.tone IN {dark} OR g.tone IN ('emotional', 'mysterious', 'neutral') WHEN b.tone IN {light} THEN g.tone IN {light} OR g.tone IN ('neutral', 'emotional') ELSE true END THEN 0 END
  ELSE CASE WHEN g.semantic_lock THEN 0 ELSE 1 END END AS lv FROM shots b JOIN g ON g.plan_id = b.plan_id WHERE b.asset_kind = 'blank'),
q AS (SELECT * FROM p WHERE lv IS NOT NULL QUALIFY lv = min(lv) OVER (PARTITION BY plan_id, scene_idx)),
o AS (SELECT plan_id, scene_idx, list({{'a': asset, 'k': asset_kind, 's': s}} ORDER BY abs(s - scene_idx), CASE WHEN s < scene_idx THEN 0 ELSE 1 END, s) AS opts FROM q GROUP BY 1, 2),
t AS (SELECT s.plan_id, s.scene_idx, s.asset, opts FROM shots s LEFT JOIN o USING (plan_id, scene_idx)),
f AS (SELECT plan_id, scene_idx, CASE WHEN asset IS NULL THEN opts[1] END AS pick, ['', '', coalesce(asset, opts[1].a, '')] AS mem FROM t WHERE scene_idx = 0
  UNION ALL SELECT plan_id, scene_idx, pick, list_append(mem[2:3], coalesce(asset, pick.a, '')) FROM (
    SELECT t.plan_id, t.scene_idx, t.asset, f.mem, CASE WHEN t.asset IS NULL THEN coalesce(list_filter(t.opts, lambda x: NOT list_contains(f.mem, x.a))[1], t.opts[1]) END AS pick FROM f JOIN t ON t.plan_id = f.plan_id AND t.scene_idx = f.scene_idx + 1))
SELECT plan_id, scene_idx, pick.s AS source_scene, pick.a AS asset, pick.k AS asset_kind, CASE WHEN pick.k = 'video' THEN 'micro_push' ELSE 'slow_push' END AS motion_preset FROM f WHERE pick IS NOT NULL""")

# --- cues and effects -------------------------------------------------------------------


def cues(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT plan_id, start_ms + {delay} AS time_ms, CAST(scene_idx AS BIGINT) * 8 + {n} AS ord, {lit(kind)} AS kind, {lit(name)} AS name, {gain}::DOUBLE AS gain_db FROM {source} WHERE "
        + ("scene_idx > 0" if pattern is None else f"regexp_matches(lower(caption), {lit(pattern)})")
        for n, (pattern, delay, kind, name, gain) in enumerate(Q.CUES)
    )


sql("plan_cues", SCENES, cues("scenes"))
sql("cue_records", SCENES, f""", k AS ({cues('scenes')}), l AS (SELECT plan_id, CAST(count(*) AS INT) AS cues, string_agg(kind || ':' || name, '|' ORDER BY time_ms, ord, kind, name, gain_db) AS names,
  round(max(time_ms) / 1000.0::DOUBLE, 3) AS last_time, arg_max(gain_db, (time_ms, ord, kind, name, gain_db)) AS last_gain_db FROM k GROUP BY 1), m AS ({ORACLE['plan_mood'].split(chr(10))[-1]})
SELECT plan_id, mood, -22.0::DOUBLE AS music_gain_db, coalesce(cues, 0) AS cues, names, last_time, last_gain_db FROM m LEFT JOIN l USING (plan_id)""")
sql("cues_deduped", SCENES, f""", sc AS (SELECT * REPLACE (CAST(floor(start_ms / 40) AS BIGINT) AS start_ms) FROM scenes), c AS ({cues('sc')}), n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY time_ms, ord) AS r FROM c),
f AS (SELECT plan_id, r, time_ms, ord, kind, name, gain_db, true AS kept, name AS ln, time_ms AS lt FROM n WHERE r = 1
  UNION ALL SELECT n.plan_id, n.r, n.time_ms, n.ord, n.kind, n.name, n.gain_db, NOT (n.name = f.ln AND n.time_ms - f.lt < 450), CASE WHEN n.name = f.ln AND n.time_ms - f.lt < 450 THEN f.ln ELSE n.name END, CASE WHEN n.name = f.ln AND n.time_ms - f.lt < 450 THEN f.lt ELSE n.time_ms END
  FROM f JOIN n ON n.plan_id = f.plan_id AND n.r = f.r + 1)
SELECT plan_id, time_ms, ord, kind, name, gain_db FROM f WHERE kept""")

# The five planted queries and the prop each one yields.
sql("object_queries", SCENES, "SELECT plan_id, scene_idx, ['milk carton', 'price tag', 'smartphone', 'old tower', 'red door detail'][scene_idx % 5 + 1] AS prop FROM scenes")
PROP = f"CASE {' '.join(f'WHEN {has(chr(104), ns)} THEN {lit(p)}' for p, ns in P.PROPS)} ELSE q END"
EFFECTS = PLANTED + f""",
fx0 AS (SELECT plan_id, scene_idx, caption, end_ms, start_ms, ['milk carton', 'price tag close up', 'person holding phone', 'old tower', 'red door detail'][scene_idx % 5 + 1] AS q FROM planted),
fx1 AS (SELECT *, lower(caption || ' ' || q || ' ' || q) AS h, CASE WHEN regexp_matches(caption, {lit(QTY)}) THEN {squash(f'regexp_extract(caption, {lit(QTY)}, 2)')} END AS qty FROM fx0),
fx AS (SELECT *, {PROP} AS prop FROM fx1),
bq AS (SELECT * FROM fx WHERE qty IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id, lower(qty) ORDER BY scene_idx) = 1),
bp AS (SELECT f.* FROM fx f WHERE NOT EXISTS (SELECT 1 FROM bq WHERE bq.plan_id = f.plan_id AND bq.scene_idx = f.scene_idx) QUALIFY row_number() OVER (PARTITION BY f.plan_id, lower(prop) ORDER BY f.scene_idx) = 1),
raw AS (SELECT plan_id, scene_idx, 'png_text' AS type, prop AS query, qty AS label, 'hero' AS size, 3 AS strength FROM bq UNION ALL SELECT plan_id, scene_idx, 'png', prop, '', CASE WHEN scene_idx % 4 = 0 THEN 'hero' ELSE 'large' END, 2 FROM bp),
bud AS (SELECT plan_id, max(end_ms) AS plan_end, max(scene_idx) AS last_scene, CAST(least(greatest(round_even(max(end_ms) / 1000.0::DOUBLE / 5.5, 0), 2), 8) AS INT) AS budget FROM scenes GROUP BY 1),
slots AS (SELECT plan_id, budget, unnest(range(budget)) AS slot, greatest(1, last_scene) AS total FROM bud),
cost AS (SELECT s.plan_id, slot, budget, list(r.scene_idx ORDER BY round(CAST(abs(r.scene_idx - (slot + 0.5::DOUBLE) / budget * total) - 0.20::DOUBLE * strength AS DOUBLE), 9), r.scene_idx) AS o FROM slots s JOIN raw r ON r.plan_id = s.plan_id GROUP BY 1, 2, 3),
tk AS (SELECT plan_id, slot, [o[1]] AS used FROM cost WHERE slot = 0
  UNION ALL SELECT c.plan_id, c.slot, CASE WHEN list_filter(c.o, lambda x: NOT list_contains(t.used, x))[1] IS NULL THEN t.used ELSE list_append(t.used, list_filter(c.o, lambda x: NOT list_contains(t.used, x))[1]) END FROM tk t JOIN cost c ON c.plan_id = t.plan_id AND c.slot = t.slot + 1),
chosen AS (SELECT tk.plan_id, unnest(used) AS scene_idx FROM tk JOIN bud ON bud.plan_id = tk.plan_id AND tk.slot = bud.budget - 1),
local_fx AS (SELECT raw.* FROM raw JOIN chosen USING (plan_id, scene_idx))"""
sql("local_effects", EFFECTS, "SELECT plan_id, scene_idx, type, query, label, CASE WHEN scene_idx % 2 = 1 THEN 'left' ELSE 'right' END AS position, size, strength FROM local_fx")
sql("overlay_budgets", SCENES, """SELECT plan_id, max(end_ms) AS plan_end, max(scene_idx) AS last_scene, CAST(least(greatest(round_even(max(end_ms) / 1000.0::DOUBLE / 5.5, 0), 2), 8) AS INT) AS budget,
  CAST(least(least(greatest(round_even(max(end_ms) / 1000.0::DOUBLE / 5.5, 0), 2), 8), greatest(2, round_even(max(end_ms) / 1000.0::DOUBLE / 7.0, 0))) AS INT) AS min_target FROM scenes GROUP BY 1""")

PROMPTS = "[" + ", ".join(lit(p) for _, _, p in R.REACTION_RULES) + "]"
STICK = EFFECTS + f""",
sr AS (SELECT plan_id, scene_idx, lower(caption || ' ' || q) AS t FROM fx0),
sp AS (SELECT plan_id, scene_idx, CASE {' '.join(f"WHEN {has('t', ns)} THEN {n + 1}" for n, (_, ns, _) in enumerate(R.REACTION_RULES))} END AS k FROM sr),
sb AS (SELECT {PROMPTS}[label % 6 + 1] AS prompt, 's' || (vec_id % 50) AS asset, max(round(CAST(embedding[1] AS DOUBLE), 4)) AS score FROM embeddings GROUP BY 1, 2),
so AS (SELECT prompt, list(asset ORDER BY score DESC, asset) AS o FROM sb WHERE score > 0 GROUP BY 1),
sn AS (SELECT sp.plan_id, scene_idx, {PROMPTS}[k] AS prompt, [5, 5, 5, 4, 4, 4][k] AS st, ['skeptical', 'shocked', 'laugh', 'skeptical', 'angry', 'sad'][k] AS fam, o, row_number() OVER (PARTITION BY sp.plan_id ORDER BY [5, 5, 5, 4, 4, 4][k] DESC, scene_idx, {PROMPTS}[k]) AS r FROM sp JOIN so ON so.prompt = {PROMPTS}[k] WHERE k IS NOT NULL),
sw AS (SELECT plan_id, 0::BIGINT AS r, []::STRUCT(s INT, p VARCHAR, f VARCHAR, a VARCHAR, st INT, n INT)[] AS acc FROM bud
  UNION ALL SELECT w.plan_id, n.r, CASE WHEN len(acc) < least(2, budget // 2) AND len(list_filter(acc, lambda x: x.f = n.fam OR abs(x.s - n.scene_idx) < 2)) = 0 AND list_filter(n.o, lambda a: len(list_filter(acc, lambda x: x.a = a)) = 0)[1] IS NOT NULL
    THEN list_append(acc, {{'s': n.scene_idx, 'p': n.prompt, 'f': n.fam, 'a': list_filter(n.o, lambda a: len(list_filter(acc, lambda x: x.a = a)) = 0)[1], 'st': n.st + 2, 'n': len(acc)::INT}}) ELSE acc END FROM sw w JOIN sn n ON n.plan_id = w.plan_id AND n.r = w.r + 1 JOIN bud b ON b.plan_id = w.plan_id),
stk AS (SELECT plan_id, unnest(acc) AS a FROM sw QUALIFY r = max(r) OVER (PARTITION BY plan_id))"""
sql("sticker_effects", STICK, "SELECT plan_id, a.s AS scene_idx, a.p AS query, a.a AS asset, CASE WHEN a.n % 2 = 1 THEN 'left' ELSE 'right' END AS position, CASE WHEN a.f IN ('shocked', 'laugh', 'angry') THEN 'pop' ELSE 'fly' END AS animation, a.st AS strength FROM stk")
sql("effects_merged", STICK, """, src AS (SELECT plan_id, a.s AS scene_idx, 'sticker' AS type, a.p AS query, '' AS label, '' AS anchor, 0 AS src FROM stk
  UNION ALL SELECT plan_id, scene_idx, ['png', 'png_text', 'text', 'sticker', 'banner'][scene_idx % 5 + 1], 'thing ' || ['red', 'blue', 'green'][scene_idx % 3 + 1], w, CASE WHEN scene_idx % 4 = 3 THEN 'nowhere' ELSE w END, 1 FROM (SELECT *, array_to_string(list_slice(list_filter(regexp_split_to_array(caption, '\\s+'), lambda x: x <> ''), 1, 2), ' ') AS w FROM fx0 WHERE plan_id % 2 = 0)
  UNION ALL SELECT plan_id, scene_idx, type, query, label, label, 2 FROM local_fx WHERE plan_id % 2 = 1),
z AS (SELECT s.*, CASE WHEN label <> '' THEN 4 ELSE 0 END + CASE WHEN f.qty IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN regexp_matches(anchor, '\\d') THEN 2 ELSE 0 END AS cs, lower(""" + squash("regexp_replace(query, '[^a-zA-Z0-9 ''-]', ' ', 'g')") + """) AS ky FROM src s JOIN fx f USING (plan_id, scene_idx)),
d AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY plan_id, ky ORDER BY cs DESC, src, scene_idx) = 1)
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY scene_idx, src, query, type) - 1 AS pos, scene_idx, type, query, src FROM d""")

# --- rewrites -----------------------------------------------------------------------------


def keyword_list(col: str, n: int) -> str:
    stop = "[" + ", ".join(lit(w) for w in T.STOPWORDS) + "]"
    cleaned = f"list_filter(list_transform(regexp_split_to_array({col}, '\\s+'), lambda w: lower(regexp_replace(regexp_replace(regexp_replace(w, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]+', '', 'g'), '^[_-]+', ''), '[_-]+$', ''))), lambda t: length(t) >= 2 AND NOT list_contains({stop}, t))"
    return f"array_to_string(list_slice({ordered(cleaned)}, 1, {n}), ' ')"


def merged(parts: list[str], n: int | None = None) -> str:
    """Ordered distinct of squashed, non-blank strings (case-insensitive)."""
    base = "list_filter([" + ", ".join(squash(p) for p in parts) + "], lambda x: x <> '')"
    low = f"list_transform({base}, lambda x: lower(x))"
    out = f"list_filter({base}, lambda x, i: list_position({low}, lower(x)) = i)"
    return f"list_slice({out}, 1, {n})" if n else out


def described(source: str, context_sql: str, near: str, archival: str, name: str = "described") -> str:
    """Scene descriptions by the default rules over ``source`` (plan_id, scene_idx, start_ms, end_ms, caption)."""
    t = "lower(caption)"
    return f"""
{name}_m AS (SELECT *, {t} AS t, CASE WHEN {has(t, R.MEME_STEMS)} THEN 'meme' WHEN {has(t, R.VIDEO_STEMS)} THEN 'video' WHEN scene_idx > 0 AND scene_idx % 4 = 3 AND end_ms - start_ms >= 1400 THEN 'video' ELSE 'image' END AS vm, {entities(t)} AS ent, {context(t)} AS ctx, {every(t, R.HINT_RULES)} AS hints,
  {keyword_list('caption', 5)} AS own, {keyword_list(near, 3)} AS near, {context_sql} AS setting FROM {source}),
{name}_d AS (SELECT *, CASE WHEN vm = 'meme' THEN 'meme_library' WHEN {archival} AND {has('t', R.HISTORY_STEMS)} THEN 'historical_archive' WHEN vm = 'video' THEN 'stock_video' ELSE 'generic_image' END AS sm,
  CASE WHEN vm = 'meme' THEN 'none' WHEN {has('t', R.PULLBACK_STEMS)} THEN 'pull_back' WHEN {has('t', R.DRAMATIC_STEMS)} THEN 'dramatic_push' WHEN scene_idx % 5 = 2 THEN 'reveal_right' WHEN scene_idx % 5 = 4 THEN 'reveal_left' WHEN vm = 'image' THEN 'slow_push' ELSE 'micro_push' END AS mp,
  array_to_string(ent, ' ') AS named, trim(coalesce(nullif(array_to_string(ent, ' '), '') || ' ', '') || coalesce(hints[1], 'documentary scene related to narration') || CASE vm WHEN 'video' THEN ' moving documentary B-roll' WHEN 'meme' THEN ' reaction meme insert' ELSE ' documentary visual' END) AS descr,
  CASE vm WHEN 'video' THEN 'video b roll' WHEN 'meme' THEN 'reaction meme' ELSE 'photo illustration' END AS suf, {tone_case('t', R.TONE_RULES)} AS tone FROM {name}_m),
{name} AS (SELECT *, {merged(["coalesce(named, '') || ' ' || setting || ' ' || coalesce(hints[1], own) || ' ' || suf", "setting || ' ' || descr", "setting || ' ' || own || ' ' || suf", "CASE WHEN own = '' THEN near ELSE own END || ' ' || suf"])} AS qs, len(ent) > 0 AS lk FROM {name}_d)"""


DESC = PLANTED + "," + described("planted", lit("China Chinese 19th century"), "caption", "true")
OUT = "plan_id, scene_idx, {q} AS query, array_to_string({qs}, '|') AS queries, {d} AS visual_description, {vm} AS visual_mode, {sm} AS source_mode, {mp} AS motion_preset"
plain = OUT.format(q="qs[1]", qs="qs", d="descr", vm="vm", sm="sm", mp="mp")
sql("scene_descriptions", DESC, f"SELECT {plain}, lk AS semantic_lock, tone FROM described")

HINT = "CASE tone " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in R.TONE_HINTS.items()) + " ELSE '' END"
sql("query_variants", DESC, f""", h AS (SELECT *, {HINT} AS th, array_to_string(list_concat(ent, CASE WHEN lk THEN ctx ELSE [] END), ' ') AS lt, array_to_string(list_concat(ent, ctx, ['archival illustration']), ' ') AS fb FROM described),
l AS (SELECT *, list_concat(CASE WHEN lk THEN [lt || ' ' || descr, lt || ' historical illustration', lt || ' archival portrait', fb] ELSE [] END, list_transform(qs, lambda q: q || ' ' || th), [descr || ' ' || th, qs[1]],
  CASE WHEN sm = 'historical_archive' THEN [descr || ' archival engraving', descr || ' historical painting'] WHEN vm = 'video' THEN [descr || ' ' || th || ' documentary footage', descr || ' b roll'] WHEN vm = 'meme' THEN [descr || ' reaction'] ELSE [descr || ' ' || th || ' photo illustration'] END) AS raw FROM h),
u AS (SELECT plan_id, scene_idx, {squash('unnest(raw)')} AS q, generate_subscripts(raw, 1) AS i FROM l),
f AS (SELECT * FROM u WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY plan_id, scene_idx, lower(q) ORDER BY i) = 1)
SELECT plan_id, scene_idx, CAST(row_number() OVER (PARTITION BY plan_id, scene_idx ORDER BY i) - 1 AS INT) AS query_idx, q AS query FROM f""")

first5 = f"array_to_string(list_slice({ordered('list_filter(regexp_extract_all(lower(caption), ' + lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_-]+') + '), lambda t: length(t) > 1)')}, 1, 5), ' ')"
sql("recovery_queries", DESC, f""", k AS (SELECT plan_id, scene_idx, descr, {first5} AS w, CASE WHEN vm = 'video' THEN 'real footage' ELSE 'documentary photo' END AS kd FROM described),
l AS (SELECT plan_id, scene_idx, {merged(["descr || ' ' || kd", "w || ' ' || kd", "'person ' || w || ' action ' || kd"])} AS q FROM k)
SELECT plan_id, scene_idx, CAST(generate_subscripts(q, 1) - 1 AS INT) AS query_idx, unnest(q) AS query FROM l""")


def ends(options) -> str:
    return "[" + ", ".join(f"b || ' ' || {lit(o)}" for o in options) + "]"


VAR = (
    f"CASE WHEN lk THEN {ends(P.VARIATION_LOCKED[1])} WHEN {has('t', P.VARIATION_ARMY)} AND sm = 'historical_archive' THEN {ends(P.VARIATION_ARMY_ARCHIVE)} WHEN {has('t', P.VARIATION_ARMY)} THEN {ends(P.VARIATION_ARMY_STOCK)} WHEN {has('t', P.VARIATION_DREAM)} THEN {ends(P.VARIATION_DREAM_LATER)} "
    + " ".join(f"WHEN {has('t', ns)} THEN {ends(o)}" for ns, o in P.VARIATION_TOPICS) + f" ELSE {ends(P.VARIATION_PLAIN[1])} END"
)


def dedup_list(lst: str, n: int) -> str:
    low = f"list_transform({lst}, lambda x: lower(x))"
    return f"list_slice(list_filter({lst}, lambda x, i: list_position({low}, lower(x)) = i), 1, {n})"


sql("plan_records", DESC, """SELECT plan_id, (SELECT max(end_ms) FROM scenes s WHERE s.plan_id = d.plan_id) AS duration_ms, CAST(count(*) AS INT) AS scenes, round(arg_min(start_ms, scene_idx) / 1000.0::DOUBLE, 3) AS first_start,
  round(arg_max(end_ms, scene_idx) / 1000.0::DOUBLE, 3) AS last_end, string_agg(CASE WHEN scene_idx % 2 = 0 THEN '' ELSE '/media/out/' END || scene_idx, '|' ORDER BY scene_idx) AS assets,
  string_agg(vm, '|' ORDER BY scene_idx) AS modes, string_agg(lk::VARCHAR, '|' ORDER BY scene_idx) AS locks, arg_max(caption, scene_idx) AS last_caption FROM described d GROUP BY plan_id""")
sql("repairs_prepared", DESC, f""", v AS (SELECT *, qs[1] AS b, scene_idx % 2 = 1 AS fx FROM described), w AS (SELECT *, list_concat({VAR}, qs) AS al FROM v),
x AS (SELECT *, CASE WHEN fx THEN {dedup_list('al', 8)} ELSE qs END AS nq, fx AND NOT lk AND sm IN ('generic_image', 'auto') AS tv FROM w)
SELECT {OUT.format(q='nq[1]', qs='nq', d=f"CASE WHEN fx AND NOT lk THEN regexp_replace(descr, '[ .]+$', '') || '. ' || {lit(P.REPAIR_NOTE)} ELSE descr END", vm="CASE WHEN tv THEN 'video' ELSE vm END", sm="CASE WHEN tv THEN 'stock_video' ELSE sm END", mp='mp')} FROM x""")


def texts(options) -> str:
    return "[" + ", ".join(lit(o) for o in options) + "]"


STYLE = "CASE " + " ".join(
    f"WHEN {has('st', ns)} THEN " + (f"CASE WHEN {has('st', P.STYLE_AWAKE)} THEN {texts(P.STYLE_AWAKE_QUERIES)} ELSE {texts(qs)} END" if "проснул" in ns else texts(qs))
    for ns, qs in P.STYLE_RECIPES
) + f" WHEN {has('st', P.STYLE_ACTION)} THEN [sb || ' real footage', sb || ' action b roll'] ELSE [sb || ' real footage', sb || ' vertical b roll', sb || ' people action'] END"
from .oracle_text import edges, wrap  # noqa: E402

sql("video_first_style", DESC, f""", a AS (SELECT *, t || ' ' || lower(descr) || ' ' || lower(qs[1]) AS st, coalesce(nullif({edges(wrap(T.STILL_BOILERPLATE, wrap(T.STILL_BOILERPLATE, 'descr')))}, ''), 'real human action') AS sb, NOT lk AND vm = 'meme' AND sm = 'meme_library' AS mm FROM described),
b AS (SELECT *, NOT lk AND NOT mm AS on_, list_concat({STYLE}, qs) AS al FROM a), c AS (SELECT *, CASE WHEN on_ THEN {dedup_list('al', 7)} ELSE qs END AS nq FROM b)
SELECT {OUT.format(q='nq[1]', qs='nq', d=f"CASE WHEN on_ THEN regexp_replace(descr, '[ .]+$', '') || '. ' || {lit(P.STYLE_NOTE)} ELSE descr END", vm="CASE WHEN on_ THEN 'video' WHEN lk THEN 'image' ELSE vm END", sm="CASE WHEN on_ THEN 'stock_video' WHEN lk THEN 'historical_archive' ELSE sm END", mp="CASE WHEN lk THEN 'micro_push' ELSE 'none' END")} FROM c""")

SCENES_CTX = CAPTIONS + f""",
plan_t AS (SELECT plan_id, lower(string_agg(caption, ' ' ORDER BY scene_idx)) AS t FROM captions GROUP BY 1),
ctx1 AS (SELECT plan_id, {has('t', R.HISTORY_STEMS)} AS hist, list_filter([{', '.join(f"CASE WHEN {has('t', ns)} THEN {lit(label)} END" for label, ns in R.COUNTRY_RULES)}, CASE WHEN {has('t', R.HISTORY_STEMS)} THEN 'historical archival' END], lambda x: x IS NOT NULL) AS p FROM plan_t),
near AS (SELECT c.*, array_to_string(p, ' ') AS gctx, concat_ws(' ', lag(caption) OVER o, caption, lead(caption) OVER o) AS nb FROM captions c JOIN ctx1 USING (plan_id) WINDOW o AS (PARTITION BY plan_id ORDER BY scene_idx)),"""
sql("scenes_built", SCENES_CTX + described("near", "gctx", "nb", "contains(gctx, 'historical archival')"), f"""SELECT plan_id, scene_idx, start_ms, end_ms, qs[1] AS query, array_to_string(qs, '|') AS queries, descr AS visual_description, CASE WHEN lk THEN 'image' ELSE vm END AS visual_mode, CASE WHEN lk THEN 'historical_archive' ELSE sm END AS source_mode, mp AS motion_preset, lk AS semantic_lock, tone FROM described""")

BOIL = T.ACTION_BOILERPLATE


def action_clean(c: str) -> str:
    return f"substring({squash(wrap(BOIL, wrap(BOIL, edges(c))))}, 1, 120)"


def hit_rules(col: str, placed: bool) -> str:
    """Query lists of the rules that hit, by first place in the text or in rule order."""
    parts = []
    for i, (needles, queries) in enumerate(P.ACTION_RECIPES):
        at = "least(" + ", ".join(f"nullif(strpos({col}, {lit(n)}), 0)" for n in needles) + ")" if placed else "0"
        parts.append(f"CASE WHEN {has(col, needles)} THEN {{'p': CAST({at} AS BIGINT), 'i': {i}, 'q': {texts(queries)}}} END")
    return f"flatten(list_transform(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), lambda x: x.q))"


sql("action_first", DESC, f""", a0 AS (SELECT *, NOT lk AND sm <> 'historical_archive' AND NOT (vm = 'meme' AND sm = 'meme_library') AS on_, {hit_rules('t', True)} AS r1, lower(qs[1] || ' ' || array_to_string(qs, ' ')) AS wide, list_transform(qs, lambda x: {action_clean('x')}) AS cq FROM described),
a1 AS (SELECT *, CASE WHEN len(r1) > 0 THEN r1 ELSE {hit_rules('wide', False)} END AS rl, {dedup_list('cq', 3)} AS mine FROM a0),
a15 AS (SELECT *, flatten(list_transform(mine, lambda b: CASE WHEN regexp_matches(lower(b), {lit('|'.join(R.ACTION_VERBS))}) THEN [b] ELSE ['person interacting with ' || b, 'hands using ' || b || ' close up', b || ' real action footage'] END)) AS wr FROM a1),
a16 AS (SELECT *, list_concat(rl, wr) AS rw FROM a15),
a2 AS (SELECT *, list_concat(list_transform(rw, lambda x: {action_clean('x')}), cq) AS al FROM a16),
a3 AS (SELECT *, CASE WHEN on_ THEN {dedup_list('al', 9)} ELSE qs END AS nq, regexp_replace(regexp_replace(descr, '^[ .]+', ''), '[ .]+$', '') AS base FROM a2)
SELECT {OUT.format(q='nq[1]', qs='nq', d=f"CASE WHEN on_ THEN substring(base || '. ' || {lit(P.ACTION_MARKER)} || ' ' || {lit(P.ACTION_NOTE)}, 1, 700) ELSE descr END", vm="CASE WHEN on_ THEN 'video' ELSE vm END", sm="CASE WHEN on_ THEN 'stock_video' ELSE sm END", mp="CASE WHEN on_ THEN 'none' ELSE mp END")} FROM a3""")

GRAMMAR = "CASE " + " ".join(
    f"WHEN role = {lit(r)} THEN {{{{'q': {texts(q)}, 'd': {lit(d)}, 'm': {lit(m)}, 's': {lit(sm)}}}}}".replace("{{", "{").replace("}}", "}") for r, (q, d, m, sm) in P.GRAMMAR.items()
)
tell = lambda a, b: f"CASE WHEN story THEN {texts(a)} ELSE {texts(b)} END"
GRAMMAR += (
    f" WHEN role = 'army' THEN {{'q': {tell(P.ARMY_STORY, P.ARMY_PLAIN)}, 'd': {lit(P.GRAMMAR_ARMY)}, 'm': 'image', 's': 'historical_archive'}}"
    f" WHEN role = 'aftermath' THEN {{'q': {tell(P.AFTERMATH_STORY, P.AFTERMATH_PLAIN)}, 'd': {lit(P.GRAMMAR_AFTERMATH)}, 'm': 'image', 's': CASE WHEN story THEN 'historical_archive' ELSE sm END}}"
    f" WHEN role = 'battle' THEN {{'q': {tell(P.BATTLE_STORY, P.BATTLE_PLAIN)}, 'd': {lit(P.GRAMMAR_BATTLE)}, 'm': 'image', 's': 'historical_archive'}} END"
)
SIG = "array_to_string(list_slice(list_filter(regexp_extract_all(lower({0}), '[a-zа-яё][a-zа-яё-]{{2,}}'), lambda t: NOT list_contains([" + ", ".join(lit(w) for w in T.SIGNATURE_STOP) + "], t)), 1, 4), ' ')"
from .oracle import VARY  # noqa: E402

sql("beat_grammar", DESC, f""", st AS (SELECT plan_id, bool_or({has('t', R.TAIPING_STORY)}) AS story FROM described GROUP BY 1),
g0 AS (SELECT d.* EXCLUDE (role), story, {role_case('t', *DEFAULT_ROLES)} AS role FROM described d JOIN st USING (plan_id)),
g1 AS (SELECT *, CASE WHEN NOT lk THEN {GRAMMAR} END AS g, {VARY} AS vq FROM g0),
g2 AS (SELECT *, list_concat(g.q, qs) AS al FROM g1),
g3 AS (SELECT *, CASE WHEN g IS NOT NULL THEN {dedup_list('al', 5)} ELSE qs END AS nq FROM g2),
g4 AS (SELECT *, {SIG.format('nq[1]')} AS sig, {SIG.format('vq')} AS vsig, list_concat([vq], nq) AS vl FROM g3),
g5 AS (SELECT *, {dedup_list('vl', 5)} AS vqs FROM g4),
w AS (SELECT plan_id, scene_idx, false AS vr, sig AS s, lk FROM g5 WHERE scene_idx = 0
  UNION ALL SELECT n.plan_id, n.scene_idx, NOT n.lk AND NOT w.lk AND n.sig <> '' AND n.sig = w.s AND n.vq <> '', CASE WHEN NOT n.lk AND NOT w.lk AND n.sig <> '' AND n.sig = w.s AND n.vq <> '' THEN n.vsig ELSE n.sig END, n.lk
  FROM w JOIN g5 n ON n.plan_id = w.plan_id AND n.scene_idx = w.scene_idx + 1)
SELECT g5.plan_id, g5.scene_idx, CASE WHEN vr THEN vqs[1] ELSE nq[1] END AS query, array_to_string(CASE WHEN vr THEN vqs ELSE nq END, '|') AS queries, coalesce(g.d, descr) AS visual_description, coalesce(g.m, vm) AS visual_mode, coalesce(g.s, sm) AS source_mode, mp AS motion_preset, g IS NOT NULL OR vr AS rewritten
FROM g5 JOIN w USING (plan_id, scene_idx)""")

sql("lexicon_table", "", """WITH n AS (SELECT needle, CAST(count(*) AS INT) AS c FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS needle FROM benchmark) WHERE length(needle) > 5 GROUP BY 1)
SELECT conv_id || ':' || turn AS key, 'words' AS ruleset, arg_min(needle, (-c, needle)) AS label FROM conversations JOIN n ON contains(lower(text), needle) GROUP BY 1, 2""")

# --- reports ----------------------------------------------------------------------------

sql("manifest_stats", "", """SELECT user_id AS plan_id, count(*) FILTER (event_id % 4 > 0) AS judged, count(*) FILTER (event_id % 4 > 0 AND event_id % 3 = 0) AS accepted, CAST(sum(CASE WHEN event_id % 5 > 0 THEN event_id % 3 ELSE 0 END) AS BIGINT) AS rejected,
  count(*) FILTER (event_id % 4 > 0 AND event_id % 9 = 0) AS fallback, CAST(sum(CASE WHEN event_id % 5 > 0 AND event_id % 100 < 58 THEN event_id % 3 ELSE 0 END) AS BIGINT) AS tone_rejected,
  CAST(sum(CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 AND (event_id * 7) % 100 < 55 THEN event_id % 3 ELSE 0 END) AS BIGINT) AS quality_rejected, CAST(sum(event_id % 4) AS BIGINT) AS local_rejected FROM events GROUP BY 1""")
sql("asset_summary", "", "SELECT user_id AS plan_id, count(*) AS scenes, count(*) FILTER (event_id % 4 < 2) AS downloaded, count(*) FILTER (event_id % 4 = 1) AS recovered, count(*) FILTER (event_id % 4 > 1) AS missing FROM events GROUP BY 1")
sql("lock_stats", "", "SELECT user_id AS plan_id, count(*) FILTER (event_id % 11 = 0) AS locked, count(*) FILTER (event_id % 4 = 3) AS unresolved FROM events GROUP BY 1")
sql("plan_summary", SHOTS, "SELECT plan_id, count(*) AS scenes, arg_max(end_ms, scene_idx) AS timeline_end_ms, count(*) FILTER (asset_kind <> 'blank') AS visuals FROM shots GROUP BY 1")
from .oracle import SPANS  # noqa: E402

sql("shot_rhythm", SPANS.replace("6000", "2850"), """, l AS (SELECT plan_id, asset_kind, CAST(hide_ms - show_ms AS BIGINT) AS d FROM spans)
SELECT plan_id, count(*) AS shots, round(avg(d), 3) AS mean_ms, CAST(median(d) AS DOUBLE) AS median_ms, min(d) AS min_ms, max(d) AS max_ms, round(sum(CASE WHEN asset_kind = 'video' THEN d ELSE 0 END)::DOUBLE / sum(d)::DOUBLE, 6) AS video_share FROM l GROUP BY 1""")

# --- final passes: every rung is one step of the same shape -----------------------------


def _rung(name: str, before: str, asks: str, found: str, step: str, number: int, offset: int, again: bool = True) -> str:
    """CTEs name_a (who asks), name_b (changed modes where queries are renewed) and name (what was found)."""
    video = f"fx AND NOT lk AND {number} >= 1 AND sm IN ('generic_image', 'auto')" if again else "false"
    image = f"fx AND NOT lk AND {number} >= 2 AND vm = 'video' AND sm = 'stock_video'" if again else "false"
    return f"""{name}_a AS (SELECT *, coalesce({asks}, false) AS fx FROM (SELECT *, kind <> 'blank' AND scene_idx > min(CASE WHEN kind <> 'blank' THEN scene_idx END) OVER (PARTITION BY plan_id, lower(asset)) AS dup FROM {before})),
{name}_b AS (SELECT plan_id, scene_idx, strict, af, lk, fx, asset, kind, CASE WHEN {video} THEN 'video' WHEN {image} THEN 'image' ELSE vm END AS vm, CASE WHEN {video} THEN 'stock_video' WHEN {image} THEN 'generic_image' ELSE sm END AS sm FROM {name}_a),
{name} AS (SELECT plan_id, scene_idx, strict, af, lk, vm, sm, CASE WHEN NOT fx THEN asset WHEN {found} THEN '{step}/' || ((scene_idx * 3 + {number + offset}) % 2) END AS asset,
  CASE WHEN NOT fx THEN kind WHEN {found} THEN CASE WHEN vm = 'video' THEN 'video' ELSE 'image' END ELSE 'blank' END AS kind FROM {name}_b)"""


FINAL = DESC + f""", r0 AS (SELECT plan_id, scene_idx, plan_id % 2 = 0 AS strict, plan_id % 3 = 0 AS af, lk, vm, sm,
  CASE WHEN plan_id % 2 = 0 AND scene_idx % 4 = 1 THEN NULL WHEN (plan_id + scene_idx) % 5 = 0 THEN 'Clip0' ELSE 'Clip' || scene_idx END AS asset,
  CASE WHEN plan_id % 2 = 0 AND scene_idx % 4 = 1 THEN 'blank' WHEN vm = 'video' THEN 'video' ELSE 'image' END AS kind FROM described),
{", ".join(_rung(f"r{i + 1}", f"r{i}", "dup AND NOT strict", "true", "anti_repeat", 3 + i, 4 + i) for i in range(3))},
m AS (SELECT plan_id, scene_idx, strict, af, lk, asset, kind, CASE WHEN moved THEN 'video' ELSE vm END AS vm, CASE WHEN moved THEN 'stock_video' ELSE sm END AS sm FROM (
  SELECT *, bool_or(strict AND af AND kind = 'blank') OVER (PARTITION BY plan_id) AND NOT (lk OR sm = 'historical_archive' OR (vm = 'meme' AND sm = 'meme_library')) AS moved FROM r3)),
{_rung("r4", "m", "strict AND af AND kind = 'blank'", "(plan_id + scene_idx) % 3 = 0", "video", 0, 0, False)},
{_rung("r5", "r4", "strict AND kind = 'blank'", "(plan_id + scene_idx) % 3 = 1", "cross_media", 2, 0)},
{_rung("r6", "r5", "strict AND kind = 'blank'", "plan_id % 5 > 0", "local", 0, 0, False)},
{_rung("r7", "r6", "dup AND strict", "plan_id % 7 > 0", "duplicates", 2, 0)},
{_rung("r8", "r7", "dup AND strict", "plan_id % 7 > 0", "duplicates", 3, 0)},
{_rung("r9", "r8", "dup", "true", "none", 0, 0, False)},
final AS (SELECT plan_id, scene_idx, strict, asset, kind AS asset_kind, vm AS visual_mode, sm AS source_mode, CASE WHEN kind = 'blank' THEN 'unresolved' WHEN fx THEN 'duplicate' END AS problem FROM r9_b)"""
sql("plans_finalized", FINAL, "SELECT * FROM final")
sql("plans_accepted", FINAL, """SELECT plan_id, bool_or(strict) AS strict, count(*) AS scenes, count(*) FILTER (problem = 'unresolved') AS unresolved, count(*) FILTER (problem = 'duplicate') AS duplicates,
  NOT bool_or(strict) OR count(problem) = 0 AS accepted FROM final GROUP BY 1""")


# --- choices in order: scene after scene, with what was taken before ---------------------

_SAME = "len(list_intersect(x.k, y.k))::DOUBLE / greatest(1, len(x.k) + len(y.k) - len(list_intersect(x.k, y.k)))"
IN_RUN = FOUND + "," + ranked("pool", False).split(",\npool_b AS")[0] + "," + GUARDS + "," + selected("pool_a", "x", 5).split(",\nx_s AS")[0] + f""",
opts AS (SELECT plan_id, list({{'c': cand_id, 'sc': score, 'q': query_idx, 'p': pos, 'v': kind = 'video', 'k': {toks('title')}, 't': lower(trim(title)), 'o': out_r IS NULL, 'g': gs}}) AS l FROM x_o GROUP BY 1),
run(p, i, held, titles, pick, checks) AS (SELECT p, -1, [-1::BIGINT], [{{'t': '', 'k': ['']}}], NULL::STRUCT(s DOUBLE, n BIGINT, c BIGINT, t VARCHAR, k VARCHAR[]), 0::BIGINT FROM (SELECT plan_id // 8 AS p FROM asking GROUP BY 1)
UNION ALL SELECT p, i + 1, CASE WHEN pick IS NULL THEN held ELSE list_append(held, pick.c) END,
  CASE WHEN pick IS NULL OR pick.t = '' OR len(list_filter(titles, lambda y: y.t = pick.t)) > 0 THEN titles ELSE list_append(titles, {{'t': pick.t, 'k': pick.k}}) END, pick, checks
FROM (SELECT p, i, held, titles, len(five) AS checks, list_sort(list_transform(five, lambda x, n: {{'s': -round(x.m + x.g * 0.035::DOUBLE, 9), 'n': n, 'c': x.c, 't': x.t, 'k': x.k}}))[1] AS pick
FROM (SELECT p, i, held, titles, list_sort(list_transform(list_filter(live, lambda x: x.o AND (x.v OR NOT (stock AND len(list_filter(live, lambda y: y.v)) > 0))),
  lambda x: {{'a': -x.m, 'q': x.q, 'p': x.p, 'm': x.m, 'c': x.c, 'g': x.g, 't': x.t, 'k': x.k}}))[1:5] AS five
FROM (SELECT p, i, held, titles, stock, list_transform(list_filter(judged, lambda x: lk OR x.s < 0.86), lambda x: {{'m': round(x.sc - 24.0::DOUBLE * x.s, 9), 'q': x.q, 'p': x.p, 'v': x.v, 'o': x.o, 'g': x.g, 'c': x.c, 't': x.t, 'k': x.k}}) AS live
FROM (SELECT r.p, r.i, r.held, r.titles, a.lk, a.vm = 'video' AND a.sm = 'stock_video' AS stock, list_transform(list_filter(coalesce(o.l, []), lambda x: NOT list_contains(r.held, x.c)),
  lambda x: {{'s': coalesce(list_max(list_transform(r.titles[-4:], lambda y: CASE WHEN y.t = '' OR len(x.k) = 0 OR len(y.k) = 0 THEN 0 ELSE {_SAME} END)), 0), 'sc': x.sc, 'q': x.q, 'p': x.p, 'v': x.v, 'o': x.o, 'g': x.g, 'c': x.c, 't': x.t, 'k': x.k}}) AS judged
FROM run r JOIN asking a ON r.i < 7 AND a.plan_id = r.p * 8 + r.i + 1 LEFT JOIN opts o ON o.plan_id = a.plan_id))))),
told AS (SELECT r.p AS plan_id, r.i AS scene_idx, a.lk, r.pick.c AS cand_id, -r.pick.s AS combined FROM run r JOIN asking a ON a.plan_id = r.p * 8 + r.i WHERE r.i >= 0)"""
sql("run_resolved", IN_RUN, """SELECT plan_id, CAST(scene_idx AS INT) AS scene_idx, CASE WHEN cand_id IS NOT NULL THEN 'downloaded' WHEN lk THEN 'not_found_locked' ELSE 'not_found_recovery' END AS status,
  CASE WHEN cand_id IS NOT NULL THEN 'exact' END AS level, cand_id, round(combined, 4) AS combined FROM told""")
# the same without titles: none of them has a word, so none is near another
sql("scenes_resolved", IN_RUN.replace(f"'k': {toks('title')}", "'k': []::VARCHAR[]"), """SELECT plan_id, CAST(scene_idx AS INT) AS scene_idx,
  CASE WHEN cand_id IS NOT NULL THEN 'downloaded' WHEN lk THEN 'not_found_locked' ELSE 'not_found_recovery' END AS status, CASE WHEN cand_id IS NOT NULL THEN 'exact' END AS level, cand_id FROM told""")
