"""SQL (DuckDB dialect) that states what each registered query must return.

Written against the raw driver tables and independent of the Spark operators:
running state is a recursive query here.
"""

from __future__ import annotations

from ..functions import rules as R, text as text_functions
from ..operators.sequence import VARIATIONS
from . import catalog as Q

ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(n)})" for n in needles) + ")"


def first(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(col, ns)} THEN {lit(label)}" for label, ns in rules) + f" ELSE {default} END"


def every(col: str, rules) -> str:
    """Labels of all rules that hit, joined in rule order."""
    parts = ", ".join(f"CASE WHEN {has(col, ns)} THEN {lit(label)} END" for label, ns in rules)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def join(lst: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({lst}, {lit(sep)}), '')"


def toks(col: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{M}}\\p{{N}}_-]+'), lambda t: length(t) > 1))"


def bounded(pattern: str) -> str:
    """RE2 pattern whose word limits also hold next to non-ASCII letters."""
    out = []
    for alt in pattern.split("|"):
        if alt.startswith("\\b"):
            alt = "(^|[^\\p{L}\\p{N}_])" + alt[2:]
        if alt.endswith("\\b"):
            alt = alt[:-2] + "([^\\p{L}\\p{N}_]|$)"
        out.append(alt)
    return "|".join(out)


WORDS = """
spoken AS (
  SELECT conv_id, turn, generate_subscripts(regexp_split_to_array(text, '[ \\n]+'), 1) AS pos, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w
  FROM conversations),
sized AS (
  SELECT conv_id, turn, pos, w, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS INT) AS idx,
    CAST(90 + 45 * least(length(w), 12) AS BIGINT) AS dur, CAST(40 + CASE WHEN regexp_matches(w, '[.!?]+$') THEN 260 ELSE 0 END AS BIGINT) AS gap
  FROM spoken WHERE w <> ''),
timed AS (
  SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM sized),
words AS (SELECT conv_id AS plan_id, CAST(turn AS INT) AS turn, idx, start_ms, start_ms + dur AS end_ms, w AS text FROM timed)"""
SCENES = WORDS + """,
scenes AS (
  SELECT w.plan_id, w.turn AS scene_idx, min(w.start_ms) AS start_ms, max(w.end_ms) AS end_ms, any_value(c.text) AS caption, any_value(c.role) AS role
  FROM words w JOIN conversations c ON c.conv_id = w.plan_id AND c.turn = w.turn GROUP BY 1, 2)"""
PLANTED = SCENES + """,
planted AS (
  SELECT * REPLACE (CASE WHEN p = '' THEN ' ' || caption ELSE p || ' ' || caption END AS caption) FROM
  (SELECT *, [""" + ", ".join(lit(p) for p in Q.PHRASES) + f"""][(plan_id + scene_idx) % {len(Q.PHRASES)} + 1] AS p FROM scenes))"""
CANDIDATES = """
candidates AS (
  SELECT doc_id AS cand_id, CASE CAST(substring(source,4) AS INT) % 4 WHEN 0 THEN 'commons' WHEN 1 THEN 'openverse' WHEN 2 THEN 'pexels' ELSE 'pixabay' END AS provider,
    CASE WHEN CAST(substring(source,4) AS INT) % 4 < 2 THEN 'image' ELSE 'video' END AS kind, regexp_extract(text, '^[^\\n]*') AS title, text AS description,
    concat('doc://', CAST(doc_id AS VARCHAR)) AS download_url, CAST(320 + (doc_id*37) % 1800 AS INT) AS width, CAST(320 + (doc_id*53) % 1800 AS INT) AS height,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'cc' END AS license, n_chars AS size, lang FROM documents)"""
SHOTS = """
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS scene_idx FROM events),
shots AS (
  SELECT user_id AS plan_id, scene_idx, CAST(scene_idx*1500 + (event_id % 7)*50 AS BIGINT) AS start_ms,
    CAST(scene_idx*1500 + (event_id % 7)*50 + 700 + (event_id % 5)*100 AS BIGINT) AS end_ms,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS asset,
    CASE WHEN event_type = 'error' THEN 'blank' WHEN event_type = 'view' THEN 'image' ELSE 'video' END AS asset_kind, event_id % 11 = 0 AS semantic_lock,
    CASE event_id % 5 WHEN 0 THEN 'neutral' WHEN 1 THEN 'tragic' WHEN 2 THEN 'funny' WHEN 3 THEN 'tense' ELSE 'positive' END AS tone
  FROM numbered)"""
JUDGE = """
judgements AS (
  SELECT doc_id AS cand_id, CAST((doc_id*17) % 101 AS INT) AS score, CAST((doc_id*29) % 101 AS INT) AS tone_match,
    CAST((doc_id*41) % 101 AS INT) AS quality_score, quality = 1 AS accept, toxic = 1 AS hard_flag,
    CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'close' ELSE 'context' END AS match_level FROM labels)"""
# Scenes of 1.7 s target: ch marks the scene of each word, short rests joined to the scene before.
CHUNKS = WORDS + """,
walk AS (
  SELECT plan_id, idx, start_ms AS first_ms, 0 AS ch, false AS closed FROM words WHERE idx = 0
  UNION ALL
  SELECT w.plan_id, w.idx, CASE WHEN cut THEN w.start_ms ELSE k.first_ms END, CASE WHEN cut THEN k.ch + 1 ELSE k.ch END, false
  FROM (SELECT k.*, (p.end_ms - k.first_ms >= 950) AND (p.end_ms - k.first_ms >= 2020 OR (p.end_ms - k.first_ms >= 1700 AND regexp_matches(p.text, '[.!?…]+$'))) AS cut
        FROM walk k JOIN words p USING (plan_id, idx)) k JOIN words w ON w.plan_id = k.plan_id AND w.idx = k.idx + 1),
raw_chunks AS (SELECT plan_id, ch, min(start_ms) AS s, arg_max(end_ms, idx) AS e FROM walk JOIN words USING (plan_id, idx) GROUP BY 1, 2),
last_chunk AS (SELECT plan_id, max(ch) AS top, arg_max(e - s, ch) AS len FROM raw_chunks GROUP BY 1),
placed AS (
  SELECT w.*, CASE WHEN k.ch = l.top AND l.top > 0 AND l.len * 100 < 950 * 68 THEN k.ch - 1 ELSE k.ch END AS scene
  FROM walk k JOIN words w USING (plan_id, idx) JOIN last_chunk l USING (plan_id))"""
CAPTIONS = CHUNKS + """,
captions AS (
  SELECT plan_id, CAST(scene AS INT) AS scene_idx, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms, count(*) AS n_words,
    trim(regexp_replace(string_agg(text, ' ' ORDER BY idx), '\\s+([,.!?;:…])', '\\1', 'g')) AS caption FROM placed GROUP BY 1, 2)"""


def sql(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = (f"WITH RECURSIVE {ctes.strip()}\n{body}" if ctes else body).strip()


def tone_case(col: str, rules) -> str:
    n = "regexp_matches({0}, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{3,}}([^\\p{{L}}\\p{{N}}_]|$)')".format(col)
    tragic = (
        f"({has(col, R.RU_LIFE_LOSS)} AND ({has(col, R.RU_LARGE_COUNT)} OR {n} OR {has(col, R.RU_LOSS_VERB)})) OR "
        f"({has(col, R.EN_LIFE_LOSS)} AND ({has(col, R.EN_MASS)} OR {has(col, R.EN_LOSS_VERB)}))"
    )
    return f"CASE WHEN {tragic} THEN 'tragic' WHEN {has(col, R.VIOLENT_ACTION)} THEN 'violent' WHEN {has(col, R.MILITARY_ACTION)} THEN 'tense' ELSE {first(col, rules, lit('neutral'))} END"


def role_case(col: str, casualty, battle, army, awaken, religious, belief, dream, reaction) -> str:
    return (
        f"CASE WHEN {has(col, casualty)} THEN 'aftermath' WHEN {has(col, battle)} THEN 'battle' WHEN {has(col, army)} THEN 'army' "
        f"WHEN {has(col, awaken)} THEN 'awakening' WHEN {has(col, religious)} AND {has(col, belief)} THEN 'revelation' "
        f"WHEN {has(col, dream)} AND {has(col, religious)} THEN 'revelation' WHEN {has(col, dream)} THEN 'vision' WHEN {has(col, reaction)} THEN 'reaction' ELSE '' END"
    )


DEFAULT_ROLES = (R.ROLE_CASUALTY, R.ROLE_BATTLE, R.ROLE_ARMY, R.ROLE_AWAKEN, R.ROLE_RELIGIOUS, R.ROLE_BELIEF, R.ROLE_DREAM, R.ROLE_REACTION)


def era_case(col: str, patterns, default: str, quote=True) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({col}, {lit(bounded(p))}) THEN {lit(v) if quote else v}" for v, p in patterns
    ) + f" ELSE {default} END"


def entities(col: str) -> str:
    hong = has(col, R.HONG)
    return (
        f"list_filter([CASE WHEN {hong} THEN 'Hong Xiuquan' END, CASE WHEN contains({col}, 'тайпин') THEN 'Taiping Rebellion' END, "
        f"CASE WHEN NOT {hong} AND contains({col}, 'экзам') AND {has(col, ('импер', 'чиновник', 'гос'))} THEN 'Imperial examination' END, "
        f"CASE WHEN {has(col, R.WORLD_WAR_ONE)} THEN 'World War I' END], lambda x: x IS NOT NULL)"
    )


def context(col: str) -> str:
    era = era_case(col, R.ERA_PATTERNS, "''")
    return (
        f"list_filter([CASE WHEN {has(col, R.CHINA)} THEN 'China' END, CASE WHEN {has(col, R.QING)} THEN 'Qing dynasty' END, "
        f"nullif(nullif({era}, ''), '21st century modern')], lambda x: x IS NOT NULL)"
    )


sql("words_valid", WORDS, """, broken AS (
  SELECT plan_id, idx, CASE WHEN idx % 17 = 5 THEN start_ms - 900 ELSE start_ms END AS s, CASE WHEN idx % 23 = 7 THEN CASE WHEN idx % 17 = 5 THEN start_ms - 900 ELSE start_ms END ELSE end_ms END AS e FROM words),
seen AS (SELECT *, coalesce(max(e) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM broken)
SELECT plan_id, idx, CASE WHEN s < 0 OR e <= s THEN 'invalid time range' ELSE 'timestamps are not monotonic' END AS fault FROM seen WHERE s < 0 OR e <= s OR s + 250 < m""")

sql("scenes_valid", SHOTS, """, b AS (
  SELECT plan_id, scene_idx AS i, start_ms AS s, CASE WHEN scene_idx % 13 = 4 THEN end_ms + 1200 WHEN scene_idx % 29 = 3 THEN start_ms ELSE end_ms END AS e,
    asset, CASE WHEN asset IS NULL AND scene_idx % 2 = 0 THEN 'image' ELSE asset_kind END AS kind, semantic_lock AS lk FROM shots),
n AS (SELECT *, lag(e) OVER (PARTITION BY plan_id ORDER BY i) AS pe FROM b)
SELECT plan_id, CAST(i AS INT) AS scene_idx, fault FROM (
  SELECT plan_id, i, 'invalid time range' AS fault FROM n WHERE s < 0 OR e <= s
  UNION ALL SELECT plan_id, i, 'overlaps previous scene' FROM n WHERE s < pe
  UNION ALL SELECT plan_id, i, 'asset kind requires asset' FROM n WHERE kind <> 'blank' AND asset IS NULL
  UNION ALL SELECT plan_id, i, 'invalid visual_mode' FROM n WHERE i % 9 = 0
  UNION ALL SELECT plan_id, i, 'invalid source_mode' FROM n WHERE i % 11 = 0
  UNION ALL SELECT plan_id, i, 'invalid motion_preset' FROM n WHERE i % 7 = 0
  UNION ALL SELECT plan_id, i, 'lock requires entities, context or fallback' FROM n WHERE lk AND i % 2 <> 0
  UNION ALL SELECT plan_id, i, 'focus_x must be between 0 and 1' FROM n WHERE i % 12 > 10)""")

sql("judge_gate", JUDGE, """, g AS (
  SELECT *, cand_id % 11 = 0 AS lk, cand_id % 5 = 1 AS dark, CASE match_level WHEN 'exact' THEN 45 WHEN 'close' THEN 34 ELSE 25 END AS flo,
    CASE match_level WHEN 'exact' THEN 29 WHEN 'close' THEN 23 ELSE 19 END AS cap FROM judgements),
h AS (SELECT *, NOT lk AND score < flo AS low, CASE WHEN NOT lk AND score < flo THEN least(score, cap) ELSE score END AS sc FROM g),
k AS (SELECT *, CASE WHEN low AND NOT hard_flag THEN 'semantic relevance below minimum' WHEN hard_flag THEN 'wrong war' ELSE 'none' END AS mm,
  CASE WHEN lk THEN accept AND sc >= 72 AND quality_score >= 45 WHEN match_level = 'exact' THEN accept AND sc >= 48 AND tone_match >= 42 AND quality_score >= 42
    WHEN match_level = 'close' THEN sc >= 40 AND tone_match >= 35 AND quality_score >= 40 ELSE sc >= 32 AND tone_match >= 30 AND quality_score >= 38 END AS acc FROM h)
SELECT cand_id, sc AS score, acc AS accept, mm AS mismatch, CASE WHEN low THEN 'Low semantic relevance (' || score || '/100).' ELSE '' END AS reason,
  quality_score < 28 OR sc < 30 OR (dark AND tone_match < 28) OR CASE WHEN lk THEN NOT acc OR sc < 70 ELSE mm = 'wrong war' END AS hard FROM k""")

sql("beats_sanitized", WORDS, """, t AS (SELECT plan_id, turn, min(idx) AS idx0, count(*) AS n FROM words GROUP BY 1, 2), l AS (SELECT plan_id, max(idx) AS last FROM words GROUP BY 1),
b AS (SELECT t.plan_id, turn, CASE WHEN turn % 7 = 3 THEN NULL WHEN turn % 7 = 5 THEN idx0 - 1000000 ELSE idx0 - idx0 % 40 END AS s, CASE WHEN turn % 5 = 2 THEN NULL ELSE idx0 + n * 3 END AS e, last FROM t JOIN l USING (plan_id)),
c AS (SELECT plan_id, turn, greatest(0, least(last, s)) AS s, least(last, coalesce(e, s)) AS e FROM b WHERE s IS NOT NULL)
SELECT plan_id, CAST(s AS INT) AS start_idx, turn AS reply_pos, CAST(greatest(s, e) AS INT) AS end_idx FROM c QUALIFY row_number() OVER (PARTITION BY plan_id, s ORDER BY turn) = 1""")

sql("roll_choices", "", """WITH c AS (SELECT user_id AS p, event_id % 7 AS s, event_id AS pos, CAST(floor(value) AS BIGINT) % 5 AS k, CAST(least(greatest(floor(value * 3 - 20), 0), 100) AS INT) AS fit, event_type AS reason FROM events),
known AS (SELECT DISTINCT user_id AS p, event_id % 5 AS s, event_id % 4 AS k FROM events),
ok AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM known n WHERE n.p = c.p AND n.s = c.s) AND (k = 0 OR EXISTS (SELECT 1 FROM known n WHERE n.p = c.p AND n.s = c.s AND n.k = c.k)))
SELECT p AS plan_id, CAST(s AS INT) AS scene_idx, CAST(k AS INT) AS candidate, fit, reason, pos AS reply_pos FROM ok QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY pos) = 1""")

sql("top_choices", "", """WITH c AS (SELECT user_id AS p, event_id % 3 AS s, event_id AS pos, CAST(floor(value) AS BIGINT) % 11 AS k, CAST(least(greatest(floor(value * 3 - 20), 0), 100) AS INT) AS fit FROM events),
known AS (SELECT DISTINCT user_id AS p, event_id % 3 AS s, event_id % 9 AS k FROM events),
f AS (SELECT c.* FROM c JOIN known USING (p, s, k) QUALIFY row_number() OVER (PARTITION BY p, s, k ORDER BY pos) = 1)
SELECT p AS plan_id, CAST(s AS INT) AS scene_idx, CAST(k AS INT) AS candidate, fit, CAST(row_number() OVER (PARTITION BY p, s ORDER BY pos) AS INT) AS place FROM f QUALIFY place <= 5""")

sql("queries_sanitized", "", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS q FROM documents),
c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(q, '\\s+', ' ', 'g'), '^[ ,.;:-]+', ''), '[ ,.;:-]+$', '') AS q FROM l),
k AS (SELECT * FROM c WHERE len(regexp_extract_all(q, '[A-Za-z0-9''-]+')) BETWEEN 2 AND 9 AND NOT regexp_matches(lower(q), '(^|[^\\p{L}\\p{N}_])(the|schen|eaux)([^\\p{L}\\p{N}_]|$)')),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, lower(q) ORDER BY pos) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS place, substring(q, 1, 140) AS query FROM f QUALIFY place <= 4""")

sql("durations_checked", SCENES, """, d AS (SELECT plan_id, scene_idx, end_ms - start_ms AS expected_ms, CASE WHEN scene_idx % 4 = 1 THEN 0 ELSE end_ms - start_ms + start_ms % 400 END AS actual_ms FROM scenes)
SELECT * FROM d WHERE actual_ms <= 0 OR abs(actual_ms - expected_ms) > 200""")

sql("reply_json", "", "SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN turn END AS reply_turn, CASE WHEN turn % 4 < 3 THEN role END AS reply_role FROM conversations")

sql("scene_chunks", CAPTIONS, "SELECT plan_id, scene_idx, start_ms, end_ms, CAST(n_words AS INT) AS n_words FROM captions")
sql("caption_text", CAPTIONS, "SELECT plan_id, scene_idx, caption FROM captions")
sql("tone_counts", CAPTIONS, f"SELECT plan_id, {tone_case('lower(caption)', Q.TONE_RULES)} AS tone, count(*) AS n FROM captions GROUP BY 1, 2")

sql("nearest_words", WORDS, """, t AS (SELECT plan_id, turn, min(idx) + 1 AS lo, max(idx) AS hi, min(start_ms) + sum(end_ms - start_ms + CASE WHEN regexp_matches(text, '[.!?]+$') THEN 300 ELSE 40 END) // 2 AS target FROM words GROUP BY 1, 2)
SELECT t.plan_id, t.turn AS ask_id, arg_min(idx, (abs(start_ms - target), idx)) AS idx FROM t LEFT JOIN words w ON w.plan_id = t.plan_id AND w.idx BETWEEN lo AND hi GROUP BY 1, 2""")

sql("asof_beat", "", """WITH c AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, epoch_ms(ts) AS ms, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2),
f AS (SELECT user_id, arg_min(view_id, ms) AS first_id FROM b GROUP BY 1)
SELECT c.user_id AS plan_id, c.event_id AS cut, coalesce(b.view_id, f.first_id) AS view_id FROM c ASOF LEFT JOIN b ON c.user_id = b.user_id AND c.ms >= b.ms LEFT JOIN f ON f.user_id = c.user_id""")

sql("cuts_normalized", WORDS, """, asked AS (SELECT plan_id, idx, start_ms FROM words WHERE idx = 0 OR regexp_matches(text, '[.!?]$')),
n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY idx) AS r FROM asked),
keep AS (SELECT plan_id, r, idx, start_ms AS last, true AS kept FROM n WHERE r = 1
  UNION ALL SELECT n.plan_id, n.r, n.idx, CASE WHEN n.start_ms - k.last >= 850 THEN n.start_ms ELSE k.last END, n.start_ms - k.last >= 850 FROM keep k JOIN n ON n.plan_id = k.plan_id AND n.r = k.r + 1),
ends AS (SELECT plan_id, max(idx) + 1 AS n_words, arg_max(end_ms, idx) AS plan_end FROM words GROUP BY 1),
gaps AS (SELECT k.plan_id, k.idx, coalesce(lead(k.idx) OVER o, n_words) AS until_idx, k.last AS s, coalesce(lead(k.last) OVER o, plan_end) AS e
  FROM keep k JOIN ends USING (plan_id) WHERE kept WINDOW o AS (PARTITION BY plan_id ORDER BY k.idx)),
chop AS (SELECT plan_id, idx, until_idx, s, e FROM gaps
  UNION ALL SELECT plan_id, pick, until_idx, ps, e FROM (
    SELECT c.plan_id, c.until_idx, c.e, arg_min(w.idx, (abs(2 * w.start_ms - (2 * c.s + least(4300, c.e - c.s))), w.idx)) AS pick, arg_min(w.start_ms, (abs(2 * w.start_ms - (2 * c.s + least(4300, c.e - c.s))), w.idx)) AS ps
    FROM chop c JOIN words w ON w.plan_id = c.plan_id AND w.idx > c.idx AND w.idx < c.until_idx WHERE c.e - c.s > 3500 GROUP BY c.plan_id, c.until_idx, c.e, c.idx))
SELECT DISTINCT plan_id, CAST(idx AS INT) AS cut_idx FROM chop""")

sql("word_containment", SCENES, """SELECT s.plan_id, s.scene_idx, CAST(count(*) AS INT) AS n_words, min(idx) AS first_idx FROM scenes s
JOIN words w ON w.plan_id = s.plan_id AND w.start_ms >= s.start_ms - 1 AND w.end_ms <= s.end_ms + 1 GROUP BY 1, 2""")

sql("timings_attached", SCENES, """, n AS (SELECT plan_id, turn, count(*) AS n FROM words GROUP BY 1, 2), m AS (SELECT plan_id, max(scene_idx) AS top FROM scenes GROUP BY 1)
SELECT s.plan_id, scene_idx, CASE WHEN s.plan_id % 9 = 4 AND top >= 1 THEN 'rejected' ELSE 'attached' END AS timing, CAST(CASE WHEN s.plan_id % 9 = 4 AND top >= 1 THEN 0 ELSE n END AS INT) AS n_words
FROM scenes s JOIN n ON n.plan_id = s.plan_id AND n.turn = s.scene_idx JOIN m ON m.plan_id = s.plan_id""")

RANGES = SHOTS + """,
ranges AS (SELECT *, CASE WHEN scene_idx = 0 THEN 0 ELSE start_ms END AS show_ms,
  greatest(CASE WHEN scene_idx = 0 THEN 0 ELSE start_ms END + 50, coalesce(lead(start_ms) OVER (PARTITION BY plan_id ORDER BY scene_idx), end_ms)) AS hide_ms FROM shots)"""
SPANS = RANGES + """,
runs AS (SELECT plan_id, scene_idx, scene_idx AS first_scene, asset, asset_kind, show_ms AS s, hide_ms AS e FROM ranges WHERE scene_idx = 0
  UNION ALL SELECT plan_id, i, CASE WHEN m THEN fs ELSE i END, CASE WHEN m THEN ca ELSE na END, CASE WHEN m THEN ck ELSE nk END, CASE WHEN m THEN cs ELSE ns END, ne FROM (
    SELECT r.plan_id, r.scene_idx AS i, u.first_scene AS fs, u.asset AS ca, r.asset AS na, u.asset_kind AS ck, r.asset_kind AS nk, u.s AS cs, r.show_ms AS ns, r.hide_ms AS ne,
      u.asset_kind = r.asset_kind AND (r.asset_kind = 'blank' OR coalesce(u.asset = r.asset, false)) AND abs(r.show_ms - u.e) <= 80 AND r.hide_ms - u.s <= 6000 AS m
    FROM runs u JOIN ranges r ON r.plan_id = u.plan_id AND r.scene_idx = u.scene_idx + 1)),
spans AS (SELECT plan_id, first_scene, arg_min(asset, scene_idx) AS asset, any_value(asset_kind) AS asset_kind, min(s) AS show_ms, max(e) AS hide_ms, count(*) AS scenes FROM runs GROUP BY 1, 2)"""
sql("display_ranges", RANGES, "SELECT plan_id, scene_idx, CAST(show_ms AS BIGINT) AS show_ms, CAST(hide_ms AS BIGINT) AS hide_ms FROM ranges")
sql("visual_spans", SPANS, "SELECT plan_id, first_scene, any_value(asset) AS asset, any_value(asset_kind) AS asset_kind, CAST(any_value(show_ms) AS BIGINT) AS show_ms, CAST(any_value(hide_ms) AS BIGINT) AS hide_ms, any_value(scenes) AS scenes FROM spans GROUP BY 1, 2")

sql("repetition_runs", RANGES, """, k AS (SELECT *, CASE WHEN asset_kind <> 'blank' THEN asset END AS key, hide_ms - show_ms AS d FROM ranges),
l AS (SELECT *, lag(key, 1) OVER o AS k1, lag(key, 2) OVER o AS k2, lag(key, 3) OVER o AS k3 FROM k WINDOW o AS (PARTITION BY plan_id ORDER BY scene_idx)),
g AS (SELECT *, sum(CASE WHEN key IS NOT NULL AND key = k1 THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY scene_idx) AS run FROM l),
t AS (SELECT *, sum(d) OVER (PARTITION BY plan_id, run ORDER BY scene_idx) AS total, row_number() OVER (PARTITION BY plan_id, run ORDER BY scene_idx) AS r FROM g),
f AS (SELECT plan_id, scene_idx, r > 1 AND total > 2600 * CASE WHEN semantic_lock THEN 1.35 ELSE 1.0 END AS lng, key IS NOT NULL AND NOT semantic_lock AND (coalesce(k2 = key, false) OR coalesce(k3 = key, false)) AS ret FROM t)
SELECT plan_id, scene_idx, CASE WHEN lng THEN 'run' ELSE 'return' END AS rule FROM f WHERE lng OR ret""")

EDGE = """regexp_replace(regexp_replace({0}, '^[ \\\\trn,.;:!?—–()\\[\\]«»"''-]+', ''), '[ \\\\trn,.;:!?—–()\\[\\]«»"''-]+$', '')"""
CARDS = """
walkc AS (
  SELECT plan_id, scene_idx, i, 1 AS page, false AS pairs FROM tok WHERE i = 1
  UNION ALL
  SELECT t.plan_id, t.scene_idx, t.i, CASE WHEN joined THEN k.page ELSE k.page + 1 END, joined
  FROM (SELECT k.*, NOT k.pairs AND coalesce(n.i IS NOT NULL AND NOT a.brk AND PAUSE AND (a.len <= 3 OR n.len <= 3), false) AS joined
    FROM walkc k JOIN tok a USING (plan_id, scene_idx, i) LEFT JOIN tok n ON n.plan_id = k.plan_id AND n.scene_idx = k.scene_idx AND n.i = k.i + 1) k
  JOIN tok t ON t.plan_id = k.plan_id AND t.scene_idx = k.scene_idx AND t.i = k.i + 1)"""
TOK = SCENES + """,
tok AS (SELECT w.plan_id, w.turn AS scene_idx, CAST(row_number() OVER (PARTITION BY w.plan_id, w.turn ORDER BY idx) AS INT) AS i, translate(w.text, '{}', '()') AS t, w.start_ms AS ws, w.end_ms AS we,
  s.start_ms AS ss, s.end_ms AS se, regexp_matches(w.text, '[,;:.!?]$') AS brk, length(""" + EDGE.format("w.text") + """) AS len
  FROM words w JOIN scenes s ON s.plan_id = w.plan_id AND s.scene_idx = w.turn)"""
sql("caption_pages", TOK + "," + CARDS.replace("PAUSE", "n.ws - a.we <= 180"), """, c AS (SELECT k.page, t.*, lead(ws) OVER (PARTITION BY t.plan_id, t.scene_idx ORDER BY t.i) AS nx FROM walkc k JOIN tok t USING (plan_id, scene_idx, i))
SELECT plan_id, scene_idx, CAST(page - 1 AS INT) AS page, greatest(any_value(ss), arg_min(ws, i)) AS start_ms, least(any_value(se), arg_max(we, i), coalesce(arg_max(coalesce(nx, we), i), arg_max(we, i))) AS end_ms, string_agg(t, ' ' ORDER BY i) AS text FROM c GROUP BY 1, 2, 3""")
sql("caption_pages_weighted", TOK + "," + CARDS.replace("PAUSE", "true"), """, g AS (SELECT k.page, plan_id, scene_idx, any_value(ss) AS ss, any_value(se) AS se, sum(greatest(2, len)) AS w, string_agg(t, ' ' ORDER BY i) AS text FROM walkc k JOIN tok t USING (plan_id, scene_idx, i) GROUP BY 1, 2, 3),
h AS (SELECT *, sum(w) OVER (PARTITION BY plan_id, scene_idx) AS tot, sum(w) OVER (PARTITION BY plan_id, scene_idx ORDER BY page) AS cum, max(page) OVER (PARTITION BY plan_id, scene_idx) AS top, greatest(60, se - ss) AS span FROM g),
r AS (SELECT *, CASE WHEN page = 1 THEN ss ELSE least(se, ss + CAST(floor(span * CAST(cum - w AS DOUBLE) / CAST(tot AS DOUBLE) + 0.5) AS BIGINT)) END AS s0, CASE WHEN page = top THEN se ELSE least(se, ss + CAST(floor(span * CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) + 0.5) AS BIGINT)) END AS e0 FROM h)
SELECT plan_id, scene_idx, CAST(page - 1 AS INT) AS page, s0 AS start_ms, greatest(s0 + 50, e0) AS end_ms, text FROM r""")

sql("neighbor_queries", SCENES, """, q AS (SELECT plan_id, scene_idx, list_slice(list_sort(list_filter(list_distinct(list_transform(""" + toks("caption") + """, lambda t: substring(t, 1, 2))), lambda t: length(t) > 1)), 1, 5) AS qs FROM scenes),
s AS (SELECT *, coalesce(qs[1], 'none') AS q0 FROM q),
f AS (SELECT plan_id, scene_idx, q0 AS query, qs AS queries, [q0] AS mem FROM s WHERE scene_idx = 0
  UNION ALL SELECT plan_id, i, CASE WHEN mv THEN alt[1] ELSE q0 END, CASE WHEN mv THEN list_concat(alt, list_filter(qs, lambda x: NOT list_contains(alt, x))) ELSE qs END,
    list_slice(list_append(mem, CASE WHEN mv THEN alt[1] ELSE q0 END), -4, -1) FROM (
    SELECT s.plan_id, s.scene_idx AS i, s.q0, s.qs, f.mem, list_filter(s.qs, lambda x: NOT list_contains(f.mem, x)) AS alt, list_contains(f.mem, s.q0) AND len(list_filter(s.qs, lambda x: NOT list_contains(f.mem, x))) > 0 AS mv
    FROM f JOIN s ON s.plan_id = f.plan_id AND s.scene_idx = f.scene_idx + 1))
SELECT plan_id, scene_idx, query, """ + join("queries") + """ AS queries FROM f""")

VARY = "CASE role " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in VARIATIONS.items()) + " ELSE '' END"
sql("sequence_variation", PLANTED, f""", s AS (SELECT plan_id, scene_idx, 'shot of ' || ['people', 'soldiers', 'city'][(scene_idx // 2) % 3 + 1] AS q, scene_idx % 7 = 6 AS lk, {role_case('lower(caption)', *DEFAULT_ROLES)} AS role FROM planted),
d AS (SELECT *, {VARY} AS v FROM s),
f AS (SELECT plan_id, scene_idx, q AS query, q AS queries, false AS varied, lk FROM d WHERE scene_idx = 0
  UNION ALL SELECT d.plan_id, d.scene_idx, CASE WHEN NOT d.lk AND NOT f.lk AND d.q = f.query AND d.v <> '' THEN d.v ELSE d.q END, CASE WHEN NOT d.lk AND NOT f.lk AND d.q = f.query AND d.v <> '' THEN d.v || '|' || d.q ELSE d.q END,
    NOT d.lk AND NOT f.lk AND d.q = f.query AND d.v <> '', d.lk FROM f JOIN d ON d.plan_id = f.plan_id AND d.scene_idx = f.scene_idx + 1)
SELECT plan_id, scene_idx, query, queries, varied FROM f""")

sql("plan_mood", SCENES, f"SELECT plan_id, {first('all_text', Q.MOOD_RULES, lit('neutral'))} AS mood FROM (SELECT plan_id, lower(string_agg(caption, ' ' ORDER BY scene_idx)) AS all_text FROM scenes GROUP BY 1)")
sql("beat_roles", SCENES, f"SELECT plan_id, scene_idx, {role_case('lower(caption)', *Q.ROLES.values())} AS role FROM scenes")
sql("visual_intent", SCENES, f""", m AS (SELECT *, lower(caption) AS t, CASE WHEN {has('lower(caption)', Q.MEME)} THEN 'meme' WHEN {has('lower(caption)', Q.VIDEO)} THEN 'video' WHEN scene_idx > 0 AND scene_idx % 4 = 3 AND end_ms - start_ms >= 1400 THEN 'video' ELSE 'image' END AS mode FROM scenes)
SELECT plan_id, scene_idx, mode, CASE WHEN mode = 'meme' THEN 'meme_library' WHEN plan_id % 2 = 0 AND {has('t', Q.HISTORY)} THEN 'historical_archive' WHEN mode = 'video' THEN 'stock_video' ELSE 'generic_image' END AS source,
  CASE WHEN mode = 'meme' THEN 'none' WHEN {has('t', Q.PULLBACK)} THEN 'pull_back' WHEN {has('t', Q.DRAMATIC)} THEN 'dramatic_push' WHEN scene_idx % 5 = 2 THEN 'reveal_right' WHEN scene_idx % 5 = 4 THEN 'reveal_left' WHEN mode = 'image' THEN 'slow_push' ELSE 'micro_push' END AS motion FROM m""")

sql("caption_facts", PLANTED, f""", t AS (SELECT plan_id, scene_idx, lower(caption) AS t FROM planted),
e AS (SELECT *, {entities('t')} AS ent, {context('t')} AS ctx, {era_case('t', R.ERA_PATTERNS, "''")} AS era FROM t)
SELECT plan_id, scene_idx, {tone_case('t', R.TONE_RULES)} AS tone, {join('ent')} AS entities, CASE WHEN len(ent) > 0 THEN {join('ctx')} ELSE '' END AS context,
  CASE WHEN len(ent) > 0 THEN array_to_string(list_concat(ent, ctx, ['archival illustration']), ' ') END AS fallback, len(ent) > 0 AS locked, era, {era_case('t', R.CENTURY_PATTERNS, 'NULL', False)} AS century,
  {join(every('t', R.HINT_RULES))} AS hints, {has('t', R.HISTORY_STEMS)} OR len(ent) > 0 AS historical, {has('t', R.CHRISTIAN)} AS christian, {has('t', R.ARMY_ACTION)} AS army, {has('t', R.TAIPING_STORY)} AS story,
  {join(every('t', R.EVENT_NAMES))} AS events, {join(every('t', R.COUNTRY_NAMES))} AS countries, {role_case('t', *DEFAULT_ROLES)} AS role FROM e""")

sql("reactions", PLANTED, f""", t AS (SELECT plan_id, scene_idx, lower(caption) || ' ' AS t, lower(caption) AS c FROM planted),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(c, '[^a-z0-9]+', '_', 'g'), '^_+', ''), '_+$', '') AS slug FROM t)
SELECT plan_id, scene_idx, CASE {' '.join(f"WHEN {has('t', ns)} THEN {w}" for w, ns, _ in R.REACTION_RULES)} ELSE 0 END AS strength,
  CASE {' '.join(f"WHEN {has('t', ns)} THEN {lit(p)}" for _, ns, p in R.REACTION_RULES)} ELSE '' END AS prompt, {first('c', R.REACTION_FAMILIES, "CASE WHEN slug = '' THEN 'reaction' ELSE substring(slug, 1, 40) END")} AS family FROM s""")

COUNTRY_SQL = ", ".join(f"CASE WHEN {has('t', ns)} THEN {lit(label)} END" for label, ns in R.COUNTRY_RULES)
sql("story_context", PLANTED, f""", t AS (SELECT plan_id, lower(string_agg(caption, ' ' ORDER BY scene_idx)) AS t FROM planted GROUP BY 1),
e AS (SELECT *, nullif({era_case('t', R.ERA_PATTERNS, "''")}, '') AS era FROM t),
l AS (SELECT *, {has('t', R.TAIPING_STORY)} AS story, list_filter([{COUNTRY_SQL}, era, CASE WHEN era IS NOT NULL OR {has('t', R.HISTORY_STEMS)} THEN 'historical archival' END], lambda x: x IS NOT NULL) AS p FROM e)
SELECT plan_id, {join("list_filter(list_concat(p, [CASE WHEN list_contains(p, 'China Chinese') AND era = '19th century' THEN 'Qing dynasty' END, CASE WHEN list_contains(p, 'Taiping Rebellion') THEN '1850s China' END]), lambda x: x IS NOT NULL)", ' ')} AS global_context,
  {join(f"list_filter([CASE WHEN story THEN '19th-century China, Taiping Rebellion era' END, CASE WHEN NOT story AND {has('t', ('китай', 'china', 'chinese'))} THEN 'China' END, CASE WHEN {has('t', R.QING)} THEN 'Qing dynasty' END], lambda x: x IS NOT NULL)", ', ')} AS soft_context, story AS taiping FROM l""")

sql("metadata_conflicts", PLANTED, f""", p AS (SELECT plan_id, scene_idx, lower(caption) AS t FROM planted),
j AS (SELECT a.plan_id, a.scene_idx, {every('a.t', R.EVENT_NAMES)} AS e1, {every('b.t', R.EVENT_NAMES)} AS e2, {every('a.t', R.COUNTRY_NAMES)} AS c1, {every('b.t', R.COUNTRY_NAMES)} AS c2,
  {era_case('a.t', R.CENTURY_PATTERNS, 'NULL', False)} AS n1, {era_case('b.t', R.CENTURY_PATTERNS, 'NULL', False)} AS n2 FROM p a JOIN p b ON b.plan_id = a.plan_id AND b.scene_idx = a.scene_idx + 1)
SELECT plan_id, scene_idx, CASE WHEN scene_idx % 2 = 0 THEN CASE WHEN len(e1) > 0 AND len(e2) > 0 AND NOT list_has_any(e1, e2) THEN 'wrong event/war in candidate metadata'
  WHEN len(c1) > 0 AND len(c2) > 0 AND NOT list_has_any(c1, c2) THEN 'wrong country in candidate metadata' WHEN n1 <> n2 THEN 'wrong century in candidate metadata' END END AS conflict FROM j""")

ERAS = dict(R.ERA_PATTERNS)
sql("context_kept", PLANTED, f""", t AS (SELECT plan_id, scene_idx, lower(caption) AS t, {toks('caption')} AS k FROM planted)
SELECT plan_id, scene_idx, {join(f"list_filter([CASE WHEN {has('t', R.CHINA)} THEN 'China' END, CASE WHEN {has('t', ('цин', 'qing'))} THEN 'Qing dynasty' END, CASE WHEN regexp_matches(t, {lit(bounded(ERAS['19th century']))}) THEN '19th century' END, CASE WHEN regexp_matches(t, {lit(bounded(ERAS['20th century']))}) THEN '20th century' END, CASE WHEN regexp_matches(t, {lit(bounded(ERAS['21st century modern']))}) THEN '21st century modern' END, CASE WHEN list_has_all(k, ['first', 'soldiers']) THEN 'first soldiers' END, CASE WHEN list_contains(k, 'war') THEN 'war' END], lambda x: x IS NOT NULL)")} AS kept FROM t""")

T = text_functions


def english(col: str) -> str:
    stop = ", ".join(lit(w) for w in T.GENERIC_ENGLISH)
    return f"list_distinct(list_filter(regexp_extract_all(lower({col}), '[a-z][a-z-]{{2,}}'), lambda t: NOT list_contains([{stop}], t)))"


BASE = "stressed student exam the that this erst documentary scene inge"
sql("query_intent", "", f"""WITH l AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
k AS (SELECT doc_id, lower(line) AS t, {english('line')} AS own, {every('lower(line)', R.QUERY_TAGS)} AS tags, {every(lit(BASE), R.QUERY_TAGS)} AS bt, {english(lit(BASE))} AS bo FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (list_has_any(bt, tags) OR len(list_intersect(bo, own)) >= 2 OR (len(list_intersect(bo, own)) = 1 AND len(own) <= 7) OR len(bt) = 0) AS on_subject,
  count(*) FILTER ({has('t', R.ACTION_VERBS)}) AS actions, CAST(sum(len(tags)) AS BIGINT) AS tags FROM k GROUP BY 1""")

sql("bad_titles", CANDIDATES, f""", h AS (SELECT cand_id, lower(CASE WHEN cand_id % 3 = 0 THEN 'title ' || ['Signboard', 'Map of a sign, Logo', 'watermarked', 'SCREEN SHOT', 'my-poster'][cand_id % 5 + 1] ELSE title END || ' ' || description) AS h FROM candidates)
SELECT cand_id, CASE {' '.join(f"WHEN regexp_matches(h, {lit('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_])' + t + '([^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_]|$)')}) THEN {lit(t)}" for t in R.BAD_TITLE_TERMS)} END AS term FROM h""")

tone_in = lambda c, names: f"{c} IN (" + ", ".join(lit(n) for n in names) + ")"
sql("scene_compatibility", SHOTS, f"""SELECT a.plan_id, a.scene_idx, CASE WHEN {tone_in('a.tone', R.DARK_TONES)} THEN {tone_in('b.tone', (*R.DARK_TONES, 'emotional', 'mysterious', 'neutral'))} WHEN {tone_in('a.tone', R.LIGHT_TONES)} THEN {tone_in('b.tone', (*R.LIGHT_TONES, 'neutral', 'emotional'))} ELSE true END AS tone_ok,
  (NOT a.semantic_lock OR (b.semantic_lock AND a.asset_kind = b.asset_kind)) AND (a.scene_idx % 3 <> 0 OR (b.scene_idx % 3 = 0 AND a.tone = b.tone)) AS lock_ok, a.scene_idx % 3 <> 0 OR contains(b.asset_kind || ' ' || b.tone, a.tone) AS context_ok
FROM shots a JOIN shots b ON b.plan_id = a.plan_id AND b.scene_idx = a.scene_idx + 1""")

sql("sources_allowed", CANDIDATES, """, m AS (SELECT *, ['historical_archive', 'stock_video', 'meme_library', 'generic_image', 'auto'][cand_id % 5 + 1] AS mode, provider IN ('commons', 'openverse') AND kind = 'image' AS arch FROM candidates)
SELECT mode, provider, kind, count(*) AS n, count(*) FILTER (CASE WHEN cand_id % 7 = 0 OR mode = 'historical_archive' THEN arch WHEN mode = 'stock_video' THEN (kind = 'video' AND provider IN ('pexels', 'pixabay')) OR kind = 'image' WHEN mode = 'meme_library' THEN false WHEN mode = 'generic_image' THEN kind = 'image' ELSE true END) AS allowed FROM m GROUP BY 1, 2, 3""")

sql("transcript_records", WORDS, """SELECT plan_id, round(arg_max(end_ms, idx) / 1000.0::DOUBLE, 3) AS duration, string_agg(text, ' ' ORDER BY idx) AS text, CAST(count(*) AS INT) AS words,
  round(arg_min(start_ms, idx) / 1000.0::DOUBLE, 3) AS first_start, arg_max(text, idx) AS last_word FROM words GROUP BY 1""")


def clock(ms: str) -> str:
    cs = f"(greatest({ms}, 0) // 10 + CASE WHEN greatest({ms}, 0) % 10 > 5 OR greatest({ms}, 0) % 10 = 5 AND greatest({ms}, 0) // 10 % 2 = 1 THEN 1 ELSE 0 END)"
    return f"({cs} // 360000) || ':' || lpad(CAST({cs} % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({cs} % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST({cs} % 100 AS VARCHAR), 2, '0')"


ORACLE["subtitle_lines"] = f"""SELECT plan_id, start_ms, scene_idx, CAST(page AS BIGINT) AS page,
  'Dialogue: 0,' || {clock('start_ms')} || ',' || {clock('end_ms')} || ',Default,,0,0,0,,{{\\\\fad(8,12)}}' || translate(text, '{{}}', '()') AS line FROM ({ORACLE['caption_pages']})"""
