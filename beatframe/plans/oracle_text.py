"""SQL counterparts: text, media, payloads, quality."""

from __future__ import annotations

from ..functions import text as T
from ..functions.rules import BAD_TITLE_TERMS
from . import catalog as Q
from .oracle import CANDIDATES, PLANTED, SCENES, SHOTS, WORDS, english, every, has, join, lit, sql, toks  # noqa: F401

WS = "regexp_split_to_array({0}, '\\s+')"
WORD_END = "([^\\p{L}\\p{M}\\p{N}_]|$)"


def alt(pattern: str) -> str:
    """Alternation as whole words, the match kept apart from its surroundings."""
    return f"(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({pattern})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)"


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def edges(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^[ ,.;:-]+', ''), '[ ,.;:-]+$', '')"


def ordered(lst: str) -> str:
    """First occurrences of a list, order kept."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


stop = "[" + ", ".join(lit(w) for w in T.STOPWORDS) + "]"
sql("keywords", "", f"""WITH w AS (SELECT doc_id, list_filter(list_transform({WS.format('text')}, lambda w: lower(regexp_replace(regexp_replace(regexp_replace(w, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]+', '', 'g'), '^[_-]+', ''), '[_-]+$', ''))), lambda t: length(t) >= 2 AND NOT list_contains({stop}, t)) AS k FROM documents),
u AS (SELECT doc_id, unnest(k) AS t, generate_subscripts(k, 1) AS i FROM w), f AS (SELECT doc_id, t, min(i) AS i FROM u GROUP BY 1, 2),
r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8)
SELECT d.doc_id, coalesce(string_agg(r.t, '|' ORDER BY r.i), '') AS keywords FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1""")

sig = "[" + ", ".join(lit(w) for w in T.SIGNATURE_STOP) + "]"
sql("token_stats", "", f"""SELECT doc_id, CAST(len({toks('text')}) AS INT) AS tokens, CAST(len(regexp_extract_all(lower(text), '[a-zа-яё0-9]+')) AS INT) AS fx, CAST(len({english('text')}) AS INT) AS english,
coalesce(array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-zа-яё][a-zа-яё-]{{2,}}'), lambda t: NOT list_contains({sig}, t)), 1, 4), ' '), '') AS signature FROM documents""")

BOIL = T.ACTION_BOILERPLATE
wrap = lambda pat, c: f"regexp_replace({c}, {lit('(?i)' + alt(pat))}, '\\1 \\3', 'g')"
sql("cleaned_queries", "", f"""WITH t AS (SELECT doc_id, ' -- Stock  Footage, b roll of ' || text || ' engraving in Qing China, 1800s. ' AS t FROM documents)
SELECT doc_id, substring({squash(wrap(BOIL, wrap(BOIL, edges('t'))))}, 1, 120) AS action, substring({edges('t')}, 1, 160) AS beat, substring({squash("regexp_replace(t, '[^a-zA-Z0-9 ''-]', ' ', 'g')")}, 1, 100) AS overlay,
  md5(coalesce(nullif({edges(wrap(T.STILL_BOILERPLATE, wrap(T.STILL_BOILERPLATE, 't')))}, ''), 'real human action')) AS subject, md5({edges(wrap(T.PERIOD_PHRASES, wrap(T.PERIOD_PHRASES, 't')))}) AS freed FROM t""")

sql("merged_queries", "", f"""WITH p AS (SELECT doc_id, list_concat(string_split(text, chr(10)), list_transform(string_split(text, chr(10)), lambda x: lower(x)), regexp_split_to_array(text, '[.!?]')) AS l FROM documents),
u AS (SELECT doc_id, {squash('unnest(l)')} AS q, generate_subscripts(l, 1) AS i FROM p),
f AS (SELECT doc_id, q, i FROM u WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(q) ORDER BY i) = 1)
SELECT d.doc_id, CAST(count(q) AS INT) AS n, md5(coalesce(string_agg(q, '|' ORDER BY i), '')) AS digest FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""")

NUM = r"(^|[^\p{L}\p{M}\p{N}_])(\d+(?:[.,]\d+)?)([^\p{L}\p{M}\p{N}_]|$)"
sql("quantities", "", f"SELECT doc_id, regexp_extract(text, {lit(NUM)}, 2) AS quantity FROM documents WHERE regexp_matches(text, {lit(NUM)})")
QTY = r"(?i)(^|[^\p{L}\p{M}\p{N}_])(" + T.QUANTITY.replace(r"\b", "") + r")([^\p{L}\p{M}\p{N}_]|$)"
sql("spoken_quantities", PLANTED, f"SELECT plan_id, scene_idx, {squash(f'regexp_extract(caption, {lit(QTY)}, 2)')} AS quantity FROM planted WHERE regexp_matches(caption, {lit(QTY)})")

fx = lambda c: f"regexp_extract_all(lower({c}), '[a-zа-яё0-9]+')"
sql("caption_queries", PLANTED, f""", w AS (SELECT *, list_filter({WS.format('caption')}, lambda x: x <> '') AS ws FROM planted), s AS (SELECT *, array_to_string(list_slice(ws, 1, 3), ' ') AS st,
  array_to_string(list_slice(list_filter(list_transform(ws, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]+', '', 'g')), lambda x: length(x) >= 4), 1, 4), ' ') AS b FROM w)
SELECT plan_id, scene_idx, coalesce(nullif(b, ''), 'human reaction') || CASE WHEN scene_idx % 2 = 0 THEN ' real footage' ELSE ' documentary image' END AS fallback, CASE WHEN length(st) BETWEEN 1 AND 22 THEN upper(replace(st, 'ß', 'ss')) ELSE '' END AS label,
  len({fx('st')}) > 0 AS spoken, list_contains({fx('caption')}, 'иисуса') AS name_spoken FROM s""")

sql("anchor_starts", WORDS, f""", t AS (SELECT plan_id, turn, idx, start_ms, coalesce({fx('text')}[1], '') AS h, row_number() OVER (PARTITION BY plan_id, turn ORDER BY idx DESC) AS back, {fx('text')} AS all_t FROM words),
a AS (SELECT plan_id, turn, flatten(list(all_t ORDER BY idx) FILTER (back <= 2)) AS want, list(h ORDER BY idx) AS heads, list(start_ms ORDER BY idx) AS ts FROM t GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT *, list_filter(range(1, len(heads) - len(want) + 2), lambda i: heads[i:i + len(want) - 1] = want)[1] AS e, list_filter(range(1, len(heads) + 1), lambda i: len(list_filter(want, lambda w: length(w) > 3 AND (contains(heads[i], w) OR contains(w, heads[i])))) > 0)[1] AS o FROM a)
SELECT plan_id, turn AS scene_idx, CASE WHEN len(want) > 0 THEN ts[coalesce(e, o)] END AS at_ms FROM m""")

sql("judge_intents", SCENES, "SELECT plan_id, scene_idx, CASE WHEN scene_idx % 3 = 0 THEN role || ' shot. Soft historical setting: old town, 1850. Wide view -' ELSE role || ' shot Wide view' END AS intent FROM scenes")

jac = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END"
sql("title_jaccard", "", f"""WITH t AS (SELECT doc_id, source, {toks("regexp_extract(text, '^[^\n]*')")} AS k FROM documents),
l AS (SELECT *, lag(k, 1) OVER o AS k1, lag(k, 2) OVER o AS k2, lag(k, 3) OVER o AS k3, lag(k, 4) OVER o AS k4 FROM t WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
s AS (SELECT doc_id, greatest({', '.join(f"coalesce({jac('k', f'k{n}')}, 0)" for n in (1, 2, 3, 4))}) AS s FROM l)
SELECT doc_id, round(CAST(s AS DOUBLE), 6) AS similarity, round(CAST(s * 24.0 AS DOUBLE), 6) AS penalty FROM s""")

ent = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    ent = f"replace({ent}, {lit(name)}, {lit(char)})"
sql("clean_html", "", f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace({ent}, '^[\\s ]+', ''), '[\\s ]+$', '') AS t FROM pages)
SELECT page_id, md5(t) AS digest, CAST(length(t) AS INT) AS n FROM c""")

sql("media_values", "", """WITH e AS (SELECT *, value AS x, ['.JPG', '.webm', '', '.ogg', '.png'][event_id % 5 + 1] AS ext, event_id % 2 = 0 AS img, ['none', 'reveal_left', 'pull_back'][event_id % 3 + 1] AS pre,
  ['slow_push', 'pull_back', 'reveal_left', 'reveal_right', 'none'][event_id % 5 + 1] AS mot, CAST(round_even(greatest(floor(value * 1234), 0) / 10, 0) AS BIGINT) AS cs, least(greatest(round_even(value / 5.5, 0), 2), 8) AS fx FROM events),
p AS (SELECT *, CASE WHEN pre <> 'none' THEN pre ELSE mot END AS rp FROM e)
SELECT event_id, round(pow(10.0, -x / 20.0), 6) AS gain, greatest(0, CAST(round_even((x - 5) * 1000, 0) AS BIGINT)) AS delay,
  printf('%d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) AS ass, CAST(least(greatest(round_even(x / 2.15, 0), 5), 18) AS INT) AS beats, CAST(fx AS INT) AS effects,
  CAST(least(fx, greatest(2, round_even(x / 7.0, 0))) AS INT) AS wanted,
  CASE WHEN img THEN CASE WHEN ext IN ('.JPG', '.png') THEN lower(ext) ELSE '.jpg' END ELSE CASE WHEN ext IN ('.webm', '.ogg') THEN ext ELSE '.mp4' END END AS suffix,
  CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS mime_kind, CASE event_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video' END AS ext_kind,
  CASE WHEN rp NOT IN ('reveal_left', 'reveal_right') THEN rp WHEN x % 1 BETWEEN 0.40 AND 0.60 THEN 'slow_push' WHEN x % 1 < 0.40 THEN 'reveal_left' ELSE 'reveal_right' END AS composition,
  CASE WHEN event_id % 4 = 0 THEN 1.75 ELSE least(greatest(x, 1.35), 20.0) END AS bounded FROM p""")

PX = "list_concat(" + ", ".join(f"list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * {100 + 9 * k}) AS INT))" for k in range(4)) + ")"
sql("picture_hashes", "", f"""WITH p AS (SELECT vec_id, {PX} AS px FROM embeddings), b AS (SELECT vec_id, px, list_transform(px, lambda v: CASE WHEN v * 256 >= list_sum(px) THEN 1 ELSE 0 END) AS h,
  list_transform(px, lambda v: CASE WHEN (255 - v) * 256 >= 255 * 256 - list_sum(px) THEN 1 ELSE 0 END) AS i FROM p)
SELECT vec_id, CAST(list_sum(h[1:64]) AS INT) AS bits0, CAST(list_sum(h[65:128]) AS INT) AS bits1, CAST(list_sum(h[129:192]) AS INT) AS bits2, CAST(list_sum(h[193:256]) AS INT) AS bits3,
  round(1.0::DOUBLE - list_sum(list_transform(h, lambda v, k: abs(v - i[k]))) / 256.0::DOUBLE, 6) AS similarity FROM b""")

sql("focus_points", "", """WITH g AS (SELECT vec_id, list_transform(list_slice(list_concat(embedding, embedding, embedding), 1, 144), lambda x: CASE WHEN vec_id % 50 = 3 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, round(CAST(x AS DOUBLE), 3)) END) AS g FROM embeddings),
c AS (SELECT vec_id, list_sum(g) AS t, list_sum(list_transform(g, lambda v, i: v * ((i - 1) % 12 + 0.5::DOUBLE))) AS sx, list_sum(list_transform(g, lambda v, i: v * ((i - 1) // 12 + 0.5::DOUBLE))) AS sy FROM g)
SELECT vec_id, CASE WHEN t > 1e-6 THEN round(sx / t / 12, 6) ELSE 0.5::DOUBLE END AS x, CASE WHEN t > 1e-6 THEN round(sy / t / 12, 6) ELSE 0.5::DOUBLE END AS y, CASE WHEN t > 1e-6 THEN 'saliency' ELSE 'center' END AS source FROM c""")

sql("image_types", "", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS type FROM pages")
sql("cutouts", "", """SELECT doc_id, n_chars % 300 < 245 AND (n_chars % 9000) / 10000.0 BETWEEN 0.06 AND 0.92 AND (10000 - n_chars % 9000) / 10000.0 >= 0.05
  AND greatest(1, n_chars % 101) * greatest(1, n_chars % 97) / 10000.0 BETWEEN 0.08 AND 0.96 AS cutout FROM documents""")
sql("flat_frames", "", """WITH f AS (SELECT user_id, event_type, event_id, value, event_id % 5 > 0 AS seen, event_id % 5 > 0 AND event_id % 6 > 0 AND value * 2 < 9 AND value * 3 < 34 AS bad FROM events),
g AS (SELECT user_id, event_type, [arg_max(seen, event_id), arg_min(seen, event_id), arg_max(seen, value)] AS s, [arg_max(bad, event_id), arg_min(bad, event_id), arg_max(bad, value)] AS b FROM f GROUP BY 1, 2)
SELECT user_id, event_type, len(list_filter(s, lambda x: x)) >= 2 AND len(list_filter(b, lambda x: x)) >= 2 AS flat FROM g""")

sql("archive_payloads", CANDIDATES, """, p AS (SELECT *, ['image/jpeg', 'video/webm', 'application/pdf', 'image/png'][cand_id % 4 + 1] AS mime FROM candidates WHERE cand_id % 10 > 0)
SELECT CAST(cand_id AS INT) AS scene_idx, 0 AS pos, CASE WHEN mime LIKE 'video%' THEN 'video' ELSE 'image' END AS kind, mime, title,
  concat_ws(' ', trim(replace(regexp_replace('<b>' || title || '</b> &amp; more', '<[^>]+>', ' ', 'g'), '&amp;', '&')), lang) AS description,
  CASE WHEN mime LIKE 'image%' AND cand_id % 3 > 0 THEN download_url || '/t' ELSE download_url END AS download_url, width, height, size * 40000 AS size, license
FROM p WHERE mime <> 'application/pdf' AND (mime LIKE 'image%' OR size * 40000 <= 125829120)""")
sql("image_payloads", CANDIDATES, """, p AS (SELECT *, CASE WHEN cand_id % 3 > 0 THEN download_url || '/t' WHEN cand_id % 5 > 0 THEN download_url END AS u, array_to_string(list_slice(string_split(title, ' '), 1, 12), ' ') AS tags FROM candidates)
SELECT CAST(cand_id AS INT) AS scene_idx, 0 AS pos, CASE WHEN cand_id % 4 > 0 THEN lang ELSE 'Openverse image' END AS title, concat_ws(' ', CASE WHEN cand_id % 4 > 0 THEN lang END, provider, nullif(tags, '')) AS description,
  u AS download_url, width, height, license, 'land' AS page_url FROM p WHERE u IS NOT NULL""")
pex = lambda w, h: f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN -1000.0::DOUBLE ELSE CASE WHEN {w}::DOUBLE / {h} < 0.8 THEN 8.0::DOUBLE WHEN {w}::DOUBLE / {h} < 1.0 THEN 3.0 ELSE 0.0 END + least({w}, 1920)::DOUBLE * least({h}, 1920) / 1000000 - CASE WHEN greatest({w}, {h}) > 2160 THEN 2.0 ELSE 0.0 END END"
sql("stock_file_payloads", CANDIDATES, f""", f AS (
  SELECT cand_id, lang, width AS rw, height AS rh, download_url || '/a' AS link, width AS w, height AS h, 1 AS o FROM candidates
  UNION ALL SELECT cand_id, lang, width, height, download_url || '/b', height, width, 2 FROM candidates WHERE cand_id % 4 > 0
  UNION ALL SELECT cand_id, lang, width, height, download_url || '/c', CASE WHEN cand_id % 6 > 0 THEN width // 2 ELSE 0 END, height // 2, 3 FROM candidates),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY {pex('w', 'h')} DESC, o) = 1),
s AS (SELECT * FROM f WHERE w > 0 AND h > 0 QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY w * h, greatest(w, h), o) = 1)
SELECT CAST(b.cand_id AS INT) AS scene_idx, 0 AS pos, 'Pexels video ' || b.cand_id AS title, b.lang AS description, b.link AS download_url, s.link AS preview_url, CAST(CASE WHEN b.w > 0 THEN b.w ELSE b.rw END AS INT) AS width, CAST(CASE WHEN b.h > 0 THEN b.h ELSE b.rh END AS INT) AS height FROM b JOIN s USING (cand_id)""")
sql("stock_variant_payloads", CANDIDATES, """, f AS (
  SELECT cand_id, lang, download_url || '/m' AS link, height AS w, width AS h, 1 AS b, 3 AS s FROM candidates
  UNION ALL SELECT cand_id, lang, download_url || '/s', width // 2, height // 2, 2, 2 FROM candidates
  UNION ALL SELECT cand_id, lang, download_url || '/l', width, height, 3, 4 FROM candidates WHERE cand_id % 3 > 0
  UNION ALL SELECT cand_id, lang, download_url || '/t', height // 4, width // 4, 4, 1 FROM candidates WHERE cand_id % 5 > 0),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY CASE WHEN h >= w THEN 0 ELSE 1 END, w * h DESC, b) = 1),
p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY w * h, greatest(w, h), s) = 1)
SELECT CAST(g.cand_id AS INT) AS scene_idx, 0 AS pos, CASE WHEN g.cand_id % 2 = 0 THEN g.lang ELSE 'Pixabay video ' || g.cand_id END AS title, g.link AS download_url, p.link AS preview_url, CAST(g.w AS INT) AS width, CAST(g.h AS INT) AS height FROM g JOIN p USING (cand_id)""")


def bad_term(h: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({h}, {lit(alt(t))}) THEN {lit(t)}" for t in BAD_TITLE_TERMS) + " END"


def guard(source: str) -> str:
    """Guard columns over a table with kind, hay, width, height, duration_ms, flat."""
    return f"""g1 AS (SELECT *, {bad_term('hay')} AS term, greatest(width, height) AS lng, least(width, height) AS sht FROM {source}),
g2 AS (SELECT *, width = 0 OR height = 0 AS dead, list_filter([CASE WHEN term IS NOT NULL THEN 'metadata:' || term END, CASE WHEN kind = 'image' AND lng < 700 THEN 'low_resolution' END, CASE WHEN kind = 'image' AND lng BETWEEN 700 AND 999 THEN 'medium_resolution' END,
  CASE WHEN kind = 'image' AND sht < 320 THEN 'extreme_aspect_or_tiny_short_edge' END, CASE WHEN kind = 'video' AND lng < 720 THEN 'low_video_resolution' END, CASE WHEN kind = 'video' AND duration_ms > 0 AND duration_ms < 650 THEN 'too_short' END,
  CASE WHEN kind = 'video' AND flat THEN 'flat_gray_video' END], lambda x: x IS NOT NULL) AS iss FROM g1),
guards AS (SELECT *, CAST(CASE WHEN dead THEN 0 ELSE greatest(0, 100 - coalesce(list_sum(list_transform(iss, lambda x: CASE WHEN x LIKE 'metadata%' THEN 24 WHEN x = 'low_resolution' THEN 35 WHEN x = 'medium_resolution' THEN 10 WHEN x = 'extreme_aspect_or_tiny_short_edge' THEN 18 WHEN x = 'low_video_resolution' THEN 20 WHEN x = 'too_short' THEN 25 ELSE 60 END)), 0)) END AS INT) AS guard_score,
  CASE WHEN dead THEN ['undecodable_' || kind] ELSE iss END AS issues FROM g2)"""


sql("quality_guard", CANDIDATES + """, m AS (SELECT cand_id, kind, lower(CASE WHEN cand_id % 9 = 0 THEN 'Old poster ' || title ELSE title END || ' ' || description) AS hay, CASE WHEN cand_id % 31 = 0 THEN 0 ELSE width END AS width, height, (cand_id % 40) * 50 AS duration_ms, cand_id % 8 = 0 AS flat FROM candidates
  WHERE size >= 512 OR kind = 'video'), small AS (SELECT cand_id FROM candidates WHERE size < 512 AND kind = 'image'), """ + guard("m"),
    """SELECT cand_id, guard_score, array_to_string(issues, '|') AS issues, guard_score >= 55 AS accept FROM guards UNION ALL SELECT cand_id, 0, 'undecodable_image', false FROM small""")

QC = SHOTS + """,
qa AS (SELECT *, asset_kind <> 'blank' AS shown, last_value(CASE WHEN asset_kind <> 'blank' THEN asset END IGNORE NULLS) OVER (PARTITION BY plan_id ORDER BY scene_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  CASE WHEN scene_idx % 3 > 0 THEN scene_idx % 40 END AS sem, end_ms - start_ms AS d FROM shots),
qb AS (SELECT *, [CASE WHEN NOT shown THEN 'missing visual asset' END, CASE WHEN shown AND asset = 'signup' THEN 'asset path does not exist' END, CASE WHEN shown AND asset = prev THEN 'same asset as previous scene' END, CASE WHEN d < 800 THEN 'scene too short' END, CASE WHEN d > 4000 THEN 'scene too long' END,
  CASE WHEN asset_kind = 'image' AND scene_idx % 4 = 0 THEN 'no visual focus metadata' END, CASE WHEN scene_idx % 6 = 0 THEN 'no caption text' END, CASE WHEN sem < 16 THEN 'very weak text-image semantic match' END, CASE WHEN sem BETWEEN 16 AND 19 THEN 'weak text-image semantic match' END, CASE WHEN scene_idx % 7 < 2 THEN 'weak retrieval score' END] AS r FROM qa),
qc AS (SELECT plan_id, scene_idx, least(100, greatest(0, 100 + CASE WHEN sem >= 28 THEN 5 ELSE 0 END - list_sum(list_transform(r, lambda x, i: CASE WHEN x IS NULL THEN 0 ELSE [75, 75, 35, 15, 15, 10, 8, 35, 18, 12][i] END)))) AS pct, list_filter(r, lambda x: x IS NOT NULL) AS r FROM qb)"""
sql("scene_qc", QC, f"SELECT plan_id, scene_idx, pct >= 55 AS ok, CAST(pct / 100.0::DOUBLE AS DOUBLE) AS score, {join('r')} AS reasons FROM qc")
sql("qc_summary", QC, "SELECT plan_id, bool_and(pct >= 55) AS ok, round_even(avg(pct / 100.0::DOUBLE), 3) AS average_score, count(*) FILTER (pct < 55) AS failed FROM qc GROUP BY 1")
sql("qc_records", QC, """SELECT plan_id, bool_and(pct >= 55) AS ok, round_even(avg(pct / 100.0::DOUBLE), 3) AS average_score, CAST(count(*) AS INT) AS scenes,
  string_agg(CAST(pct AS BIGINT)::VARCHAR, '|' ORDER BY scene_idx) AS scores, CAST(count(*) FILTER (pct < 55) AS INT) AS failed FROM qc GROUP BY 1""")
