"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from takemark.functions.text import NUMBER, NUMBER_WORDS, STOPWORDS, SUFFIXES, TOKEN, VOID_TAGS, WEAK
from takemark.operators.forms import FASTEST, FIELDS, NOT_FOUND, RULES, SUBJECTS
from takemark.operators.messages import BLANK, CLOSING, LABELS, OPENING, PLAIN, RULE, THANKS, UNKNOWN
from takemark.plans.inputs import BEATS, NEWS_BEFORE, PIECE, TYPES


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 4 THEN left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"CASE {cases} ELSE {w} END"


def _tokens(text: str) -> str:
    token = TOKEN.replace("'", "''")
    found = f"regexp_extract_all(lower({text}), '{token}')"
    return f"list_transform(list_filter({found}, lambda w: w NOT IN ({_list(STOPWORDS)}) AND length(w) >= 2), lambda w: {_stem('w')})"


def _numerals(text: str) -> str:
    named = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{n}' END" for w, n in NUMBER_WORDS.items())
    return f"list_distinct(list_concat(regexp_extract_all(lower({text}), '{NUMBER}'), list_filter([{named}], lambda x: x IS NOT NULL)))"


_PIECE = PIECE.replace("\\n", "\n")
_BASE = f"""
beats AS (
  SELECT CAST(floor(item_id / {BEATS}) AS BIGINT) AS lesson_id, CAST(item_id % {BEATS} AS INT) AS beat_idx, 'B' || lpad(CAST(item_id % {BEATS} + 1 AS VARCHAR), 2, '0') AS beat_id,
    trim(regexp_extract(text, '{_PIECE}')) AS title, text AS body, len(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '')) / 2.5::DOUBLE AS est_seconds
  FROM benchmark
), segments AS (
  SELECT doc_id % (SELECT CAST(ceil(count(*) / {BEATS}) AS BIGINT) FROM benchmark) AS lesson_id, doc_id AS take_id, unnest(p) AS text, CAST(unnest(range(len(p))) AS INT) AS seg_idx
  FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{_PIECE}'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
)"""
_TERMS = f"""{_BASE}, beat_terms AS (
  SELECT lesson_id, beat_idx, unnest({_tokens("title || '. ' || body")}) AS term FROM beats
), segment_terms AS (
  SELECT lesson_id, take_id, seg_idx, unnest({_tokens('text')}) AS term FROM segments
), takes AS (
  SELECT lesson_id, take_id, count(*) AS n_segments, (SELECT count(*) FROM beats b WHERE b.lesson_id = s.lesson_id) AS n_beats
  FROM segments s GROUP BY lesson_id, take_id
), model AS (
  SELECT t.lesson_id, t.take_id, term, sum(n) AS df, ln((any_value(n_segments + n_beats) + 1) / CAST(sum(n) + 1 AS DOUBLE)) + 1 AS idf
  FROM (
    SELECT lesson_id, take_id, term, count(DISTINCT seg_idx) AS n FROM segment_terms GROUP BY ALL
    UNION ALL
    SELECT t.lesson_id, t.take_id, term, count(DISTINCT beat_idx) AS n FROM takes t JOIN beat_terms b ON t.lesson_id = b.lesson_id GROUP BY ALL
  ) d JOIN takes t USING (lesson_id, take_id) GROUP BY ALL
)"""


def _vectors(name: str, source: str, key: str) -> str:
    return f"""{name}_raw AS (
  SELECT x.take_id, {key}, x.term, (1 + ln(count(*))) * any_value(idf) AS w FROM ({source}) x JOIN model m ON m.take_id = x.take_id AND m.term = x.term GROUP BY x.take_id, {key}, x.term
), {name} AS (
  SELECT r.take_id, {key}, term, w / norm AS w FROM {name}_raw r JOIN (SELECT take_id, {key}, sqrt(sum(w * w)) AS norm FROM {name}_raw GROUP BY ALL) USING (take_id, {key})
)"""


_BEAT_VECTORS = _vectors("bv", "SELECT t.take_id, beat_idx, term FROM takes t JOIN beat_terms b ON t.lesson_id = b.lesson_id", "beat_idx")
_CONTEXT = _vectors("cv", "SELECT t.take_id, unnest(range(greatest(seg_idx - 1, 0), least(seg_idx + 1, n_segments - 1) + 1)) AS seg_idx, term FROM segment_terms s JOIN takes t ON t.take_id = s.take_id", "seg_idx")
_GAPS = _vectors("lv", "SELECT t.take_id, unnest(range(greatest(seg_idx + 1, 1), least(seg_idx + 3, n_segments - 1) + 1)) AS gap, term FROM segment_terms s JOIN takes t ON t.take_id = s.take_id", "gap") + ", " + _vectors("rv", "SELECT t.take_id, unnest(range(greatest(seg_idx - 2, 1), least(seg_idx, n_segments - 1) + 1)) AS gap, term FROM segment_terms s JOIN takes t ON t.take_id = s.take_id", "gap")
_GAP_SIMS = f"""{_TERMS}, {_GAPS}, gaps AS (
  SELECT s.take_id, s.seg_idx AS gap, coalesce(g.sim, 0) AS sim FROM segments s
  LEFT JOIN (SELECT l.take_id, l.gap, round(sum(l.w * r.w), 12) AS sim FROM lv l JOIN rv r ON l.take_id = r.take_id AND l.gap = r.gap AND l.term = r.term GROUP BY ALL) g ON g.take_id = s.take_id AND g.gap = s.seg_idx
  WHERE s.seg_idx >= 1
)"""
_NEWS = "news AS (SELECT o_orderkey AS post_id, o_orderdate AS post_date, o_orderpriority AS category, o_orderstatus AS status, o_custkey FROM orders)"
_CLEAN = "regexp_replace(html, '<[^>]*>', '', 'g')"



def _form_values() -> dict[str, str]:
    raw = {
        "company": "role", "department": "''", "name": "substr(text, 1, 70)", "kana": "CASE conv_id % 3 WHEN 0 THEN 'カナ ひらがな' WHEN 1 THEN substr(text, 1, 5) END",
        "email": "regexp_extract(text, '[A-Za-z]+') || CASE WHEN turn % 2 = 0 THEN '@' ELSE '' END || 'mail.example'", "tel": "replace('052-' || conv_id || '-' || turn * 1000, '9', 'x')",
        "zip": "left(lpad(CAST(conv_id AS VARCHAR), 3, '0'), 3) || CASE WHEN turn % 2 = 0 THEN '-' ELSE '' END || left(lpad(CAST(turn * 111 AS VARCHAR), 4, '0'), 4)", "prefecture": "role", "city": "substr(text, 1, 110)", "address": "substr(text, 1, 140)",
        "subject": f"[{_list(SUBJECTS)}, '?'][turn % 7 + 1]", "message": "text", "privacy": "CASE WHEN turn % 5 <> 0 THEN 'on' END",
    }
    bare = {f.key: f"regexp_replace(coalesce({raw[f.key]}, ''), '<[^>]*>', '', 'g')" for f in FIELDS}
    return {f.key: f"trim({bare[f.key]})" if f.kind == "textarea" else f"trim(regexp_replace({bare[f.key]}, '[\\r\\n\\t]+', ' ', 'g'))" for f in FIELDS}


def _contact_errors() -> str:
    values, told = [f"{v} AS {k}" for k, v in _form_values().items()], []
    for f in sorted(FIELDS, key=lambda f: f.key):
        cases = [f"WHEN {f.key} = '' THEN '{f.key}=required'"] if f.required else [f"WHEN {f.key} = '' THEN NULL"]
        if f.most:
            cases.append(f"WHEN length({f.key}) > {f.most} THEN '{f.key}=too long'")
        if f.kind == "select":
            cases.append(f"WHEN {f.key} NOT IN ({_list(SUBJECTS)}) THEN '{f.key}=not an option'")
        if f.rule:
            pattern = RULES[f.rule].replace("'", "''")
            cases.append(f"WHEN NOT regexp_matches({f.key}, '{pattern}') THEN '{f.key}=not a {f.rule}'")
        told.append(f"CASE {' '.join(cases)} END")
    return f"""WITH v AS (SELECT conv_id, turn, {', '.join(values)} FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 50 = 0 OR coalesce(conv_id % 40 < {FASTEST}, false) THEN 'form=rejected' ELSE concat_ws(';', {', '.join(told)}) END AS errors FROM v"""


ORACLES = {
    "q_tokenize": f"WITH {_BASE} SELECT take_id, seg_idx, array_to_string({_tokens('text')}, ' ') AS tokens FROM segments",
    "q_numerals": f"""WITH n AS (SELECT doc_id, {_numerals('text')} AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(n), ',') AS numerals,
  array_to_string(list_sort(list_filter(n, lambda x: contains(x, '%') OR (regexp_full_match(x, '[0-9]+') AND length(regexp_replace(x, '^0+', '')) >= 2))), ',') AS claims FROM n""",
    "q_timecodes": """WITH e AS (SELECT event_id, CAST(CASE WHEN v - floor(v) = 0.5 THEN 2 * round(v / 2) ELSE round(v) END AS BIGINT) AS s, v FROM (SELECT event_id, value * 37 AS v FROM events))
SELECT event_id, CASE WHEN v IS NULL THEN '--:--:--' ELSE printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS tc FROM e""",
    "q_durations": """WITH d AS (SELECT doc_id AS i FROM documents WHERE doc_id IS NOT NULL), m AS (
  SELECT i, CASE i % 7 WHEN 0 THEN i % 100 * 60 + i % 60 WHEN 1 THEN i % 5 * 3600 + i % 60 * 60 + i % 59 WHEN 2 THEN i WHEN 5 THEN i % 7 * 60 + 30 END AS s FROM d)
SELECT i AS doc_id, CAST(CASE WHEN i % 7 = 2 THEN s * 60 ELSE s END AS BIGINT) AS duration, CAST(s AS BIGINT) AS clock FROM m""",
    "q_segment_close": f"WITH {_BASE} SELECT take_id, seg_idx, CAST(4 * seg_idx AS BIGINT) AS start_s, CAST(coalesce(lead(4 * seg_idx) OVER (PARTITION BY take_id ORDER BY seg_idx), 4 * seg_idx + 8) AS BIGINT) AS end_s FROM segments",
    "q_beats": f"WITH {_BASE} SELECT lesson_id, beat_idx, beat_id, title, CAST(floor(est_seconds * 1e6 + 0.5) AS BIGINT) AS est_seconds FROM beats",
    "q_idf": f"WITH {_TERMS} SELECT take_id, term, CAST(df AS BIGINT) AS df, CAST(floor(idf * 1e6 + 0.5) AS BIGINT) AS idf FROM model",
    "q_segment_beat_cosine": f"""WITH {_TERMS}, {_BEAT_VECTORS}, {_CONTEXT}
SELECT c.take_id, CAST(seg_idx AS INT) AS seg_idx, beat_idx, CAST(floor(round(sum(c.w * b.w), 12) * 1e4 + 0.5) AS BIGINT) AS sim
FROM cv c JOIN bv b ON c.take_id = b.take_id AND c.term = b.term GROUP BY c.take_id, seg_idx, beat_idx""",
    "q_gap_similarity": f"WITH {_GAP_SIMS} SELECT take_id, gap, CAST(floor(sim * 1e4 + 0.5) AS BIGINT) AS sim FROM gaps",
    "q_blocks": f"""WITH RECURSIVE {_GAP_SIMS}, cut AS (SELECT take_id, round(avg(sim) - 0.25 * stddev_pop(sim), 12) AS cutoff FROM gaps GROUP BY take_id
), near AS (SELECT *, lag(sim, 1, 1) OVER w AS lower_gap, lead(sim, 1, 1) OVER w AS upper_gap FROM gaps WINDOW w AS (PARTITION BY take_id ORDER BY gap)
), minima AS (SELECT n.take_id, gap, n_segments FROM near n JOIN cut USING (take_id) JOIN takes t ON t.take_id = n.take_id WHERE sim <= cutoff AND sim <= lower_gap AND sim <= upper_gap AND n_segments - gap >= 3
), walk(take_id, pos) AS (SELECT take_id, 0 FROM takes UNION ALL SELECT w.take_id, (SELECT min(gap) FROM minima m WHERE m.take_id = w.take_id AND gap - w.pos >= 3) FROM walk w WHERE w.pos IS NOT NULL
), edges AS (SELECT take_id, pos AS lo, lead(pos) OVER (PARTITION BY take_id ORDER BY pos) AS following FROM walk WHERE pos IS NOT NULL)
SELECT e.take_id, CAST(row_number() OVER (PARTITION BY e.take_id ORDER BY lo) - 1 AS INT) AS block, CAST(lo AS INT) AS lo, CAST(coalesce(following, n_segments) - 1 AS INT) AS hi FROM edges e JOIN takes t ON t.take_id = e.take_id""",
    "q_spoken_coverage": f"""WITH {_TERMS}
SELECT t.take_id, b.beat_idx, count(*) AS planned, count(s.term) AS said FROM takes t JOIN (SELECT DISTINCT * FROM beat_terms) b ON b.lesson_id = t.lesson_id
LEFT JOIN (SELECT DISTINCT take_id, term FROM segment_terms) s ON s.take_id = t.take_id AND s.term = b.term GROUP BY ALL""",
    "q_onscreen_never_said": f"""WITH {_TERMS}, n AS (SELECT lesson_id, lesson_id * {BEATS} + beat_idx AS n, title FROM beats
), shown AS (SELECT DISTINCT lesson_id, 'A' || lpad(CAST(n AS VARCHAR), 4, '0') AS asset_id, term
  FROM (SELECT lesson_id, n, unnest({_tokens('title')}) AS term FROM n WHERE [{_list(TYPES)}][n % {len(TYPES)} + 1] NOT IN ('lower_third', 'caption', 'chapter_marker', 'title_card'))
  WHERE term NOT IN ({_list(WEAK)}) AND length(term) > 2)
SELECT t.take_id, asset_id, string_agg(s.term, ',' ORDER BY s.term) AS never FROM takes t JOIN shown s ON s.lesson_id = t.lesson_id
WHERE NOT EXISTS (SELECT 1 FROM segment_terms x WHERE x.take_id = t.take_id AND x.term = s.term) GROUP BY ALL""",
    "q_html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages",
    "q_excerpt": f"WITH p AS (SELECT page_id, trim(regexp_replace({_CLEAN}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 70 THEN left(t, 70) || '…' ELSE t END AS excerpt FROM p",
    "q_sanitize": f"SELECT page_id, md5(trim(regexp_replace({_CLEAN}, '[\\r\\n\\t]+', ' ', 'g'))) AS clean FROM pages",
    "q_zip": """WITH z AS (SELECT c_custkey, regexp_replace(translate(lpad(CAST(c_custkey AS VARCHAR), 7, '0'), '０１２３４', '01234'), '[^0-9]', '', 'g') AS zip FROM customer)
SELECT c_custkey, zip, left(zip, 3) || '-' || substr(zip, 4, 4) AS shown FROM z""",
    "q_form_errors": """SELECT c_custkey, concat_ws(';',
  CASE WHEN coalesce(c_name, '') = '' THEN 'name=required' WHEN length(c_name) > 18 THEN 'name=too long' END,
  CASE WHEN coalesce(c_mktsegment, '') = '' THEN 'segment=required' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment=not an option' END,
  CASE WHEN length('03-' || c_custkey) NOT BETWEEN 7 AND 20 THEN 'tel=not a number' END) AS errors FROM customer""",
    "q_news_top4": f"WITH {_NEWS} SELECT post_id, category, strftime(post_date, '%Y.%m.%d') AS shown FROM news WHERE status = 'F' ORDER BY post_date DESC, post_id DESC LIMIT 4",
    "q_news_by_category": f"WITH {_NEWS} SELECT post_id FROM news WHERE category = '1-URGENT' ORDER BY post_date DESC, post_id DESC LIMIT 3",
    "q_news_pages": f"WITH {_NEWS}, r AS (SELECT post_id, CAST(row_number() OVER (PARTITION BY category, o_custkey ORDER BY post_date DESC, post_id DESC) AS INT) AS place FROM news) SELECT post_id, place, CAST((place - 1) // 10 + 1 AS BIGINT) AS page FROM r",
    "q_news_neighbours": f"WITH {_NEWS} SELECT post_id, coalesce(lag(post_id) OVER w, -1) AS previous, coalesce(lead(post_id) OVER w, -1) AS next FROM news WINDOW w AS (PARTITION BY o_custkey ORDER BY post_date, post_id)",
    "q_terms_nonempty": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "q_seed_missing": "SELECT o_orderpriority AS slug FROM orders UNION SELECT c_mktsegment FROM customer",
    "q_rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL
), w AS (SELECT event_id, user_id, rn, true AS allowed, 1 AS n, t + 3600 AS until FROM e WHERE rn = 1
  UNION ALL SELECT event_id, user_id, rn, live < 5, live + CAST(live < 5 AS INT), CASE WHEN live < 5 THEN t + 3600 ELSE until END
  FROM (SELECT e.*, w.until, CASE WHEN e.t >= w.until THEN 0 ELSE w.n END AS live FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
SELECT event_id, allowed FROM w UNION ALL SELECT event_id, true FROM events WHERE user_id IS NULL""",
    "q_ttl_cache": """WITH RECURSIVE e AS (SELECT event_id, zip, epoch_us(ts) / 1e6 AS t, CASE WHEN zip % 3 = 0 THEN 3600 ELSE 2592000 END AS life, row_number() OVER (PARTITION BY zip ORDER BY ts, event_id) AS rn FROM (SELECT *, event_id % 400 AS zip FROM events)
), w AS (SELECT event_id, zip, rn, false AS hit, t + life AS until FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.zip, e.rn, e.t < w.until, CASE WHEN e.t < w.until THEN w.until ELSE e.t + life END FROM w JOIN e ON e.zip = w.zip AND e.rn = w.rn + 1)
SELECT event_id, zip, hit FROM w""",
    "q_request_dedupe": "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type",
    "q_last_decision": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "q_accuracy": "WITH e AS (SELECT l_returnflag, CAST(trunc(abs(l_extendedprice - l_quantity * 1000)) AS BIGINT) AS e FROM lineitem) SELECT l_returnflag, CAST(median(e) AS DOUBLE) AS median, max(e) AS most, count(*) FILTER (e <= 15000) AS near FROM e GROUP BY l_returnflag",
    "q_runtimes": f"""WITH {_BASE} SELECT s.take_id, any_value(p.planned) AS planned, CAST(4 * max(seg_idx) + 8 AS BIGINT) AS actual FROM segments s
LEFT JOIN (SELECT lesson_id, CAST(floor(sum(est_seconds) FILTER (est_seconds <> 0) * 1e6 + 0.5) AS BIGINT) AS planned FROM beats GROUP BY ALL) p ON p.lesson_id = s.lesson_id GROUP BY s.take_id""",
    "q_planned_shares": f"""WITH {_BASE}, e AS (SELECT lesson_id, beat_id, CASE WHEN coalesce(est_seconds, 0) = 0 THEN 60 ELSE est_seconds END AS e FROM beats)
SELECT lesson_id, beat_id, CAST(floor(e / sum(e) OVER (PARTITION BY lesson_id) * 1e6 + 0.5) AS BIGINT) AS share FROM e""",
    "q_semantic_verdicts": f"""WITH {_BASE}, t AS (SELECT lesson_id, take_id, count(*) AS n FROM segments GROUP BY ALL
), r AS (SELECT t.take_id, beat_idx, beat_id, (t.take_id + beat_idx) % 3 <> 0 AS given, t.take_id + beat_idx AS mark, 4 * ((t.take_id * 7 + beat_idx * 3) % n) AS b FROM t JOIN beats USING (lesson_id)
), v AS (SELECT *, CASE WHEN given AND mark % 4 <> 1 THEN b END AS s, CASE WHEN given THEN b + 12 END AS e FROM r)
SELECT take_id, beat_id, CASE WHEN given AND mark % 5 <> 2 THEN ['TAUGHT', 'MOVED', '', 'MODIFIED', 'MERGED'][mark % 5 + 1] ELSE 'SKIPPED' END AS status,
  CASE WHEN s IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY take_id ORDER BY s NULLS LAST, beat_idx) - 1 AS INT) END AS actual_order, CAST(s AS BIGINT) AS start_s, CAST(e AS BIGINT) AS end_s,
  CAST(CASE WHEN given THEN mark % 100 * 10000 ELSE 300000 END AS BIGINT) AS confidence, CASE WHEN given THEN 'seen' ELSE 'Model returned no verdict for this beat.' END AS summary, CASE WHEN given THEN 0 ELSE 1 END AS n_findings,
  coalesce((SELECT string_agg(CAST(x.seg_idx AS VARCHAR), ',' ORDER BY x.seg_idx) FROM segments x WHERE x.take_id = v.take_id AND 4 * x.seg_idx BETWEEN s AND e), '') AS evidence FROM v""",
    "q_semantic_added": f"""WITH {_BASE}, t AS (SELECT lesson_id, take_id, count(*) AS n FROM segments GROUP BY ALL
), r AS (SELECT t.take_id, beat_idx, 4 * ((t.take_id * 7 + beat_idx * 3) % n) AS s FROM t JOIN beats USING (lesson_id) WHERE beat_idx < 2 AND (t.take_id + beat_idx) % 2 = 0)
SELECT take_id, 'NEW-0' || (beat_idx + 1) AS id, 'Aside' AS title, CAST(beat_idx + 1 AS INT) AS actual_order, CAST(s AS BIGINT) AS start_s,
  coalesce((SELECT string_agg(CAST(x.seg_idx AS VARCHAR), ',' ORDER BY x.seg_idx) FROM segments x WHERE x.take_id = r.take_id AND 4 * x.seg_idx BETWEEN s AND s + 8), '') AS evidence FROM r""",
    "q_one_line": "SELECT doc_id, md5(replace(replace(text, chr(13), ''), chr(10), '')) AS header FROM documents",
    "q_tel_link": "SELECT doc_id, md5(replace(text, '-', '')) AS tel FROM documents",
    "q_visitor_key": "SELECT event_id, 'visitor_' || md5(CAST(user_id AS VARCHAR)) AS visitor FROM events",
    "q_contact_errors": _contact_errors(),
    "q_form_steps": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'complete' WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 4 = 2 THEN 'input'
  WHEN coalesce(value > 60, false) THEN 'input' WHEN event_id % 4 = 0 THEN 'confirm' WHEN event_id % 4 <> 1 THEN 'input'
  WHEN event_id % 3 = 0 THEN 'input' WHEN event_id % 13 <> 0 THEN 'redirect' ELSE 'confirm' END AS step FROM events""",
    "q_zip_lookup": """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS zip FROM customer
), o AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS zip, 'P' || s_nationkey || s_name AS a FROM supplier WHERE s_suppkey % 5 <> 0
), r AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS zip, p_brand || p_type || p_name AS a FROM part WHERE coalesce(p_brand, '') <> '')
SELECT c_custkey, q.zip, coalesce(o.a, r.a) IS NOT NULL AS found, coalesce(o.a, r.a) AS address FROM q LEFT JOIN o ON o.zip = q.zip LEFT JOIN r ON r.zip = q.zip""",
    "q_nav": "SELECT n_regionkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT) AS place FROM nation WHERE n_nationkey % 4 <> 0",
    "q_body_class": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'p-home' WHEN 1 THEN 'p-' || lower(o_orderpriority) WHEN 2 THEN 'p-news-detail' WHEN 5 THEN '' ELSE 'p-news' END AS css FROM orders",
    "q_first_category": "SELECT l_orderkey, arg_min(l_partkey, (l_returnflag, l_partkey)) AS part, min(l_returnflag) AS category FROM lineitem GROUP BY l_orderkey",
}
ORACLES["q_rate_limit_stream"] = ORACLES["q_rate_limit"]
ORACLES["q_ttl_cache_stream"] = ORACLES["q_ttl_cache"]
ORACLES["q_form_walk"] = ORACLES["q_form_walk_stream"] = """WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, coalesce(value > 90, false) AS failed, coalesce(value > 5, false) AS mailed,
    CASE event_type WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'send' WHEN 'signup' THEN 'landing' WHEN 'error' THEN 'back' ELSE 'show' END AS action
  FROM events WHERE user_id IS NOT NULL
), w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS step, CAST(NULL AS DOUBLE) AS shown, false AS confirmed, false AS sent, 0 AS n, min(t) AS until, CAST(NULL AS DOUBLE) AS ends FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, event_id, step, CASE step WHEN 'input' THEN t WHEN 'redirect' THEN NULL ELSE shown END, CASE WHEN step IN ('input', 'redirect') THEN false WHEN asks THEN true ELSE confirmed END,
    CASE WHEN action = 'landing' THEN false ELSE sent OR step = 'redirect' END, CASE WHEN tries THEN live + CAST(live < 1 AS INT) ELSE n END, CASE WHEN tries AND live < 1 THEN t + 432000 ELSE until END, greatest(CASE WHEN tries AND live < 1 THEN t + 432000 ELSE until END, t + 43200)
  FROM (
    SELECT *, CASE WHEN action = 'landing' THEN CASE WHEN sent THEN 'complete' ELSE 'input' END WHEN asks THEN 'confirm' WHEN tries AND live < 1 THEN CASE WHEN mailed THEN 'redirect' ELSE 'confirm' END ELSE 'input' END AS step
    FROM (
      SELECT *, valid AND action = 'confirm' AS asks, valid AND action = 'send' AND confirmed AS tries
      FROM (
        SELECT *, CASE WHEN t >= until THEN 0 ELSE n END AS live, action IN ('confirm', 'send') AND NOT failed AND coalesce(t - shown >= 3 AND t - shown < 43200, false) AS valid
        FROM (
          SELECT e.*, CASE WHEN fresh THEN NULL ELSE w.shown END AS shown, w.confirmed AND NOT fresh AS confirmed, w.sent AND NOT fresh AS sent, CASE WHEN fresh THEN 0 ELSE w.n END AS n, CASE WHEN fresh THEN e.t ELSE w.until END AS until
          FROM (SELECT w.*, e.t AS now, coalesce(e.t >= w.ends, false) AS fresh FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
        )
      )
    )
  )
)
SELECT event_id, step FROM w WHERE rn > 0 UNION ALL SELECT event_id, 'input' FROM events WHERE user_id IS NULL"""
ORACLES["q_segments_in_beats"] = f"""WITH {_BASE}, p AS (SELECT lesson_id, beat_idx, sum(est_seconds) OVER (PARTITION BY lesson_id ORDER BY beat_idx) AS hi, est_seconds FROM beats)
SELECT take_id, beat_idx, seg_idx FROM segments s JOIN p ON p.lesson_id = s.lesson_id AND 4.0 * seg_idx BETWEEN hi - est_seconds AND hi"""
_BLOCKS = ", blocks AS (SELECT".join(ORACLES["q_blocks"].rsplit("SELECT", 1)).replace(")\n, blocks AS", "), blocks AS") + ")"
_BLOCK_VECTORS = _vectors("kv", "SELECT s.take_id, block, term FROM segment_terms s JOIN blocks b ON b.take_id = s.take_id AND s.seg_idx BETWEEN b.lo AND b.hi", "block")
ORACLES["q_merge_share"] = f"""{_BLOCKS}, {_BEAT_VECTORS}, {_CONTEXT}, cells AS (
  SELECT c.take_id, CAST(seg_idx AS INT) AS seg_idx, beat_idx, round(sum(c.w * b.w), 12) AS sim FROM cv c JOIN bv b ON c.take_id = b.take_id AND c.term = b.term GROUP BY c.take_id, seg_idx, beat_idx
), grid AS (
  SELECT k.take_id, k.block, k.lo, k.hi, b.beat_idx FROM blocks k JOIN takes t ON t.take_id = k.take_id JOIN beats b ON b.lesson_id = t.lesson_id
)
SELECT g.take_id, g.block, g.beat_idx, CAST(floor(coalesce(sum(sim) FILTER (seg_idx BETWEEN lo AND hi), 0) / CASE WHEN coalesce(sum(sim), 0) = 0 THEN 1 ELSE sum(sim) END * 1e4 + 0.5) AS BIGINT) AS share
FROM grid g LEFT JOIN cells c ON c.take_id = g.take_id AND c.beat_idx = g.beat_idx GROUP BY g.take_id, g.block, g.beat_idx"""
ORACLES["q_greedy_match"] = f"""{_BLOCKS}, {_BEAT_VECTORS}, {_BLOCK_VECTORS}, sims AS (
  SELECT k.take_id, block, beat_idx, round(sum(k.w * b.w), 12) AS sim FROM kv k JOIN bv b ON k.take_id = b.take_id AND k.term = b.term GROUP BY k.take_id, block, beat_idx
), sizes AS (
  SELECT k.take_id, count(*) AS nk, any_value(n_beats) AS nb FROM blocks k JOIN takes t ON t.take_id = k.take_id GROUP BY k.take_id
), ordered AS (
  SELECT take_id, block, beat_idx, row_number() OVER (PARTITION BY take_id ORDER BY scored DESC, block DESC, beat_idx DESC) AS rn
  FROM (SELECT s.*, round(sim * CASE WHEN nb < 2 OR nk < 2 THEN 1 ELSE greatest(0.15, 1 - 0.55::DOUBLE * abs(block / (nk - 1)::DOUBLE - beat_idx / (nb - 1)::DOUBLE)) END, 9) AS scored FROM sims s JOIN sizes z ON z.take_id = s.take_id WHERE sim >= 0.055)
), claims AS (
  SELECT take_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INT) AS block, CAST(NULL AS INT) AS beat_idx, false AS taken, CAST([] AS INT[]) AS bs, CAST([] AS INT[]) AS es FROM sizes
  UNION ALL
  SELECT take_id, rn, block, beat_idx, ok, CASE WHEN ok THEN list_append(bs, block) ELSE bs END, CASE WHEN ok THEN list_append(es, beat_idx) ELSE es END
  FROM (SELECT o.*, c.bs, c.es, NOT list_contains(c.bs, o.block) AND NOT list_contains(c.es, o.beat_idx) AS ok FROM claims c JOIN ordered o ON o.take_id = c.take_id AND o.rn = c.rn + 1)
)
SELECT take_id, block, beat_idx FROM claims WHERE taken"""
ORACLES["q_ranked_orders"] = """WITH o AS (SELECT o_orderkey, o_orderdate, CAST(CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS INT) AS severity FROM orders)
SELECT o_orderkey, severity, row_number() OVER (ORDER BY severity DESC, o_orderkey) - 1 AS pos, dense_rank() OVER (ORDER BY severity DESC, o_orderkey) AS by_key, dense_rank() OVER (ORDER BY severity DESC, o_orderdate) AS rank FROM o"""


def _runs(source: str, group: str, out: str) -> str:
    """Longest increasing runs of the lists v of source (group, v), by comparing each place with all before it."""
    return f"""
lens AS (
  SELECT {group}, v, 1 AS i, [1] AS l, [0] AS b FROM {source}
  UNION ALL
  SELECT {group}, v, i + 1, list_append(l, 1 + best), list_append(b, CASE WHEN best = 0 THEN 0 ELSE list_position(fits, best) END)
  FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] THEN l[j] ELSE 0 END) AS fits, list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] THEN l[j] ELSE 0 END)) AS best FROM lens WHERE i < len(v))
), back AS (
  SELECT {group}, v, b, list_position(l, list_max(l)) AS p, [list_position(l, list_max(l))] AS kept FROM lens WHERE i = len(v)
  UNION ALL
  SELECT {group}, v, b, b[p], list_prepend(b[p], kept) FROM back WHERE b[p] > 0
)
SELECT {out} FROM back WHERE b[p] = 0"""


ORACLES["q_lis_moved"] = f"""WITH RECURSIVE {_TERMS}, firsts AS (
  SELECT lesson_id, take_id, term, min(seg_idx) AS seg_idx FROM segment_terms GROUP BY ALL
), titles AS (
  SELECT DISTINCT lesson_id, beat_idx, unnest({_tokens('title')}) AS term FROM beats
), tapes AS (
  SELECT take_id, list(beat_idx ORDER BY seg_idx, beat_idx) AS v FROM (SELECT f.take_id, t.beat_idx, min(f.seg_idx) AS seg_idx FROM firsts f JOIN titles t ON t.lesson_id = f.lesson_id AND t.term = f.term GROUP BY ALL) GROUP BY take_id
), {_runs("tapes", "take_id", "take_id, list_aggregate(list_transform(kept, lambda i: CAST(v[i] AS VARCHAR)), 'string_agg', ',') AS kept, coalesce(list_aggregate(list_transform(list_filter(range(1, len(v) + 1), lambda i: NOT list_contains(kept, i)), lambda i: CAST(v[i] AS VARCHAR)), 'string_agg', ','), '') AS moved")}"""
ORACLES["q_rising_values"] = f"""WITH RECURSIVE users AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events WHERE user_id IS NOT NULL GROUP BY user_id
), {_runs("users", "user_id", "user_id, list_aggregate(list_transform(kept, lambda i: CAST(i AS VARCHAR)), 'string_agg', ',') AS places")}"""


def _messages() -> str:
    values = ", ".join(f"{v} AS {k}" for k, v in _form_values().items())
    flat = lambda x: f"replace(replace({x}, chr(13), ''), chr(10), '')"
    listed = ", ".join(f"'{LABELS[f.key]}: ' || CASE WHEN {f.key} = '' THEN '{BLANK}' ELSE {f.key} END" for f in FIELDS if f.key != "privacy")
    stamp = "strftime(sent, '%Y年') || month(sent) || '月' || day(sent) || strftime(sent, '日 %H:%M')"
    notice = f"concat_ws(chr(10), '{OPENING}', '', '{RULE}', {listed}, '{RULE}', '', '送信日時: ' || {stamp}, '送信元 IP: ' || CASE WHEN turn % 2 = 0 THEN '192.0.2.1' ELSE '{UNKNOWN}' END)"
    thanks = ", ".join(f"'{t}'" for t in THANKS)
    reply = f"concat_ws(chr(10), company, name || ' 様', '', {thanks}, '', '{RULE}', '{LABELS['subject']}: ' || subject, '', message, '{RULE}', '', '{CLOSING}', '', 'Takemark')"
    return f"""WITH v AS (SELECT conv_id, turn, {values.replace(" AS privacy", " AS consent")}, make_timestamp((1700000000 + conv_id * 3600 + turn * 60) * 1000000) AS sent FROM conversations)
SELECT conv_id, turn, 'notice' AS kind, md5('desk@mail.example') AS recipient, md5({flat("'[Takemark] お問い合わせ（' || subject || '）'")}) AS subject, md5('{PLAIN}|Reply-To: ' || {flat("name")} || ' <' || {flat("email")} || '>') AS headers, md5({notice}) AS body FROM v
UNION ALL SELECT conv_id, turn, 'reply', md5(email), md5('【Takemark】お問い合わせを受け付けました'), md5('{PLAIN}'), md5({reply}) FROM v WHERE turn % 4 <> 3"""


ORACLES["q_messages"] = _messages()
ORACLES["q_zip_provider"] = f"""WITH r AS (
  SELECT *, CASE WHEN c_custkey % 11 = 0 THEN '12' ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS zip, 'P' || c_nationkey AS p FROM customer
), s AS (
  SELECT *, CASE WHEN length(zip) <> 7 THEN 'not asked' WHEN c_custkey % 13 = 0 OR c_custkey % 7 = 3 THEN 'failed' WHEN c_custkey % 7 = 2 THEN 'malformed' WHEN c_custkey % 7 < 2 THEN 'nothing' ELSE 'found' END AS state FROM r
)
SELECT c_custkey, state, CASE WHEN state = 'found' THEN '{{"found":true,"zipcode":"' || zip || '","address":{{"prefecture":"' || p || '","city":"' || c_mktsegment || '","town":"' || c_name || '","full":"' || p || c_mktsegment || c_name || '"}}}}'
  ELSE '{{"found":false,"message":"{NOT_FOUND}"}}' END AS response, CAST(CASE WHEN state = 'found' THEN 2592000 ELSE 3600 END AS BIGINT) AS life FROM s"""
_DECISIONS = "decisions AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'reject' END AS decision FROM events WHERE event_type IN ('click', 'purchase', 'error'))"
ORACLES["q_decision_as_of"] = f"""WITH {_DECISIONS}, met AS (
  SELECT v.event_id, arg_max(coalesce(c.decision, ''), (c.ts, c.event_id)) AS decision FROM events v JOIN decisions c ON c.user_id = v.user_id AND c.ts <= v.ts WHERE v.event_type = 'view' GROUP BY v.event_id
)
SELECT v.event_id, nullif(m.decision, '') AS decision FROM events v LEFT JOIN met m ON m.event_id = v.event_id WHERE v.event_type = 'view'"""
ORACLES["q_worklist"] = f"""WITH {_DECISIONS}, l AS (
  SELECT CAST(floor(event_id / 2) AS BIGINT) AS id, arg_max(coalesce(decision, ''), (ts, event_id)) AS decision FROM decisions WHERE ts <= TIMESTAMP '2024-01-16' GROUP BY 1
)
SELECT o_orderpriority AS owner, count(*) AS shown, count(*) FILTER (coalesce(decision, '') = '') AS undecided FROM orders LEFT JOIN l ON id = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1"""
ORACLES["q_time_errors"] = """WITH e AS (SELECT l_returnflag, l_linenumber, abs(l_quantity - l_extendedprice / 1000) AS e FROM lineitem)
SELECT l_returnflag, l_linenumber, count(e) AS n, CAST(floor(avg(e) * 1e3 + 0.5) AS BIGINT) AS mean, CAST(floor(median(e) * 1e3 + 0.5) AS BIGINT) AS median, CAST(floor(max(e) * 1e3 + 0.5) AS BIGINT) AS worst, count(*) FILTER (e <= 15) AS near FROM e GROUP BY ALL"""
_TAG_PARTS = ", ".join(f"regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<(/?)([a-zA-Z0-9!]+)([^>]*?)(/?)>', {k}) AS g{k}" for k in (1, 2, 4))
ORACLES["q_tag_balance"] = f"""WITH RECURSIVE parts AS (SELECT page_id, {_TAG_PARTS} FROM pages
), tags AS (
  SELECT page_id, list_filter(list_transform(range(1, len(g2) + 1), lambda i: CASE WHEN g4[i] = '/' OR lower(g2[i]) IN ({_list(VOID_TAGS)}) THEN NULL ELSE g1[i] || lower(g2[i]) END), lambda x: x IS NOT NULL) AS t FROM parts
), walk AS (
  SELECT page_id, t, 0 AS i, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS wrong, CAST(NULL AS VARCHAR) AS expected FROM tags
  UNION ALL
  SELECT page_id, t, i + 1, CASE WHEN x[1] = '/' THEN stack[:len(stack) - 1] ELSE list_append(stack, x) END, CASE WHEN x[1] = '/' AND stack[-1] IS DISTINCT FROM x[2:] THEN x[2:] END, CASE WHEN x[1] = '/' AND stack[-1] IS DISTINCT FROM x[2:] THEN stack[-1] END
  FROM (SELECT *, t[i + 1] AS x FROM walk WHERE i < len(t) AND wrong IS NULL)
)
SELECT page_id, CASE WHEN wrong IS NOT NULL THEN '</' || wrong || '> closes <' || coalesce(expected, 'nothing') || '>' WHEN len(stack) > 0 THEN 'not closed: <' || array_to_string(stack, '>, <') || '>' ELSE '' END AS told
FROM walk WHERE wrong IS NOT NULL OR i = len(t)"""
ORACLES["q_menu"] = f"""WITH p AS (
  SELECT n_regionkey, lower(n_name) AS slug, n_name AS title, CAST(n_nationkey * 10 AS BIGINT) AS place, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * 100 > (SELECT count(*) FROM customer WHERE c_nationkey IS NOT NULL) AS nav,
    (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS id FROM nation
), s AS (SELECT * FROM p WHERE nav AND id IS NOT NULL)
SELECT n_regionkey, place + 1 AS position, 'page' AS kind, title, CAST(id AS VARCHAR) AS target FROM s UNION ALL SELECT n_regionkey, place, 'link', 'お知らせ', '/news/' FROM s WHERE slug = '{NEWS_BEFORE}'"""
