"""DuckDB SQL that gives the rows of ``queries``."""

from __future__ import annotations

_OUTCOMES = """
models AS (SELECT * FROM (VALUES (0, 'light', 0, 1000, 4000), (1, 'middle', 0, 2127, 8509), (2, 'think', 0, 6565, 26260)) t(m, model_id, fixed, i_nano, o_nano)),
outcomes AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS episode_id, model_id, m,
    25 * least(4, 2 * coalesce(quality, 0) + (d.doc_id + m) % 3) AS hundredths, 1 + d.doc_id % 3 AS num_generations,
    greatest(1, n_chars // 4) AS input_tokens, (50 + (d.doc_id * 7 + m * 13) % 200) * (m + 1) AS output_tokens,
    fixed + greatest(1, n_chars // 4) * i_nano + (50 + (d.doc_id * 7 + m * 13) % 200) * (m + 1) * o_nano AS cost_nano
  FROM documents d LEFT JOIN labels l USING (doc_id) CROSS JOIN models)"""

_DOCUMENTS = "SELECT doc_id, CAST(doc_id AS VARCHAR) AS episode_id, text, 1 AS n_messages FROM documents"
_CONVERSATIONS = "SELECT conv_id AS doc_id, CAST(conv_id AS VARCHAR) AS episode_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_messages FROM conversations GROUP BY conv_id"


def _features(source: str) -> str:
    return f"episodes AS ({source})," + _FEATURE_COLUMNS


_FEATURE_COLUMNS = r"""
plain AS (SELECT *, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS ascii FROM episodes),
counts AS (
  SELECT doc_id, episode_id, text, n_messages, ascii, length(text) AS n_chars, greatest(1, length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]', '', 'g'))) AS solid,
    len(regexp_extract_all(text, '[A-Za-z가-힣]+')) AS n_words, greatest(1, len(regexp_extract_all(text, '[.!?。！？]'))) AS n_sentences,
    len(regexp_extract_all(text, '[가-힣]')) AS n_hangul, len(regexp_extract_all(text, '\p{Nd}')) AS n_digits,
    len(regexp_extract_all(ascii, '(?im)```|(?:^|\s)(?:def|class|function|SELECT|FROM|import|#include)\b|[{};]\s*$')) AS n_code,
    len(regexp_extract_all(text, '[=+\-*/^∑∫√≈≠≤≥<>]|\\(?:frac|sum|int|sqrt)\b')) AS n_maths,
    len(regexp_extract_all(ascii, '(?i)\b(?:prove|derive|reason|analyze|explain why|algorithm|complexity)\b')) AS n_reasoning,
    regexp_matches(ascii, '(?i)\b(?:prove|derive|theorem|lemma|counterexample|induction)\b') AS formal,
    regexp_matches(ascii, '(?i)```|\b(?:traceback|exception|complexity|big[- ]?o)\b') AS program,
    len(regexp_extract_all(ascii, '(?i)\b(?:exactly|at least|at most|must|only|without)\b')) AS n_constraints,
    regexp_matches(ascii, '(?i)\b(?:summari[sz]e|rewrite|translate|list|extract)\b') AS transform
  FROM plain),
features AS (
  SELECT *, n_hangul / solid AS hangul_ratio, n_digits / solid AS numeric_density, n_chars >= 8000 AS long_context,
    (n_chars >= 500)::INT + (n_chars >= 2000)::INT + 2 * (n_chars >= 8000)::INT + 2 * (n_code > 0)::INT + (n_messages >= 3)::INT
    + CASE WHEN n_maths >= 2 OR n_digits / solid >= 0.08 THEN 2 WHEN n_maths >= 1 THEN 1 ELSE 0 END
    + (n_reasoning > 0)::INT + (n_words >= 350 OR n_sentences >= 20)::INT AS complexity
  FROM counts),
priorities AS (
  SELECT *, greatest(0, rising - (n_chars < 500 AND rising <= 2 AND transform)::INT) AS priority
  FROM (SELECT *, complexity + 2 * formal::INT + 2 * program::INT + (n_constraints >= 2)::INT AS rising FROM features)),
decisions AS (
  SELECT doc_id, episode_id, tier, CASE WHEN tier = 'premium' OR (complexity >= least_points AND NOT long_context) THEN 'middle' ELSE 'light' END AS model_id
  FROM features CROSS JOIN (VALUES ('fast', 3), ('balanced', 2), ('premium', 0)) t(tier, least_points))"""

_FEATURES = _features(_DOCUMENTS)

_TIERS = """
tiers AS (SELECT * FROM (VALUES ('fast', 125, 4), ('balanced', 200, 3), ('premium', 400, 3)) t(tier, multiplier, weight)),
totals AS (
  SELECT tier, multiplier, weight, count(*) AS n_episodes, sum(o.cost_nano) AS total_nano, sum(l.cost_nano) AS light_nano, sum(o.hundredths) AS hundredths,
    sum(o.num_generations) AS n_generations, sum(o.input_tokens) AS n_input, sum(o.output_tokens) AS n_output,
    count(*) FILTER (d.model_id = 'light') AS n_light, count(*) FILTER (d.model_id = 'middle') AS n_middle, count(*) FILTER (d.model_id = 'think') AS n_think
  FROM decisions d JOIN outcomes o USING (doc_id, model_id) JOIN outcomes l ON l.doc_id = d.doc_id AND l.model_id = 'light' JOIN tiers USING (tier)
  GROUP BY ALL),
scores AS (
  SELECT *, total_nano * 100 <= light_nano * multiplier AS passed, total_nano * 10000 >= light_nano * multiplier * 95 AS near_budget,
    total_nano::HUGEINT * 1000000000000 // light_nano AS q, total_nano::HUGEINT * 1000000000000 % light_nano AS r,
    hundredths::HUGEINT * 10000000000 // n_episodes AS sq, hundredths::HUGEINT * 10000000000 % n_episodes AS sr FROM totals),
rounded AS (
  SELECT *, q + (2 * r > light_nano OR (2 * r = light_nano AND q % 2 = 1))::INT AS ratio_e12,
    sq + (2 * sr > n_episodes OR (2 * sr = n_episodes AND sq % 2 = 1))::INT AS quality_e12 FROM scores)"""

_PARTIAL = """
full_matrix AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, doc_id, model_id FROM documents CROSS JOIN (VALUES ('light'), ('middle'), ('think')) t(model_id)),
partial AS (SELECT episode_id, model_id FROM full_matrix WHERE doc_id % 17 <> 3 UNION ALL VALUES ('no such episode', 'light'), ('0', 'unknown'))"""

_RUNS = """
runs AS (
  SELECT event_id, 's' || (event_id // 15) AS submission_id, ['fast', 'balanced', 'premium'][event_id // 5 % 3 + 1] AS tier,
    CASE WHEN event_type = 'error' THEN 90000000000 ELSE CAST(floor(abs(value) * 1000) AS BIGINT) END AS elapsed_ns
  FROM events),
medians AS (
  SELECT submission_id, tier, CASE WHEN count(*) = 5 THEN list_sort(list(elapsed_ns))[3] END AS median_ns FROM runs GROUP BY ALL)"""

_HANGUL = "['증명 하라. 증명하라 유도 분석', 'Prove x^2 + 2*x + 1 = 0', 'Summarize and list only', '```python' || chr(10) || 'def f(x):' || chr(10) || '    return x;' || chr(10) || '```', 'big-O 시간  복잡도 must exactly', 'plain words']"

_LOG = """
log AS (
  SELECT user_id, ts, event_id, ['execution_failure', 'infrastructure_failure', 'execution_failure', 'valid', 'infrastructure_failure', 'fairness_violation'][event_id * 7 % 11 % 6 + 1] AS kind,
    event_id % 29 = 0 AS cleanup_pending FROM events)"""

# which row ends a log: the state it gives if all before it ran on
_FOLD = """
counted AS (
  SELECT *, row_number() OVER w AS seq, count(*) FILTER (kind IN ('valid', 'execution_failure')) OVER w AS attempts, count(*) FILTER (kind = 'infrastructure_failure') OVER w AS infrastructure
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
stops AS (
  SELECT *, CASE WHEN kind = 'valid' THEN 'valid' WHEN kind = 'fairness_violation' THEN 'disqualified' WHEN kind = 'infrastructure_failure' AND (infrastructure >= 3 OR cleanup_pending) THEN 'infrastructure_unavailable'
    WHEN attempts >= 3 THEN 'tier_score_zero' ELSE 'running' END AS state FROM counted),
ends AS (SELECT user_id, coalesce(min(seq) FILTER (state <> 'running'), max(seq)) AS seq FROM stops GROUP BY user_id),
folded AS (SELECT user_id, state, attempts, infrastructure, CASE WHEN state = 'valid' THEN seq END AS selected_seq FROM stops JOIN ends USING (user_id, seq))"""

_TOKENS = r"""
found AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-z]+|[가-힣]+|\p{Nd}+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]'), lambda t: CASE WHEN regexp_matches(t, '^\p{Nd}+$') THEN '<number>' ELSE lower(t) END) AS tokens FROM documents)"""

# FNV-1a over the UTF-8 bytes of each distinct term
_BINS = """
terms AS (
  SELECT doc_id, unnest(list_concat(list_transform(tokens, lambda t: 'w1:' || t), list_transform(range(1, len(tokens)), lambda i: 'w2:' || tokens[i] || chr(31) || tokens[i + 1]))) AS term FROM found),
hashed AS (
  SELECT term, list_reduce(list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::HUGEINT), lambda a, b: xor(a, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS v
  FROM (SELECT DISTINCT term, hex(encode(term)) AS h FROM terms)),
bins AS (
  SELECT doc_id, (v % 256)::BIGINT AS bin, sum(CASE WHEN v >= 9223372036854775808::HUGEINT THEN -1 ELSE 1 END)::BIGINT AS value FROM terms JOIN hashed USING (term) GROUP BY ALL)"""

_VECTORS = """
norms AS (SELECT doc_id, sqrt(sum(value * value)::DOUBLE) AS norm, map_from_entries(list(row(bin, value))) AS held FROM bins GROUP BY doc_id),
dense AS (
  SELECT doc_id, [ln(1 + n_chars), ln(1 + n_words), ln(1 + n_sentences), ln(2), hangul_ratio, ln(1 + n_code), ln(1 + n_maths), numeric_density, long_context::INT::DOUBLE, ln(1 + n_reasoning),
    formal::INT::DOUBLE, program::INT::DOUBLE, ln(1 + n_constraints), transform::INT::DOUBLE] AS d FROM features),
numbers AS (
  SELECT doc_id, list_transform(list_concat(d, list_transform(range(256), lambda i: coalesce(held[i], 0) / CASE WHEN norm > 0 THEN norm ELSE 1 END)), lambda x: round(x * 1000000)::BIGINT) AS n
  FROM dense LEFT JOIN norms USING (doc_id))"""

_DISTINCT = """
predictions AS (
  SELECT doc_id, (doc_id * 37 % 101) / 160.0::DOUBLE + (doc_id * 7919 % 1048576) / 17179869184.0::DOUBLE AS s0, (doc_id * 48 % 101 + 20) / 160.0::DOUBLE + ((doc_id * 7919 + 104729) % 1048576) / 17179869184.0::DOUBLE AS s1,
    (doc_id * 59 % 101 + 40) / 160.0::DOUBLE + ((doc_id * 7919 + 209458) % 1048576) / 17179869184.0::DOUBLE AS s2,
    (doc_id % 13 + 8) * 1.0::DOUBLE / 8 AS c0, (doc_id % 13 + 8) * 2.25::DOUBLE / 8 AS c1, (doc_id % 13 + 8) * 3.5::DOUBLE / 8 AS c2,
    (doc_id * 31 % 5) / 4.0::DOUBLE AS q0, (doc_id * 37 % 5) / 4.0::DOUBLE AS q1, (doc_id * 43 % 5) / 4.0::DOUBLE AS q2,
    (doc_id % 11 + 8) * 1.0::DOUBLE / 8 AS e0, (doc_id % 11 + 8) * 2.25::DOUBLE / 8 AS e1, (doc_id % 11 + 8) * 3.5::DOUBLE / 8 AS e2 FROM documents),
light AS (SELECT sum(c0) AS light, sum(e0) AS true_light, count(*) AS n FROM predictions)"""


def _least(budget: str) -> str:
    """The least penalty, a hair above the point where a row changes its model, under which the best choices fit; by trying them all."""
    return f"""
tried AS (
  SELECT DISTINCT lam * (1 + 1e-13::DOUBLE) AS lam
  FROM (SELECT unnest([0, (s1 - s0) * light / (c1 - c0), (s2 - s0) * light / (c2 - c0), (s2 - s1) * light / (c2 - c1)]) AS lam FROM predictions, light) WHERE lam >= 0),
costs AS (
  SELECT lam, sum(CASE WHEN s0 - lam * c0 / light >= greatest(s1 - lam * c1 / light, s2 - lam * c2 / light) THEN c0 WHEN s1 - lam * c1 / light >= s2 - lam * c2 / light THEN c1 ELSE c2 END) AS cost
  FROM tried, predictions, light GROUP BY lam),
least AS (SELECT min(lam) AS lam FROM costs, light WHERE cost <= light * greatest(1, {budget})),
routed AS (
  SELECT p.*, light, CASE WHEN s0 - lam * c0 / light >= greatest(s1 - lam * c1 / light, s2 - lam * c2 / light) THEN 'light' WHEN s1 - lam * c1 / light >= s2 - lam * c2 / light THEN 'middle' ELSE 'think' END AS model_id
  FROM predictions p, least, light)"""


_FILLED = """
now AS (SELECT sum(CASE model_id WHEN 'light' THEN c0 WHEN 'middle' THEN c1 ELSE c2 END) AS cost FROM routed),
fills AS (SELECT DISTINCT lam * (1 + 1e-13::DOUBLE) AS lam FROM (SELECT 0 AS lam UNION ALL SELECT (s1 - s0) * light / (c1 - c0) FROM routed WHERE model_id = 'light') WHERE lam >= 0),
filled AS (SELECT lam, sum(CASE WHEN model_id = 'light' THEN CASE WHEN s1 - s0 - lam * (c1 - c0) / light > 0 THEN c1 ELSE c0 END WHEN model_id = 'middle' THEN c1 ELSE c2 END) AS cost FROM fills, routed GROUP BY lam),
fill AS (SELECT min(lam) AS lam FROM filled, now, light WHERE filled.cost <= greatest(now.cost, light * greatest(1, 4.0::DOUBLE * 0.65::DOUBLE)))"""

_CANDIDATES = """
points AS (
  SELECT *, greatest(0, (s1 - s0) * light / (c1 - c0), (s2 - s0) * light / (c2 - c0)) AS t0, greatest(0, (s2 - s1) * light / (c2 - c1)) AS t1 FROM predictions, light),
steps AS (
  SELECT t0 AS lam, c0 AS c, q0 AS q, e0 AS e FROM points UNION ALL SELECT t1, c1, q1, e1 FROM points WHERE t1 < t0 UNION ALL SELECT t0, -c1, -q1, -e1 FROM points WHERE t1 < t0
  UNION ALL SELECT 0, c2, q2, e2 FROM points WHERE least(t0, t1) > 0 UNION ALL SELECT least(t0, t1), -c2, -q2, -e2 FROM points WHERE least(t0, t1) > 0),
curve AS (SELECT lam, sum(sum(c)) OVER (ORDER BY lam) AS cost, sum(sum(q)) OVER (ORDER BY lam) AS quality, sum(sum(e)) OVER (ORDER BY lam) AS true_cost FROM steps GROUP BY lam),
tiers AS (SELECT * FROM (VALUES ('fast', 1.25::DOUBLE), ('balanced', 2.0), ('premium', 4.0)) t(tier, multiplier)),
grid AS (SELECT tier, multiplier, 1 / multiplier + (1 - 1 / multiplier) * i / 120 AS safety FROM tiers, range(121) r(i) UNION SELECT tier, multiplier, 0.95::DOUBLE FROM tiers),
places AS (SELECT tier, multiplier, safety, min(lam) AS lam FROM grid, curve, light WHERE cost <= light * greatest(1, multiplier * safety) GROUP BY ALL),
candidates AS (
  SELECT tier, safety, true_cost <= true_light * multiplier AS passed, round(true_cost / true_light * 1e12) AS ratio_e12, CASE WHEN true_cost <= true_light * multiplier THEN round(quality / n * 1e12) ELSE 0 END AS score_e12
  FROM places JOIN curve USING (lam), light)"""


def _best(which: str, order: str) -> str:
    return f"""
SELECT tier, round(safety * 1e9)::BIGINT AS safety_e9, score_e12::BIGINT AS score_e12, ratio_e12::BIGINT AS ratio_e12, passed
FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {order}) AS i FROM candidates WHERE {which}) WHERE i = 1"""


_PREDICTIONS = """
predictions AS (
  SELECT doc_id, (doc_id * 37 % 101) / 160.0::DOUBLE AS s0, (doc_id * 48 % 101 + 20) / 160.0::DOUBLE AS s1, (doc_id * 59 % 101 + 40) / 160.0::DOUBLE AS s2,
    (doc_id % 13 + 8) * 1.0::DOUBLE / 8 AS c0, (doc_id % 13 + 8) * 2.25::DOUBLE / 8 AS c1, (doc_id % 13 + 8) * 3.5::DOUBLE / 8 AS c2 FROM documents)"""


_RIDGE = """
WITH r AS (
  SELECT vec_id % 5 AS fold, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS z, embedding[1]::DOUBLE + embedding[7]::DOUBLE + label / 10 AS y, embedding[4]::DOUBLE + embedding[10]::DOUBLE + label / 10 AS w FROM embeddings),
sets AS (SELECT * FROM range(-1, 5) t(held)),
m AS (
  SELECT held, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, avg(w) AS mw, stddev_pop(x) AS sx, stddev_pop(z) AS sz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(x, w) AS xw, covar_pop(z, w) AS zw
  FROM sets JOIN r ON r.fold <> held GROUP BY held),
s AS (
  SELECT *, n + alpha AS d, n * xz / (sx * sz) AS o, n * xy / sx AS y1, n * zy / sz AS y2, n * xw / sx AS w1, n * zw / sz AS w2 FROM m, (VALUES (0.1::DOUBLE), (1.0), (10.0), (100.0)) t(alpha)),
f AS (SELECT *, (d * y1 - o * y2) / (d * d - o * o) AS by1, (d * y2 - o * y1) / (d * d - o * o) AS by2, (d * w1 - o * w2) / (d * d - o * o) AS bw1, (d * w2 - o * w1) / (d * d - o * o) AS bw2 FROM s),
e AS (
  SELECT alpha, avg((my + by1 * (x - mx) / sx + by2 * (z - mz) / sz - y) ^ 2) + 0.05 * avg((mw + bw1 * (x - mx) / sx + bw2 * (z - mz) / sz - w) ^ 2) AS objective FROM f JOIN r ON r.fold = f.held GROUP BY alpha)
SELECT alpha, round(objective * 1e6)::BIGINT AS objective, round(my * 1e6)::BIGINT AS intercept, round(by1 * 1e6)::BIGINT AS score_1, round(by2 * 1e6)::BIGINT AS score_2, round(bw1 * 1e6)::BIGINT AS cost_1, round(bw2 * 1e6)::BIGINT AS cost_2
FROM f JOIN e USING (alpha) WHERE held = -1"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _hmac(domain: str) -> str:
    inner = "".join(f"{b ^ 0x36:02X}" for b in b"waybill audit secret".ljust(64, b"\0"))
    outer = "".join(f"{b ^ 0x5C:02X}" for b in b"waybill audit secret".ljust(64, b"\0"))
    message = f"unhex('{inner}') || encode('{domain}') || unhex(printf('%016x', doc_id)) || unhex('00') || encode(CAST(doc_id AS VARCHAR))"
    return f"sha256(unhex('{outer}') || unhex(sha256({message})))"


def _score(k: int) -> str:
    terms = f"list_sum(list_transform(embedding, lambda x, i: (x::DOUBLE - ((i - 1) % 5) / 8) / (1 + ((i - 1) % 3) / 2) * (((i - 1) * 7 + {k} * 3) % 11 - 5) / 16))"
    return f"CAST(round(({0.1 * k} + {terms}) * 1000000) AS BIGINT)"


SQL = {
    "score_tiers": _with(_OUTCOMES, _FEATURES, _TIERS) + """
SELECT tier, n_episodes, total_nano::BIGINT AS total_nano, light_nano::BIGINT AS light_nano, n_generations::BIGINT AS n_generations, n_input::BIGINT AS n_input, n_output::BIGINT AS n_output,
  n_light, n_middle, n_think, ratio_e12::BIGINT AS ratio_e12, quality_e12::BIGINT AS quality_e12, CASE WHEN passed THEN quality_e12 ELSE 0 END::BIGINT AS score_e12,
  CASE WHEN passed THEN hundredths * 10000 ELSE 0 END::BIGINT AS points_e6, passed, near_budget FROM rounded""",
    "score_final": _with(_OUTCOMES, _FEATURES, _TIERS) + """
, w AS (SELECT sum(CASE WHEN passed THEN hundredths ELSE 0 END * 10000 * weight * 100000)::HUGEINT AS p, max(n_episodes) AS n, count(*) AS n_tiers FROM rounded),
f AS (SELECT *, p // n + (2 * (p % n) > n OR (2 * (p % n) = n AND p // n % 2 = 1))::INT AS s FROM w)
SELECT p::BIGINT AS points_e12, s::BIGINT AS score_e12, regexp_replace((s // 1000000000000)::VARCHAR || '.' || lpad((s % 1000000000000)::VARCHAR, 12, '0'), '\\.?0+$', '') AS score_text, n, n_tiers FROM f""",
    "outcome_cost": _with(_OUTCOMES) + " SELECT episode_id, model_id, cost_nano::BIGINT AS cost_nano FROM outcomes",
    "model_counts": _with(_OUTCOMES, _FEATURES) + """
SELECT t.tier, m.model_id, count(d.doc_id) AS n FROM (VALUES ('fast'), ('balanced'), ('premium')) t(tier) CROSS JOIN models m LEFT JOIN decisions d ON d.tier = t.tier AND d.model_id = m.model_id GROUP BY ALL""",
    "line_cost": """
SELECT o_orderstatus, count(*) AS n, sum(l_quantity::BIGINT * 1000 + floor(l_extendedprice)::BIGINT * 4000)::BIGINT AS light_nano,
  sum(l_quantity::BIGINT * 2127 + floor(l_extendedprice)::BIGINT * 8509)::BIGINT AS middle_nano, sum(l_quantity::BIGINT * 6565 + floor(l_extendedprice)::BIGINT * 26260)::BIGINT AS think_nano
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "features": _with(_FEATURES) + """
SELECT episode_id, n_chars, 1::BIGINT AS n_messages, n_words, n_sentences::BIGINT AS n_sentences, n_code, n_maths, n_reasoning, complexity::BIGINT AS complexity, hangul_ratio, numeric_density, long_context FROM features""",
    "rule_route": _with(_FEATURES) + " SELECT episode_id, tier, model_id FROM decisions",
    "constant_route": "SELECT CAST(doc_id AS VARCHAR) AS episode_id, tier, 'light' AS model_id FROM documents CROSS JOIN (VALUES ('fast'), ('balanced'), ('premium')) t(tier)",
    "messages_text": "SELECT CAST(conv_id AS VARCHAR) AS episode_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "message_roles": "SELECT role, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role",
    "priority_groups": _with(_FEATURES) + " SELECT priority::BIGINT AS priority, count(*) AS n, sum(greatest(1, n_chars))::BIGINT AS weight FROM priorities GROUP BY priority",
    "outcome_matrix_gaps": _with(_PARTIAL) + """
SELECT episode_id, model_id, 'missing' AS problem FROM (SELECT episode_id, model_id FROM full_matrix EXCEPT SELECT * FROM partial)
UNION ALL SELECT episode_id, model_id, 'extra' FROM (SELECT * FROM partial EXCEPT SELECT episode_id, model_id FROM full_matrix)""",
    "decision_coverage": _with(_PARTIAL) + """, d AS (SELECT episode_id FROM partial WHERE model_id = 'light'), e AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id FROM documents)
SELECT episode_id, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM d) UNION ALL SELECT episode_id, 'extra' FROM (SELECT * FROM d EXCEPT SELECT * FROM e)""",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "unsorted_ids": "SELECT * FROM (SELECT doc_id, lag(CAST(doc_id AS VARCHAR)) OVER (ORDER BY doc_id) AS previous, CAST(doc_id AS VARCHAR) AS id FROM documents) WHERE previous >= id",
    "xor_violations": """
SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS prompt, CASE WHEN doc_id % 7 = 0 THEN source END AS messages FROM documents) WHERE (prompt IS NULL) = (messages IS NULL)""",
    "bad_decimals": r"""
SELECT doc_id, upper(hex(score)) AS score_hex FROM (SELECT doc_id, ['0', '0.5', '1', '00.5', '.5', '1e-1', '-0', '1.', '0.25' || chr(10), '2', '0.1234567890123456789012345678901'][doc_id % 11 + 1] AS score FROM documents)
WHERE NOT regexp_full_match(score, '(0|[1-9][0-9]{0,39})(\.[0-9]{1,30})?') OR TRY_CAST(score AS DOUBLE) > 1""",
    "unsafe_urls": r"SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '^(?i)https://[^/?#]+'))",
    "rule_table": r"""
SELECT doc_id, 'short' AS rule FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'language' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'source' FROM documents WHERE NOT regexp_full_match(source, 'src[0-9]')""",
    "targets_pivot": _with(_OUTCOMES) + """
SELECT episode_id, max(output_tokens) FILTER (m = 0) AS light, max(output_tokens) FILTER (m = 1) AS middle, max(output_tokens) FILTER (m = 2) AS think FROM outcomes GROUP BY episode_id""",
    "union_splits": "SELECT CAST(doc_id AS VARCHAR) AS episode_id, doc_id AS pos, sha256(text) AS prompt FROM documents",
    "base_plus_fetched": "SELECT CAST(doc_id AS VARCHAR) AS episode_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place FROM documents",
    "set_difference": """
SELECT k, 'left' AS side FROM (SELECT doc_id * 3 AS k FROM documents EXCEPT SELECT event_id * 5 FROM events) UNION ALL SELECT k, 'right' FROM (SELECT event_id * 5 AS k FROM events EXCEPT SELECT doc_id * 3 FROM documents)""",
    "selection_join": """
SELECT CASE WHEN b.item_id IS NULL THEN 'missing' WHEN b.item_id % 9 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM documents d LEFT JOIN benchmark b ON d.doc_id % 50 = b.item_id GROUP BY 1""",
    "sample_tables": """
SELECT (p_size % 5)::BIGINT AS regime, sha256(string_agg(line, chr(10) ORDER BY p_partkey)) AS sha256, true AS valid, length(string_agg(line, chr(10)))::BIGINT AS n_chars
FROM (SELECT *, p_partkey || chr(9) || p_name || chr(9) || p_brand AS line FROM part) GROUP BY 1""",
    "manifest": """
SELECT sha256('[' || string_agg('{"path":"' || path || '","sha256":"' || h || '"}', ',' ORDER BY path) || ']') AS manifest_sha256, count(*) AS n_files
FROM (SELECT 'pages/' || page_id AS path, sha256(html) AS h FROM pages)""",
    "generation_seeds": "SELECT p_partkey, ('0x' || sha256('220302' || chr(0) || p_brand || chr(0) || p_partkey)[1:8])::BIGINT AS seed FROM part",
    "latency_medians": _with(_RUNS) + " SELECT * FROM medians",
    "tiebreak_rank": _with(_RUNS) + """, totals AS (SELECT submission_id, sum(median_ns)::BIGINT AS total_ns FROM medians GROUP BY 1),
c AS (SELECT *, (total_ns + 500) // 1000 * 1000 AS comparison_ns FROM totals) SELECT *, rank() OVER (ORDER BY comparison_ns NULLS FIRST) AS rank FROM c""",
    "rotation": """
SELECT turn::INT AS turn, ((i - turn + n) % n)::BIGINT AS place, n_name AS submission_id FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation) CROSS JOIN range(5) t(turn)""",
    "repetitions": """
SELECT l_returnflag, l_linestatus, min(l_quantity::BIGINT) AS least, median(l_quantity::BIGINT) AS median, max(l_quantity::BIGINT) AS most, count(*) AS n FROM lineitem GROUP BY ALL""",
    "determinism": "SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS deterministic, count(*) AS n FROM orders GROUP BY 1",
    "audit_mapping": f"""
WITH t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_hmac('id-cycle')} AS a, {_hmac('order')} AS b FROM documents)
SELECT id AS original_id, coalesce(lead(id) OVER (ORDER BY a, doc_id), first_value(id) OVER (ORDER BY a, doc_id)) AS audit_id, row_number() OVER (ORDER BY b, doc_id) - 1 AS audit_pos FROM t""",
    "audit_mismatches": _with(_FEATURES) + """
SELECT episode_id AS original_id, 'a' || episode_id AS audit_id, model_id AS official_model, 'think' AS audit_model FROM decisions WHERE tier = 'balanced' AND doc_id % 10 = 4""",
    "attempt_numbers": _with(_LOG) + """
SELECT event_id, row_number() OVER w AS seq, 1 + coalesce(sum((kind IN ('execution_failure', 'valid'))::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS attempt
FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "attempt_reasons": _with(_LOG) + """
SELECT CASE WHEN kind = 'valid' THEN 'valid_submission' WHEN kind = 'fairness_violation' THEN 'fairness_review_required' WHEN cleanup_pending THEN 'operator_cleanup_pending'
  WHEN kind = 'infrastructure_failure' THEN 'operator_infrastructure_failure' WHEN event_id % 5 = 0 THEN 'wall_time_limit_exceeded' WHEN event_id % 7 = 0 THEN 'operator_limit_terminated'
  WHEN event_id % 3 = 2 THEN 'participant_nonzero_exit' ELSE 'submission_validation_failure' END AS reason, count(*) AS n FROM log GROUP BY 1""",
    "token_lists": _with(_TOKENS) + " SELECT CAST(doc_id AS VARCHAR) AS episode_id, len(tokens)::BIGINT AS n_tokens, sha256(array_to_string(tokens, ' ')) AS sha256 FROM found",
    "term_bins": _with(_TOKENS, _BINS) + " SELECT CAST(doc_id AS VARCHAR) AS episode_id, bin, value FROM bins",
    "vectors": _with(_TOKENS, _BINS, _FEATURES, _VECTORS) + " SELECT CAST(doc_id AS VARCHAR) AS episode_id, len(n)::BIGINT AS n_features, sha256(array_to_string(n, ',')) AS sha256 FROM numbers",
    "messages_route": _with(_features(_CONVERSATIONS)) + " SELECT episode_id, tier, model_id FROM decisions",
    "budget_route": "WITH RECURSIVE " + _FEATURES + """,
groups AS (SELECT priority, sum(greatest(1, n_chars))::HUGEINT AS weight FROM priorities GROUP BY priority),
ordered AS (SELECT *, row_number() OVER (ORDER BY priority DESC) AS i FROM groups),
caps AS (SELECT *, (SELECT sum(weight) FROM groups) AS total FROM (VALUES ('fast', 1062500, 5), ('balanced', 1700000, 2), ('premium', 3400000, 0)) t(tier, cap, least)),
taken AS (
  SELECT tier, cap, least, total, 0::BIGINT AS i, total * 1000000 AS cost, NULL::INT AS priority FROM caps
  UNION ALL
  SELECT tier, cap, least, total, o.i, CASE WHEN o.priority >= least AND cost + weight * 1127250 <= total * cap THEN cost + weight * 1127250 ELSE cost END,
    CASE WHEN o.priority >= least AND cost + weight * 1127250 <= total * cap THEN o.priority END FROM taken t JOIN ordered o ON o.i = t.i + 1)
SELECT c.tier, CASE WHEN t.priority IS NOT NULL THEN 'middle' ELSE 'light' END AS model_id, count(*) AS n
FROM priorities p CROSS JOIN caps c LEFT JOIN taken t ON t.tier = c.tier AND t.priority = p.priority GROUP BY ALL""",
    "whole_log_numbers": _with(_LOG) + """
SELECT event_id, row_number() OVER w AS seq, 1 + coalesce(sum((kind IN ('execution_failure', 'valid'))::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS attempt
FROM log WINDOW w AS (ORDER BY ts, event_id)""",
    "whole_log_fold": _with(_LOG.replace("log AS", "whole AS"), """
log AS (SELECT 'r' || (event_id % 3) AS user_id, ts, event_id, CASE WHEN event_id % 3 = 0 OR event_id % 1009 > 0 THEN 'pending' ELSE kind END AS kind, false AS cleanup_pending FROM whole)""", _FOLD) + """
SELECT user_id AS run, state, attempts, infrastructure, selected_seq FROM folded""",
    "price_median": """
WITH p AS (SELECT round(l_extendedprice * 100)::BIGINT AS c, row_number() OVER (ORDER BY round(l_extendedprice * 100)) AS r, count(*) OVER () AS n FROM lineitem)
SELECT max(n) AS n, min(c) AS least, max(c) FILTER (r = (n - 1) // 2 + 1) AS low, max(c) FILTER (r = n // 2 + 1) AS high, max(c) AS most FROM p""",
    "retry_fold": _with(_LOG, _FOLD) + " SELECT user_id, state, attempts, infrastructure, selected_seq FROM folded",
    "tier_status": _with(_LOG, _FOLD) + """, a AS (
  SELECT state, CASE user_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'review_required' WHEN 2 THEN 'inconclusive_infrastructure' END AS audit FROM folded WHERE state <> 'running'),
s AS (
  SELECT *, CASE WHEN state <> 'valid' THEN state WHEN audit = 'review_required' THEN audit WHEN audit = 'inconclusive_infrastructure' THEN 'audit_inconclusive_infrastructure' WHEN audit IS NULL THEN 'audit_skipped' ELSE 'valid' END AS status FROM a)
SELECT state, audit, status, count(*) AS n, CASE WHEN status IN ('infrastructure_unavailable', 'audit_inconclusive_infrastructure') THEN 4 WHEN status IN ('review_required', 'audit_skipped') THEN 5 ELSE 0 END::BIGINT AS exit_code FROM s GROUP BY ALL""",
    "lagrangian_select": _with(_DISTINCT, _least("2.0::DOUBLE * 0.9::DOUBLE")) + " SELECT doc_id, model_id FROM routed",
    "filled_select": _with(_DISTINCT, _least("1.2::DOUBLE * 0.9::DOUBLE"), _FILLED) + """
SELECT doc_id, CASE WHEN model_id = 'light' AND s1 - s0 - fill.lam * (c1 - c0) / light > 0 THEN 'middle' ELSE model_id END AS model_id FROM routed, fill""",
    "safety_selection": _with(_DISTINCT, _CANDIDATES) + _best("safety <> 0.95::DOUBLE", "score_e12 DESC, ratio_e12, safety"),
    "safety_calibration": _with(_DISTINCT, _CANDIDATES) + _best("safety <> 0.95::DOUBLE AND passed", "score_e12 DESC, ratio_e12, safety"),
    "safety_validation": _with(_DISTINCT, _CANDIDATES) + _best("safety <= 0.95::DOUBLE AND passed", "safety DESC"),
    "ridge_pair": _RIDGE,
    "hangul_markers": _with(_features("SELECT doc_id, CAST(doc_id AS VARCHAR) AS episode_id, 1 AS n_messages, " + _HANGUL + "[doc_id % 6 + 1] || chr(10) || text AS text FROM documents")) + """
SELECT episode_id, n_words::BIGINT AS n_words, n_code::BIGINT AS n_code, n_maths::BIGINT AS n_maths, (n_reasoning + [3, 0, 0, 0, 1, 0][doc_id % 6 + 1])::BIGINT AS n_reasoning, round(n_hangul / solid * 1000000)::BIGINT AS hangul_e6 FROM counts""",

    "linear_scores": f"SELECT vec_id, {_score(0)} AS score_light, {_score(1)} AS score_middle, {_score(2)} AS score_think FROM embeddings",
    "argmax_model": f"""
WITH s AS (SELECT vec_id, {_score(0)} AS a, {_score(1)} AS b, {_score(2)} AS c FROM embeddings)
SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'light' WHEN b >= c THEN 'middle' ELSE 'think' END AS model_id FROM s""",
    "penalised_choice": _with(_PREDICTIONS) + """, v AS (SELECT doc_id, s0 - 0.0625::DOUBLE * c0 AS a, s1 - 0.0625::DOUBLE * c1 AS b, s2 - 0.0625::DOUBLE * c2 AS c FROM predictions)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'light' WHEN b >= c THEN 'middle' ELSE 'think' END AS model_id FROM v""",
}
