"""DuckDB SQL of the registered corpus and experiment queries."""

from __future__ import annotations

from . import queries_io

SPLITS = {"train": 80, "valid": 10, "test": 10}
BLOCK, SEED, DIM = 256, 17, 64

_TOKENS = r"(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) + 1)::BIGINT"
_FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (i * 8 + 1)::INTEGER, 8))::BIGINT)), lambda a, x: (a * 4294967296 + x) % 100)"
_CAND = f"""
cand AS (SELECT doc_id AS source_row, text, sha256(text) AS text_sha256, {_TOKENS} AS tokens FROM documents WHERE regexp_matches(text, '\\S')),
hashed AS (SELECT *, sha256('{SEED}:' || text_sha256) AS h FROM cand),
splits AS (SELECT *, CASE WHEN {_FOLD} < 80 THEN 'train' WHEN {_FOLD} < 90 THEN 'valid' ELSE 'test' END AS split FROM hashed),
firsts AS (SELECT * FROM splits QUALIFY row_number() OVER (PARTITION BY text_sha256 ORDER BY source_row) = 1),
summed AS (SELECT *, (sum(tokens) OVER (PARTITION BY split ORDER BY source_row) - tokens)::BIGINT AS before_tokens,
  CASE split WHEN 'train' THEN 80 ELSE 10 END * {BLOCK} AS goal FROM firsts),
admitted AS (SELECT * FROM summed WHERE before_tokens < goal),
spans AS (SELECT *, before_tokens AS token_start, least(before_tokens + tokens, goal)::BIGINT AS token_end, before_tokens + tokens > goal AS document_tail_truncated FROM admitted)"""

_FULL = _CAND.replace("% 100)", "% 20480)").replace("< 80 THEN", "< 16384 THEN").replace("< 90 THEN", "< 18432 THEN").replace(f"THEN 80 ELSE 10 END * {BLOCK}", "THEN 16384 ELSE 2048 END * 2048")

_PROB = f"""
logits AS (SELECT vec_id, label, (embedding::DOUBLE[])[1:{DIM}] AS z FROM embeddings),
exps AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM logits),
probs AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM exps),
cells AS (SELECT vec_id, label, unnest(range({DIM}))::INTEGER AS expert, unnest(p) AS probability FROM probs),
top2 AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, expert) <= 2)"""

_CALLS = "calls AS (SELECT event_type AS layer, (user_id % 12)::INTEGER AS expert, count(*) AS calls FROM events GROUP BY ALL)"
_RUNS = "runs AS (SELECT event_type AS method, (user_id % 5)::INTEGER AS seed, floor(epoch(ts) / 86400)::BIGINT AS day, event_id, value FROM events)"
_CURVE = f"{_RUNS}, curve AS (SELECT method, day, avg(value) AS y FROM runs GROUP BY ALL)"
_BLOCKS = f"{_RUNS}, blocks AS (SELECT method, seed, event_id % 64 AS block_id, avg(value) AS nll FROM runs GROUP BY ALL)"
_DIMS = "dims AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
_POINTS = """
e AS (SELECT (vec_id % 5)::INTEGER AS layer, (vec_id % 60)::INTEGER AS expert, unnest(range(64))::INTEGER AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
g AS (SELECT layer, expert, dim, count(*) AS n, avg(x) AS mu FROM e GROUP BY ALL),
points AS (SELECT layer, expert, max(n) AS traffic, list(mu ORDER BY dim) AS v FROM g GROUP BY ALL)"""
_TWO = _FULL.split("summed AS")[0] + """counted AS (SELECT *, tokens AS words, (ceil(length(text) / 4.0) + 1)::BIGINT AS characters, CASE split WHEN 'train' THEN 16384 ELSE 2048 END * 2048 AS goal FROM firsts),
sums AS (SELECT *, (sum(words) OVER w - words)::BIGINT AS before_words, (sum(characters) OVER w - characters)::BIGINT AS before_characters FROM counted WINDOW w AS (PARTITION BY split ORDER BY source_row)),
both_ AS (SELECT * FROM sums WHERE least(before_words, before_characters) < goal)"""
_GRID = f"""{_RUNS}, cells AS (SELECT method, unnest(range(5))::INTEGER AS seed FROM (SELECT DISTINCT method FROM runs)), boxes AS (SELECT method, seed, unnest(range(64)) AS block_id FROM cells),
filled AS (SELECT method, seed, event_id % 64 AS block_id, sum(value) AS s FROM runs GROUP BY ALL),
grid AS (SELECT method, seed, block_id, coalesce(s, 0) AS nll FROM boxes LEFT JOIN filled USING (method, seed, block_id))"""
_SCORED = f"{_CALLS}, copies AS (SELECT *, unnest([1, 2, 3]) AS copy FROM calls), scored AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY calls DESC, expert, copy)::INTEGER AS place, expert AS parent FROM copies QUALIFY place <= 12)"
_STATUS = f"""{_RUNS}, n AS (SELECT 'a_' || method || '_seed' || seed::VARCHAR AS run, count(*) AS n, avg(value) AS v FROM runs GROUP BY method, seed),
jobs AS (SELECT 'a_' || method || '_seed' || s::VARCHAR AS run FROM (SELECT DISTINCT method FROM runs), (SELECT unnest(range(6)) AS s)),
j AS (SELECT run, CASE WHEN n % 3 = 0 THEN 100 ELSE greatest(CASE WHEN n % 5 < 3 THEN n % 110 ELSE 0 END, CASE WHEN n % 2 = 0 THEN n % 90 ELSE 0 END) END AS step0, n, v FROM jobs LEFT JOIN n USING (run)),
status AS (SELECT run, coalesce(step0, 0)::BIGINT AS step, 100::BIGINT AS total_steps, CASE WHEN n % 2 = 0 THEN n % 90 END AS checkpoint_step, coalesce(CASE WHEN n % 3 = 0 THEN 4 ELSE n % 4 END, 0)::BIGINT AS tasks_done, 4::BIGINT AS tasks_total,
  CASE WHEN n % 3 = 0 THEN round(v, 6) END AS test_ppl,
  CASE WHEN n % 3 = 0 THEN 'complete' WHEN n % 7 = 0 THEN 'tasks/finalization' WHEN coalesce(step0, 0) >= 100 THEN 'final evaluation' WHEN coalesce(step0, 0) > 0 THEN 'training'
    WHEN n % 4 = 1 THEN 'warm-start' WHEN n IS NOT NULL THEN 'initialization/evaluation' ELSE 'pending' END AS stage FROM j)"""
_PLACES = "SELECT layer, place::INTEGER AS place, expert AS parent FROM (SELECT *, unnest(range(0, 31)) * n + r AS place0 FROM {0}), LATERAL (SELECT place0 + 1 AS place) WHERE place0 < 30"



def _refined(slot: str, own: str, other: str, state: str) -> str:
    """The experts that a slot is drawn anew to: f<slot> with vec_id and new."""
    return f"""
g{slot} AS (SELECT r.vec_id, expert, p, {own} AS e, {other} AS o FROM r JOIN {state} USING (vec_id) WHERE expert // 4 = {own} // 4),
m{slot} AS (SELECT vec_id, any_value(e) AS e, sum(p) AS mass, max(p) FILTER (WHERE expert = e) AS own, coalesce(max(p) FILTER (WHERE expert <> e), 0) AS rest, sum(CASE WHEN expert = e OR expert <> o THEN p ELSE 0 END) AS free FROM g{slot} GROUP BY vec_id),
c{slot} AS (SELECT g{slot}.vec_id, expert, sum(CASE WHEN expert = g{slot}.e OR expert <> o THEN p ELSE 0 END) OVER (PARTITION BY g{slot}.vec_id ORDER BY expert) AS upto FROM g{slot}),
f{slot} AS (SELECT c{slot}.vec_id, min(expert) AS new FROM c{slot} JOIN m{slot} USING (vec_id) JOIN u ON u.vec_id = c{slot}.vec_id AND u.slot = {slot} WHERE (own - rest) / mass < 0.2 AND chance < 0.5 AND upto > pick * free GROUP BY c{slot}.vec_id)"""


ORACLE = {
    "blank_filter": r"SELECT doc_id AS source_row, length(text)::BIGINT AS chars FROM documents WHERE regexp_matches(text, '\S')",
    "source_identifier": "SELECT doc_id, CASE WHEN doc_id IS NULL OR doc_id = 0 THEN '' ELSE doc_id::VARCHAR END AS source_id FROM documents",
    "exact_dedup": f"WITH {_CAND} SELECT source_row, text_sha256 FROM firsts",
    "hash_split": f"WITH {_CAND} SELECT source_row, split FROM splits",
    "split_counts": f"WITH {_CAND} SELECT split, count(*)::BIGINT AS documents FROM splits GROUP BY split",
    "token_counts": f"SELECT doc_id AS source_row, {_TOKENS} AS tokens FROM documents",
    "quota_admission": f"WITH {_CAND} SELECT source_row, split, tokens, before_tokens FROM admitted",
    "pack_spans": f"WITH {_CAND} SELECT split, source_row, token_start, token_end, document_tail_truncated FROM spans",
    "pack_blocks": f"""WITH {_CAND},
t AS (SELECT split, token_start, list_concat(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), ['<eos>'])[1:(token_end - token_start)] AS ts FROM spans),
u AS (SELECT split, token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t)
SELECT split, (pos // {BLOCK})::BIGINT AS block_id, count(*)::BIGINT AS tokens, sha256(string_agg(token, ' ' ORDER BY pos)) AS content_sha256 FROM u GROUP BY ALL""",
    "published_corpus": f"""WITH {_CAND},
t AS (SELECT split, token_start, list_concat(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), ['<eos>'])[1:(token_end - token_start)] AS ts FROM spans),
u AS (SELECT split, token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t),
b AS (SELECT split, (pos // {BLOCK})::BIGINT AS block_id, sha256(string_agg(token, ' ' ORDER BY pos)) AS content_sha256 FROM u GROUP BY ALL),
c AS (SELECT * FROM b WHERE split = 'train' ORDER BY sha256('17:' || block_id::VARCHAR), block_id LIMIT 16)
SELECT split AS part, block_id, content_sha256 FROM b UNION ALL SELECT 'calibration', block_id, content_sha256 FROM c""",
    "corpus_counters": f"""WITH {_CAND}, f AS (SELECT split, min(source_row) FILTER (WHERE before_tokens + tokens >= goal) AS fill_row, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM admitted GROUP BY split),
g AS (SELECT s.split, f.fill_row, coalesce(documents, 0)::BIGINT AS documents, coalesce(tokens, 0)::BIGINT AS tokens FROM (VALUES ('train'), ('valid'), ('test')) s(split) LEFT JOIN f USING (split)),
st AS (SELECT CASE WHEN count(fill_row) = 3 THEN max(fill_row) ELSE 9223372036854775807 END AS stop FROM g),
d AS (SELECT doc_id, regexp_matches(text, '\\S') AS holds, sha256(text) AS h FROM documents, st WHERE doc_id <= stop),
w AS (SELECT count(*)::BIGINT AS rows_read, count(*) FILTER (WHERE NOT holds)::BIGINT AS empty_skipped, count(*) FILTER (WHERE holds AND EXISTS (SELECT 1 FROM admitted a WHERE a.text_sha256 = d.h AND a.source_row < d.doc_id))::BIGINT AS duplicates_skipped FROM d)
SELECT g.*, w.* FROM g, w""",
    "two_key_dedup": """WITH RECURSIVE u AS (SELECT doc_id * 3 AS source_row, sha256(text) AS h, 'i' || (doc_id % 701)::VARCHAR AS i FROM documents WHERE regexp_matches(text, '\\S')
  UNION ALL SELECT item_id * 3 + 1, sha256(text), 'i' || (item_id * 7)::VARCHAR FROM benchmark WHERE regexp_matches(text, '\\S')
  UNION ALL SELECT (conv_id * 64 + turn) * 3 + 2, sha256(text), '' FROM conversations WHERE regexp_matches(text, '\\S')),
r AS (SELECT *, row_number() OVER (ORDER BY source_row) AS k FROM u),
walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS hs, []::VARCHAR[] AS ids, false AS keep
  UNION ALL SELECT r.k, CASE WHEN ok THEN list_append(hs, h) ELSE hs END, CASE WHEN ok AND i <> '' THEN list_append(ids, i) ELSE ids END, ok
  FROM (SELECT walk.hs, walk.ids, r.k, r.h, r.i, NOT list_contains(walk.hs, r.h) AND (r.i = '' OR NOT list_contains(walk.ids, r.i)) AS ok FROM walk JOIN r ON r.k = walk.k + 1) r)
SELECT source_row, h AS text_sha256, i AS source_id FROM r JOIN walk USING (k) WHERE keep""",
    "two_tokenizer_quota": f"WITH {_TWO} SELECT source_row, split, words, characters, before_words, before_characters FROM both_",
    "raw_document_fields": f"WITH {_TWO} SELECT text_sha256, CASE WHEN source_row = 0 THEN '' ELSE source_row::VARCHAR END AS source_id, 'doc/' || source_row::VARCHAR AS url, source_row, split, words, characters, length(text)::BIGINT AS chars FROM both_",
    "packed_ids": f"""WITH {_FULL},
t AS (SELECT split, token_start, list_concat(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), lambda w: ('0x' || substr(sha256(w), 1, 7))::INTEGER), [0])[1:(token_end - token_start)] AS ts FROM spans),
u AS (SELECT split, token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS id FROM t)
SELECT split, (pos // 2048)::BIGINT AS block_id, count(*)::BIGINT AS tokens, min(id) AS low, max(id) AS high, sum(id)::BIGINT AS total FROM u GROUP BY ALL""",
    "npy_block_scan": f"""WITH {_FULL},
t AS (SELECT split, token_start, list_concat(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), lambda w: ('0x' || substr(sha256(w), 1, 7))::INTEGER), [0])[1:(token_end - token_start)] AS ts FROM spans),
u AS (SELECT split, token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS id FROM t)
SELECT block_id, low, high, total FROM (SELECT (pos // 2048)::BIGINT AS block_id, count(*) AS n, min(id) AS low, max(id) AS high, sum(id)::BIGINT AS total FROM u WHERE split = 'train' GROUP BY ALL) WHERE n = 2048 AND block_id >= 2""",
    "json_line_numbers": r"SELECT doc_id::VARCHAR AS id, sha256(text) AS text_sha256, true AS complete FROM documents WHERE regexp_matches(text, '\S')",
    "calibration_blocks": f"""WITH {_FULL},
t AS (SELECT token_start, list_concat(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), ['<eos>'])[1:(token_end - token_start)] AS ts FROM spans WHERE split = 'train'),
u AS (SELECT token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t),
b AS (SELECT (pos // 2048)::BIGINT AS block_id, sha256(string_agg(token, ' ' ORDER BY pos)) AS content_sha256 FROM u GROUP BY ALL),
c AS (SELECT * FROM b ORDER BY sha256('3:' || block_id::VARCHAR), block_id LIMIT 16)
SELECT (row_number() OVER (ORDER BY block_id) - 1)::INTEGER AS pos, block_id, content_sha256 FROM c""",
    "subset_blocks": f"WITH {_FULL}, n AS (SELECT max(token_end - 1) // 2048 AS last FROM spans WHERE split = 'train'), b AS (SELECT unnest(range(last + 1)) AS block_id FROM n) SELECT block_id::BIGINT AS block_id, 'first 8' AS subset FROM b WHERE block_id < 8",
    "local_shuffle": f"WITH t AS (SELECT doc_id, sha256('17:' || doc_id::VARCHAR) AS h FROM documents) SELECT doc_id AS source_row, doc_id + {_FOLD.replace('% 100)', '% 10000)')} AS draw FROM t",
    "random_projection": f"""WITH m AS (SELECT r, j, sha256(r::VARCHAR || ':' || j::VARCHAR) AS h FROM (SELECT unnest(range(64)) AS r), (SELECT unnest(range(4)) AS j)),
w AS (SELECT r, j, {_FOLD.replace('% 100)', '% 2001)')}::DOUBLE / 1000 - 1 AS w FROM m),
x AS (SELECT vec_id, unnest(range(64)) AS r, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, j::INTEGER AS dim, round(sum(x * w), 6) AS value FROM x JOIN w USING (r) GROUP BY vec_id, j""",
    "full_quota_admission": f"WITH {_FULL} SELECT source_row, split, tokens, before_tokens FROM admitted",
    "capped_admission": f"WITH {_FULL.replace('FROM documents WHERE', 'FROM documents WHERE doc_id < 500 AND')} SELECT source_row, split, tokens, before_tokens FROM admitted",
    "full_pack_spans": f"WITH {_FULL} SELECT split, source_row, token_start, token_end, document_tail_truncated FROM spans",
    "full_pack_blocks": f"""WITH {_FULL},
t AS (SELECT split, token_start, list_concat(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), ['<eos>'])[1:(token_end - token_start)] AS ts FROM spans),
u AS (SELECT split, token_start + unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t)
SELECT split, (pos // 2048)::BIGINT AS block_id, count(*)::BIGINT AS tokens, sha256(string_agg(token, ' ' ORDER BY pos)) AS content_sha256 FROM u GROUP BY ALL""",
    "distance_table": f"WITH {_POINTS} SELECT a.layer, a.expert AS a, b.expert AS b, round(list_distance(a.v, b.v) ** 2, 6) AS distance FROM points a JOIN points b ON a.layer = b.layer AND a.expert < b.expert",
    "distance_ratio": f"""WITH {_POINTS}, p AS (SELECT a.layer, a.traffic % 2 = b.traffic % 2 AS same, list_distance(a.v, b.v) ** 2 AS x FROM points a JOIN points b ON a.layer = b.layer AND a.expert < b.expert)
SELECT layer, round(avg(x) FILTER (WHERE same), 6) AS within, round(avg(x), 6) AS overall, round(avg(x) FILTER (WHERE same) / avg(x), 6) AS ratio FROM p GROUP BY layer""",
    "permutation_null": f"""WITH {_POINTS}, pairs AS (SELECT a.layer, a.expert AS a, b.expert AS b, list_distance(a.v, b.v) ** 2 AS x FROM points a JOIN points b ON a.layer = b.layer AND a.expert < b.expert),
reps AS (SELECT layer, expert, expert % 3 AS label, unnest(range(100)) AS rep FROM points),
places AS (SELECT *, row_number() OVER (PARTITION BY layer, rep ORDER BY expert) AS i, row_number() OVER (PARTITION BY layer, rep ORDER BY sha256('2:' || rep::VARCHAR || ':' || expert::VARCHAR), expert) AS j FROM reps),
dealt AS (SELECT k.layer, k.rep, k.expert, l.label FROM places k JOIN places l ON l.layer = k.layer AND l.rep = k.rep AND l.j = k.i),
drawn AS (SELECT p.layer, s.rep, avg(x) FILTER (WHERE s.label = t.label) / avg(x) AS r FROM pairs p JOIN dealt s ON s.layer = p.layer AND s.expert = p.a JOIN dealt t ON t.layer = p.layer AND t.rep = s.rep AND t.expert = p.b GROUP BY ALL),
own AS (SELECT layer, avg(x) FILTER (WHERE a % 3 = b % 3) / avg(x) AS ratio FROM pairs GROUP BY layer)
SELECT layer, round(any_value(ratio), 6) AS ratio, round(avg(r), 6) AS null_mean, round(quantile_cont(r, 0.05), 6) AS null_q05, round(quantile_cont(r, 0.95), 6) AS null_q95 FROM own JOIN drawn USING (layer) GROUP BY layer""",
    "bootstrap_ci": f"""WITH {_GRID}, delta AS (SELECT 'click - ' || b.method AS contrast, seed, block_id, a.nll - b.nll AS delta FROM grid a JOIN grid b USING (seed, block_id) WHERE a.method = 'click' AND b.method <> 'click'),
g AS (SELECT contrast, seed, block_id // 32 AS grp, avg(delta) AS x FROM delta GROUP BY ALL),
s AS (SELECT contrast, seed AS id, 's' AS kind FROM g GROUP BY ALL UNION ALL SELECT contrast, grp, 'g' FROM g GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY contrast, kind ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY contrast, kind) AS n FROM s),
r AS (SELECT contrast, kind, rep, ('0x' || left(sha256('9:' || kind || ':' || rep::VARCHAR || ':' || k::VARCHAR), 15))::BIGINT % n AS k FROM (SELECT *, unnest(range(2000)) AS rep FROM n)),
m AS (SELECT r.contrast, r.kind, rep, n.id, count(*) AS times FROM r JOIN n ON n.contrast = r.contrast AND n.kind = r.kind AND n.k = r.k GROUP BY ALL),
means AS (SELECT g.contrast, a.rep, sum(a.times * b.times * x) / sum(a.times * b.times) AS y FROM m a JOIN m b ON a.contrast = b.contrast AND a.rep = b.rep JOIN g ON g.contrast = a.contrast AND g.seed = a.id AND g.grp = b.id WHERE a.kind = 's' AND b.kind = 'g' GROUP BY ALL)
SELECT contrast, round(any_value(mean), 6) AS mean, round(quantile_cont(y, 0.025), 6) AS low, round(quantile_cont(y, 0.975), 6) AS high FROM means JOIN (SELECT contrast, avg(x) AS mean FROM g GROUP BY contrast) USING (contrast) GROUP BY contrast""",
    "shared_expert_totals": f"WITH {_PROB}, n AS (SELECT label, count(DISTINCT vec_id)::BIGINT AS t, count(*)::BIGINT AS calls FROM top2 GROUP BY label) SELECT label, calls, 2 * t AS expected, calls = 2 * t AS exact, CASE WHEN length(label::VARCHAR) % 2 = 0 THEN t END AS shared_calls FROM n",
    "confidence_refinement": f"""WITH {_PROB}, r AS (SELECT vec_id, expert, probability AS p, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, expert) - 1 AS rank FROM cells),
s0 AS (SELECT vec_id, max(expert) FILTER (WHERE rank = 0) AS e0, max(expert) FILTER (WHERE rank = 1) AS e1 FROM r GROUP BY vec_id),
u AS (SELECT vec_id, slot, ('0x' || left(sha256('11:' || vec_id::VARCHAR || ':' || slot::VARCHAR || ':0'), 13))::BIGINT / 4503599627370496.0::DOUBLE AS pick, ('0x' || left(sha256('11:' || vec_id::VARCHAR || ':' || slot::VARCHAR || ':1'), 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance FROM s0, (VALUES (0), (1)) v(slot)),
{_refined('0', 'e0', 'e1', 's0')},
n0 AS (SELECT s0.vec_id, coalesce(new, e0) AS e0, e1 FROM s0 LEFT JOIN f0 USING (vec_id)),
{_refined('1', 'e1', 'e0', 'n0')},
n1 AS (SELECT n0.vec_id, e0, coalesce(new, e1) AS e1 FROM n0 LEFT JOIN f1 USING (vec_id))
SELECT vec_id AS token, 0 AS slot, e0 AS expert FROM n1 UNION ALL SELECT vec_id, 1, e1 FROM n1""",
    "calibration_sample": "SELECT doc_id, sha256('3:' || doc_id::VARCHAR) AS draw FROM documents ORDER BY draw, doc_id LIMIT 64",
    "fit_check_partition": "WITH s AS (SELECT doc_id, sha256('3:' || doc_id::VARCHAR) AS draw FROM documents ORDER BY draw, doc_id LIMIT 64) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY draw, doc_id) <= 48 THEN 'fit' ELSE 'check' END AS phase FROM s",
    "list_digests": "SELECT conv_id, sha256('[' || string_agg(turn::VARCHAR, ', ' ORDER BY turn) || ']') AS digest FROM conversations GROUP BY conv_id",
    "vector_moments": f"WITH {_DIMS} SELECT label, dim, count(*)::BIGINT AS n, round(avg(x), 6) AS mu, round(stddev_pop(x), 6) AS sigma FROM dims GROUP BY label, dim",
    "centroid_distance": f"WITH {_DIMS}, c AS (SELECT label, dim, avg(x) AS mu FROM dims GROUP BY label, dim) SELECT vec_id, round(sum((x - mu) * (x - mu)), 6) AS distance FROM dims JOIN c USING (label, dim) GROUP BY vec_id",
    "pair_distance_ratio": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label = b.label AS same, list_distance(a.v, b.v) ** 2 AS d FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT round(avg(d) FILTER (WHERE same), 6) AS within, round(avg(d), 6) AS overall, round(avg(d) FILTER (WHERE same) / avg(d), 6) AS ratio FROM p""",
    "energy_scaling": f"WITH {_DIMS}, m AS (SELECT dim, avg(x) AS mu, var_pop(x) AS v FROM dims GROUP BY dim), t AS (SELECT sum(v) AS e FROM m) SELECT vec_id, round(sum((x - mu) ** 2) / max(e), 5) AS energy FROM dims JOIN m USING (dim), t GROUP BY vec_id",
    "softmax_prob": f"WITH {_PROB} SELECT vec_id, expert, round(probability, 6) AS probability FROM cells",
    "topk_per_row": f"WITH {_PROB} SELECT vec_id, expert, round(probability, 6) AS probability FROM top2",
    "routing_load_stats": f"""WITH {_CALLS}, f AS (SELECT layer, expert, coalesce(calls, 0) AS c FROM (SELECT DISTINCT layer FROM calls) CROSS JOIN (SELECT unnest(range(16))::INTEGER AS expert) LEFT JOIN calls USING (layer, expert)),
s AS (SELECT layer, expert, c, sum(c) OVER (PARTITION BY layer) AS t FROM f)
SELECT layer, round(stddev_pop(c) / avg(c), 6) AS cv, round(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) ELSE 0 END), 6) AS entropy,
  round(exp(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) ELSE 0 END)), 6) AS effective, count(*) FILTER (WHERE c > 0)::BIGINT AS observed FROM s GROUP BY layer""",
    "usage_shares": f"WITH {_CALLS} SELECT layer, expert, calls::BIGINT AS calls, round(calls / sum(calls) OVER (PARTITION BY layer), 6) AS share, round(calls * 2 / sum(calls) OVER (PARTITION BY layer), 6) AS token_share FROM calls",
    "assignment_share": f"WITH {_CALLS} SELECT round(avg(s), 6) AS new_assignment_share FROM (SELECT layer, sum(CASE WHEN expert >= 8 THEN calls ELSE 0 END) / sum(calls) AS s FROM calls GROUP BY layer)",
    "balance_index": f"""WITH {_PROB}, f AS (SELECT label, expert, count(*) AS n FROM top2 GROUP BY ALL), m AS (SELECT label, expert, avg(probability) AS p FROM cells GROUP BY ALL),
s AS (SELECT label, expert, n / sum(n) OVER (PARTITION BY label) AS share FROM f) SELECT label, round({DIM} * sum(share * p), 6) AS balance FROM s JOIN m USING (label, expert) GROUP BY label""",
    "largest_remainder": f"""WITH {_CALLS}, q AS (SELECT *, calls * 32.0::DOUBLE / sum(calls) OVER (PARTITION BY layer) AS q FROM calls),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY q - floor(q) DESC, expert) AS r, 32 - sum(floor(q)) OVER (PARTITION BY layer) AS rest FROM q)
SELECT layer, expert, (floor(q) + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS seats FROM r""",
    "greedy_cap3": f"WITH {_CALLS}, c AS (SELECT *, unnest([1, 2, 3]) AS copy FROM calls) SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY calls DESC, expert, copy)::INTEGER AS place, expert AS parent FROM c QUALIFY place <= 20",
    "traffic_cycle": f"WITH {_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY calls DESC, expert) - 1 AS r, count(*) OVER (PARTITION BY layer) AS n FROM calls) {_PLACES.format('o')}",
    "random_cycle": f"WITH {_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY sha256('5:' || layer || ':' || expert::VARCHAR)) - 1 AS r, count(*) OVER (PARTITION BY layer) AS n FROM calls) {_PLACES.format('o')}",
    "adjusted_rand": """WITH t AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY a)) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY b)) AS j, (SELECT sum(n) FROM t) AS n)
SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 9) AS adjusted_rand FROM s""",
    "canonical_labels": "WITH f AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label), r AS (SELECT label, (dense_rank() OVER (ORDER BY first) - 1)::INTEGER AS canonical FROM f) SELECT vec_id, canonical FROM embeddings JOIN r USING (label)",
    "parent_coverage_ratio": f"""WITH {_POINTS}, d AS (SELECT a.layer, a.expert, any_value(a.traffic) AS w, min(list_distance(a.v, b.v) ** 2) AS d FROM points a JOIN points b ON a.layer = b.layer AND b.expert < 20 GROUP BY ALL),
c AS (SELECT layer, sum(w * d) / sum(w) AS coverage FROM d GROUP BY layer),
m AS (SELECT a.layer, avg(list_distance(a.v, b.v) ** 2) AS a FROM points a JOIN points b ON a.layer = b.layer AND a.expert < b.expert GROUP BY a.layer)
SELECT layer, round(coverage, 6) AS coverage, round(CASE WHEN a > 1e-20 THEN coverage / a END, 6) AS ratio FROM c JOIN m USING (layer)""",
    "method_summary": f"WITH {_RUNS}, r AS (SELECT method, seed, avg(value) AS v FROM runs GROUP BY ALL) SELECT method, count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM r GROUP BY method",
    "completeness": f"WITH {_RUNS}, m AS (SELECT DISTINCT method FROM runs), x AS (SELECT method, unnest(range(7))::INTEGER AS seed FROM m) SELECT method, seed, EXISTS (SELECT 1 FROM runs r WHERE r.method = x.method AND r.seed = x.seed) AS finished FROM x",
    "task_average": "WITH p AS (SELECT source, doc_id % 3 AS task, avg(quality) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) SELECT source, count(score)::BIGINT AS measured, round(CASE WHEN count(score) = 3 THEN 100 * avg(score) END, 6) AS average FROM p GROUP BY source",
    "recovery_curve": f"WITH {_CURVE} SELECT method, day, round(y, 6) AS y FROM curve",
    "excess_auc": f"""WITH {_CURVE}, l AS (SELECT method, day, greatest(0, y - 50) AS e, lag(greatest(0, y - 50)) OVER w AS pe, lag(day) OVER w AS pd FROM curve WINDOW w AS (PARTITION BY method ORDER BY day))
SELECT method, round(sum((day - pd) * (e + pe) / 2), 4) AS auc FROM l GROUP BY method""",
    "first_crossing": f"WITH {_CURVE} SELECT method, min(CASE WHEN y <= 49 THEN day END) AS first, min(CASE WHEN y <= 49 THEN day END) IS NULL AS right_censored FROM curve GROUP BY method",
    "step_band": f"WITH {_RUNS}, p AS (SELECT method, seed, day, avg(value) AS y FROM runs GROUP BY ALL) SELECT method, day, round(avg(day * 1.0::DOUBLE), 6) AS x, round(avg(y), 6) AS y, round(stddev_samp(y), 6) AS sd FROM p GROUP BY method, day",
    "paired_delta": f"WITH {_GRID} SELECT 'click - ' || b.method AS contrast, a.seed, a.block_id, round(a.nll - b.nll, 6) AS delta FROM grid a JOIN grid b USING (seed, block_id) WHERE a.method = 'click' AND b.method <> 'click'",
    "contrast_summary": f"WITH {_GRID}, c AS (SELECT 'click - ' || b.method AS contrast, a.seed, (a.nll - b.nll) / 1000 AS x FROM grid a JOIN grid b USING (seed, block_id) WHERE a.method = 'click' AND b.method <> 'click') SELECT contrast, count(DISTINCT seed)::BIGINT AS paired_seeds, round(avg(x), 6) AS mean, round(exp(avg(x)), 6) AS ratio FROM c GROUP BY contrast",
    "block_group_mean": f"WITH {_GRID} SELECT method, seed, (block_id // 32)::BIGINT AS block_group, count(*)::BIGINT AS blocks, round(avg(nll), 6) AS mean FROM grid GROUP BY ALL",
    "largest_value": "SELECT event_type, max(value) AS largest FROM events GROUP BY event_type",
    "run_status": f"WITH {_STATUS} SELECT * FROM status",
    "completed_runs": f"WITH {_STATUS} SELECT count(*) FILTER (WHERE stage = 'complete')::BIGINT AS completed, count(*)::BIGINT AS runs FROM status",
    "recovery_report": f"""WITH {_CURVE}, m AS (SELECT method, avg(value) AS reference FROM runs GROUP BY method), s AS (SELECT min(day) AS d0 FROM curve),
p AS (SELECT method, reference, (day - d0) * 8192 AS t, y, greatest(0, y - reference) AS e FROM curve JOIN m USING (method), s),
l AS (SELECT *, lag(e) OVER w AS pe, lag(t) OVER w AS pt FROM p WINDOW w AS (PARTITION BY method ORDER BY t))
SELECT method, round(any_value(reference), 6) AS reference, min(CASE WHEN y <= reference THEN t END)::BIGINT AS first_tokens, min(CASE WHEN y <= reference THEN t END) IS NULL AS right_censored,
  max(t)::BIGINT AS observed_tokens, round(sum((t - pt) * (e + pe) / 2), 2) AS excess_auc FROM l GROUP BY method""",
    "expert_descriptor": f"""WITH {_PROB}, c AS (SELECT label, expert, count(*)::BIGINT AS n, avg(probability) AS a FROM top2 GROUP BY ALL),
x AS (SELECT label, expert, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM top2 JOIN embeddings USING (vec_id, label)),
m AS (SELECT label, expert, dim, avg(x) AS mu, stddev_pop(x) AS sigma FROM x GROUP BY ALL)
SELECT label, expert, any_value(n) AS count, true AS observed, round(any_value(a), 6) AS a, round(sum(mu), 5) AS mu, round(sum(sigma), 5) AS sigma FROM m JOIN c USING (label, expert) GROUP BY label, expert""",
    "verified_scan": f"""WITH {_PROB}, c AS (SELECT label, expert, count(*)::BIGINT AS n, avg(probability) AS a FROM top2 GROUP BY ALL),
x AS (SELECT label, expert, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM top2 JOIN embeddings USING (vec_id, label)),
m AS (SELECT label, expert, dim, avg(x) AS mu, stddev_pop(x) AS sigma FROM x GROUP BY ALL)
SELECT label, expert, any_value(n) AS count, true AS observed, round(any_value(a), 6) AS a, round(sum(mu), 5) AS mu, round(sum(sigma), 5) AS sigma FROM m JOIN c USING (label, expert) GROUP BY label, expert""",
    "scored_plans": f"WITH {_SCORED} SELECT * FROM scored",
    "inherited_labels": f"WITH {_SCORED} SELECT layer, expert, expert % 3 AS label FROM calls UNION ALL SELECT layer, 11 + place AS expert, parent % 3 AS label FROM scored",
    "distinct_parents": f"WITH {_SCORED.replace('<= 12', '<= 20')} SELECT layer, count(*)::BIGINT AS new_experts, count(DISTINCT parent)::BIGINT AS unique_parents FROM scored GROUP BY layer",
    "plan_report": f"""WITH {_RUNS}, g AS (SELECT *, event_id % 3 AS layer FROM runs),
m AS (SELECT method, seed, layer, avg(CASE WHEN seed < 4 THEN value END) AS r, max(value) AS n, min(value) AS c, count(DISTINCT day) AS u FROM g GROUP BY ALL),
s AS (SELECT method, seed, avg(r) AS r FROM m GROUP BY ALL), t AS (SELECT method, stddev_samp(r) AS sd, count(*)::BIGINT AS k FROM s GROUP BY method),
x AS (SELECT method, avg(v) AS v FROM (SELECT method, layer, avg(value) AS v FROM g WHERE method <> 'view' GROUP BY ALL) GROUP BY method)
SELECT m.method, count(DISTINCT layer)::BIGINT AS layers, any_value(t.k) AS plan_seeds, round(avg(r), 6) AS ratio_mean, round(avg(n), 6) AS null_mean_mean, round(avg(c), 6) AS coverage_mean, round(avg(u), 6) AS unique_parents_mean,
  round(any_value(t.sd), 6) AS ratio_seed_sd, round(any_value(x.v), 6) AS seed_ari_mean FROM m JOIN t ON t.method = m.method LEFT JOIN x ON x.method = m.method GROUP BY m.method""",
    "causal_loss": """WITH e AS (SELECT vec_id // 16 AS block, vec_id % 16 AS pos, embedding::DOUBLE[] AS z, label FROM embeddings),
n AS (SELECT block, z, lead(label) OVER (PARTITION BY block ORDER BY pos) AS t FROM e)
SELECT block::BIGINT AS block, count(*)::BIGINT AS targets, round(sum(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[t + 1]), 5) AS nll FROM n WHERE t IS NOT NULL GROUP BY block""",
    "quantile_band": "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS high FROM events GROUP BY event_type",
    "latest_status": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "run_stage": """WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN p > 3 THEN 'complete' WHEN e > 3 THEN 'tasks' WHEN n >= 12 THEN 'final evaluation' WHEN n > 0 THEN 'training' WHEN s > 2 THEN 'warm-start' WHEN n > 0 THEN 'initialization' ELSE 'pending' END AS stage FROM e""",
    "manifest_diff": """WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'unexpected' WHEN a.v <> b.v THEN 'changed' END AS difference FROM a FULL JOIN b ON a.k = b.k) WHERE difference IS NOT NULL""",
    "lr_schedule": "SELECT s AS step, round(CASE WHEN s <= 128 THEN s / 128.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least((s - 128) / 3968.0::DOUBLE, 1))) END, 9) AS multiplier, round(greatest(0, 1 - s / 4096.0::DOUBLE), 9) AS exploration FROM (SELECT DISTINCT event_id AS s FROM events)",
    "block_cross_entropy": """WITH z AS (SELECT label, embedding::DOUBLE[] AS z FROM embeddings), n AS (SELECT label, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label + 1] AS nll FROM z)
SELECT label, round(avg(nll), 6) AS nll, round(exp(avg(nll)), 6) AS ppl FROM n GROUP BY label""",
    "probe_windows": "WITH w AS (SELECT DISTINCT user_id * 7 AS start FROM events) SELECT event_id AS position, start, (event_id - start)::BIGINT AS local FROM events JOIN w ON event_id >= start AND event_id < start + 16",
    "probe_coordinates": "SELECT event_id, (event_id // 128)::BIGINT AS block_id, (event_id % 128)::BIGINT AS token_pos FROM events",
    "conditional_prob": f"WITH {_PROB} SELECT label, expert, count(*)::BIGINT AS calls, round(sum(probability), 5) AS mass, round(avg(probability), 6) AS a FROM top2 GROUP BY label, expert",
    "routing_totals": f"WITH {_PROB}, g AS (SELECT label, count(*)::BIGINT AS calls FROM top2 GROUP BY label), w AS (SELECT label, (2 * count(*))::BIGINT AS expected FROM embeddings GROUP BY label) SELECT label, calls, expected, calls = expected AS exact FROM w JOIN g USING (label)",
    "expert_dispatch": f"""WITH {_PROB}, s AS (SELECT vec_id, expert, probability / sum(probability) OVER (PARTITION BY vec_id) AS w FROM top2), d AS (SELECT unnest(range(4))::INTEGER AS dim)
SELECT vec_id, dim, round(sum(w * (embedding::DOUBLE[])[(expert + dim) % 64 + 1]), 6) AS value FROM s JOIN embeddings USING (vec_id) CROSS JOIN d GROUP BY vec_id, dim""",
    "mean_gradient_energy": f"WITH {_DIMS}, m AS (SELECT label, dim, avg(x) AS m FROM dims GROUP BY label, dim) SELECT label, round(sum(m * m), 6) AS energy FROM m GROUP BY label",
    "seed_stability": """WITH l AS (SELECT vec_id, unnest([0, 1, 2])::INTEGER AS seed, unnest([label::BIGINT, vec_id % 7, (label + vec_id) % 5]) AS l FROM embeddings),
c AS (SELECT x.seed AS sa, y.seed AS sb, x.l AS a, y.l AS b, count(*)::DOUBLE AS n FROM l x JOIN l y USING (vec_id) WHERE x.seed < y.seed GROUP BY ALL),
i AS (SELECT sa, sb, sum(m * (m - 1) / 2) AS i FROM (SELECT sa, sb, sum(n) AS m FROM c GROUP BY sa, sb, a) GROUP BY sa, sb), j AS (SELECT sa, sb, sum(m * (m - 1) / 2) AS j FROM (SELECT sa, sb, sum(n) AS m FROM c GROUP BY sa, sb, b) GROUP BY sa, sb),
t AS (SELECT sa, sb, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c GROUP BY sa, sb)
SELECT sa AS seed_a, sb AS seed_b, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 9) AS adjusted_rand FROM t JOIN i USING (sa, sb) JOIN j USING (sa, sb)""",
    "traffic_reallocation": f"""WITH {_CALLS}, c AS (SELECT layer, (expert % 5)::INTEGER AS cluster, sum(calls)::DOUBLE AS traffic, count(*)::DOUBLE AS size FROM calls GROUP BY ALL),
q AS (SELECT *, traffic * 32 / sum(traffic) OVER (PARTITION BY layer) AS qt, size * 32 / sum(size) OVER (PARTITION BY layer) AS qs FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY qt - floor(qt) DESC, cluster) AS rt, row_number() OVER (PARTITION BY layer ORDER BY qs - floor(qs) DESC, cluster) AS rs,
  32 - sum(floor(qt)) OVER (PARTITION BY layer) AS lt, 32 - sum(floor(qs)) OVER (PARTITION BY layer) AS ls FROM q)
SELECT layer, (sum(abs(floor(qt) + (rt <= lt)::INTEGER - floor(qs) - (rs <= ls)::INTEGER)) / 2)::BIGINT AS reallocated FROM r GROUP BY layer""",
    "plan_summary": f"WITH {_RUNS}, m AS (SELECT method, seed, event_id % 3 AS layer, avg(value) AS v FROM runs GROUP BY ALL), s AS (SELECT method, seed, avg(v) AS sv FROM m GROUP BY ALL) SELECT method, (SELECT count(*) FROM s WHERE s.method = m.method)::BIGINT AS seeds, round(avg(v), 6) AS mean, round((SELECT stddev_samp(sv) FROM s WHERE s.method = m.method), 6) AS sd FROM m GROUP BY method",
    "plan_variants": f"""WITH {_RUNS}, plans AS (SELECT method AS variant, seed, count(*)::BIGINT AS plan FROM runs GROUP BY ALL),
n AS (SELECT * FROM (VALUES ('grouped', 'click', false), ('grouped_warm', 'click', false), ('busiest', 'view', true), ('absent', 'none', false)) AS t(method, variant, single)),
x AS (SELECT method, s.seed, n.variant, CASE WHEN single THEN (SELECT min(seed) FROM plans p WHERE p.variant = n.variant) ELSE s.seed END AS plan_seed FROM n CROSS JOIN (SELECT unnest(range(6))::INTEGER AS seed) s)
SELECT x.method, x.seed, x.variant, x.plan_seed, plan FROM x LEFT JOIN plans p ON p.variant = x.variant AND p.seed = x.plan_seed""",
    "micro_batches": "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY sha256('5:' || doc_id::VARCHAR), doc_id) - 1 AS pos FROM documents QUALIFY pos < 128) SELECT (pos // 4)::BIGINT AS step, count(*)::BIGINT AS rows, round(avg(n_chars), 6) AS mean FROM s GROUP BY ALL",
    "evaluation_progress": f"""WITH {_RUNS}, c AS (SELECT method, day, avg(value) AS y, count(*)::DOUBLE AS s FROM runs GROUP BY ALL),
p AS (SELECT method, day, count(*) OVER w AS done, count(*) OVER (PARTITION BY method) AS total, avg(y) OVER w AS mean, sum(s) OVER w AS elapsed FROM c WINDOW w AS (PARTITION BY method ORDER BY day))
SELECT method, day, done::BIGINT AS done, round(mean, 6) AS mean, elapsed, round(elapsed * (total - done) / done, 6) AS "left" FROM p""",
    "merged_manifest": "SELECT lang AS task, source AS split, count(*)::BIGINT AS rows, min(doc_id)::VARCHAR || '-' || max(doc_id)::VARCHAR AS fingerprint, sha256('v1') AS definitions FROM documents GROUP BY lang, source",
    "flattened_samples": "SELECT conv_id, role AS subtask, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INTEGER AS position, turn AS example FROM conversations",
    "preparation_costs": """SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'view'), 5) AS calibration, round(sum(value) FILTER (WHERE event_type = 'click'), 5) AS grouping,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0), 5) AS gradient FROM events GROUP BY user_id""",
    "parameter_counts": """WITH c AS (SELECT p_partkey, 64 * (1 + p_partkey % 16) AS d, 1 + p_partkey % 7 AS l, 8 * (1 + p_partkey % 8) AS n, 4 * (1 + p_partkey % 3) AS m, 32 * (1 + p_partkey % 5) AS f,
  128 * (p_partkey % 2) AS s, 16 * (1 + p_partkey % 4) AS kv, 1000 + p_partkey % 500 AS v, p_partkey % 3 = 0 AS tied FROM part)
SELECT p_partkey, (l * n * 3 * d * f + l * (3 * d * s + CASE WHEN s > 0 THEN d ELSE 0 END) + l * (2 * d * d + 2 * d * kv + n * d + 2 * d) + v * d * CASE WHEN tied THEN 1 ELSE 2 END)::BIGINT AS base,
  (l * m * 3 * d * f)::BIGINT AS extra FROM c""",
}


_BASE = ORACLE["parameter_counts"]
ORACLE["resource_estimate"] = f"""WITH b AS ({_BASE}), k AS (SELECT p_partkey, base::DOUBLE AS base, extra::DOUBLE AS extra, 1 + p_partkey % 7 AS l, 8 * (1 + p_partkey % 8) AS n, 8 * (1 + p_partkey % 8) + 4 * (1 + p_partkey % 3) AS a,
  3 * 64 * (1 + p_partkey % 16) * 32 * (1 + p_partkey % 5) AS e, 64 * (1 + p_partkey % 16) AS w, ['gradient', 'original', 'continue', 'grouped', 'warm'][p_partkey % 5 + 1] AS method, p_partkey % 2 = 0 AS keep FROM b),
t AS (SELECT *, CASE WHEN method = 'continue' THEN base ELSE extra + l * a * w END AS train, CASE WHEN method = 'continue' THEN base ELSE base + extra END AS total, (l * n * e)::DOUBLE AS scored, 1073741824.0::DOUBLE AS g FROM k)
SELECT p_partkey, method,
  round(CASE method WHEN 'gradient' THEN (2 * base + 2 * scored) / g + 12 WHEN 'original' THEN 2 * base / g + 8 ELSE (2 * total + 2 * train) / g + 12 END, 5) AS gpu_gib,
  round(CASE method WHEN 'gradient' THEN greatest(2 * base / g + 8, 4 * scored / g + 16) WHEN 'original' THEN 2 * base / g + 8 ELSE greatest(2 * base / g + 8, (4 * train + 4 * train / l) / g + 16) END, 5) AS cpu_gib,
  round(CASE method WHEN 'gradient' THEN 1 WHEN 'original' THEN 2 ELSE (2.08::DOUBLE * 4 * train + CASE WHEN keep THEN 2 * CASE WHEN method = 'continue' THEN total ELSE extra END ELSE 0 END + CASE WHEN method = 'warm' THEN 2 * extra ELSE 0 END) / g + 5 END, 5) AS disk_gib FROM t"""
ORACLE["seed_ari"] = f"SELECT 0 AS layer, round(avg(adjusted_rand), 9) AS seed_ari_mean, round(min(adjusted_rand), 9) AS seed_ari_min FROM ({ORACLE['seed_stability']})"

ORACLE |= queries_io.oracle(_CAND, _FULL)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
