"""Score, efficiency, paired and sampling analytics over the driver's tables.

lineitem stands for per-task facts (return flag and status as layer, quantity as
total), events for attempts of a user in order (purchase: gain, error: failed
call), customer and orders for tasks and their runs.
"""

from __future__ import annotations

from .registry import query

_FACTS = """facts AS (SELECT l_orderkey AS task, count(*) AS total, count_if(l_returnflag = 'R') AS equiv,
  count_if(l_quantity > 10) AS killed, count_if(l_discount >= cast(0.04 AS double)) AS official FROM {lineitem} GROUP BY l_orderkey)"""

query("macro_micro_scores", f"""WITH {_FACTS}, s AS (SELECT f.*, o.o_orderstatus AS subset, o.o_orderpriority AS parent FROM facts f JOIN {{orders}} o ON o.o_orderkey = f.task)
SELECT subset, count(*) AS n_problems, round(avg(cast(killed AS double) / total), 6) AS macro_final, round(avg(cast(official AS double) / total), 6) AS macro_official,
 round(cast(sum(killed) AS double) / sum(total), 6) AS micro_final, round(cast(sum(official) AS double) / sum(total), 6) AS micro_official,
 round(CASE WHEN sum(total) > sum(equiv) THEN cast(sum(least(killed, greatest(0, total - equiv))) AS double) / (sum(total) - sum(equiv)) ELSE 0 END, 6) AS micro_adjusted,
 round(avg(CASE WHEN killed > official THEN cast(1 AS double) ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN killed = official THEN cast(1 AS double) ELSE 0 END), 6) AS tie_rate
FROM s GROUP BY subset""")
query("score_conventions", f"""WITH {_FACTS}
SELECT m.method, round(avg(CASE m.method WHEN 'proposed' THEN cast(killed AS double) ELSE official END / total), 6) AS macro_raw,
 round(sum(CASE m.method WHEN 'proposed' THEN cast(killed AS double) ELSE official END) / sum(total), 6) AS micro_raw
FROM facts CROSS JOIN (VALUES ('proposed'), ('official')) m(method) GROUP BY m.method""")
query("subset_summary", """SELECT coalesce(nullif(c.c_mktsegment, ''), 'unknown') AS subset, o.o_orderstatus AS method, count(*) AS n, round(avg(o.o_totalprice), 4) AS mean_score, round(sum(o.o_totalprice), 2) AS total
FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY coalesce(nullif(c.c_mktsegment, ''), 'unknown'), o.o_orderstatus""")
query("subset_rollup", """SELECT c.c_mktsegment AS subset, o.o_orderstatus AS method, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY ROLLUP (c.c_mktsegment, o.o_orderstatus)""")
query("layer_summary", """SELECT l_returnflag AS layer, count(DISTINCT l_orderkey) AS n_problems, round(avg(l_quantity), 6) AS mean_quantity, round(sum(l_extendedprice), 2) AS tokens, round(sum(l_discount), 4) AS cost,
 round(CASE WHEN sum(l_quantity) <> 0 THEN sum(l_extendedprice) / sum(l_quantity) ELSE 0 END, 4) AS tokens_per_kill, round(CASE WHEN sum(l_tax) <> 0 THEN sum(l_discount) / sum(l_tax) ELSE 0 END, 6) AS cost_ratio
FROM {lineitem} GROUP BY l_returnflag""")
query("efficiency_summary", """SELECT o_orderpriority AS method, count(*) AS calls, round(sum(o_totalprice), 2) AS tokens, count_if(o_orderstatus = 'F') AS productive,
 round(CASE WHEN count_if(o_orderstatus = 'F') > 0 THEN sum(o_totalprice) / count_if(o_orderstatus = 'F') ELSE 0 END, 4) AS tokens_per_productive, round(cast(count_if(o_orderstatus = 'F') AS double) / greatest(1, count(*)), 6) AS productive_rate
FROM {orders} GROUP BY o_orderpriority""")
query("operator_difficulty", """SELECT p.p_type AS operator, count(*) AS total, count_if(l.l_returnflag = 'R') AS killed, count(*) - count_if(l.l_returnflag = 'R') AS survived, round(cast(count_if(l.l_returnflag = 'R') AS double) / count(*), 6) AS kill_rate
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY p.p_type""")
query("usage_summary", """SELECT event_type AS status, user_id % 4 AS method, count(*) AS calls, count_if(value > 50) AS productive, round(sum(value), 4) AS tokens, round(CASE WHEN count_if(value > 50) > 0 THEN sum(value) / count_if(value > 50) ELSE 0 END, 4) AS tokens_per_productive
FROM {events} GROUP BY event_type, user_id % 4""")
query("outcome_counts", "SELECT user_id % 4 AS method, event_type AS status, count(*) AS n FROM {events} GROUP BY user_id % 4, event_type")
query("outcome_pivot", """SELECT user_id % 4 AS method, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS views, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'error') AS error FROM {events} GROUP BY user_id % 4""")
query("paid_totals", """SELECT user_id AS task, round(sum(CASE WHEN event_type NOT IN ('view', 'click') THEN value ELSE 0 END), 4) AS paid, round(sum(value), 4) AS total FROM {events} GROUP BY user_id""")
query("cost_estimate", """SELECT e.event_type AS model, round(sum(coalesce(p.p_in, 0) * e.value / 1000 + coalesce(p.p_out, 0) * e.value / 1000), 6) AS cost
FROM {events} e LEFT JOIN (SELECT * FROM (VALUES ('purchase', cast(0.5 AS double), cast(1.5 AS double)), ('click', cast(0.25 AS double), cast(2 AS double))) v(model, p_in, p_out)) p ON p.model = e.event_type GROUP BY e.event_type""")
# --- ordered sequences: attempts of a user, ordered by time -------------------
_SEQ = """a AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS it,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS gain FROM {events})"""
_CUM = """c AS (SELECT *, sum(gain) OVER (PARTITION BY user_id ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kills,
 sum(value) OVER (PARTITION BY user_id ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tokens, count(*) OVER (PARTITION BY user_id) AS n FROM a)"""
query("cum_kills", f"WITH {_SEQ}, {_CUM} SELECT user_id, it, cast(kills AS bigint) AS kills, round(tokens, 4) AS tokens, round(cast(kills AS double) / n, 6) AS score FROM c")
_PLATEAU = f"""WITH {_SEQ}, g AS (SELECT *, sum(gain) OVER (PARTITION BY user_id ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a WHERE event_type <> 'error'),
 s AS (SELECT *, sum(1 - gain) OVER (PARTITION BY user_id, island ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM g)"""
query("plateau", f"{_PLATEAU} SELECT user_id, it, cast(streak AS bigint) AS streak, streak >= 3 AS stopped FROM s")
query("first_plateau", f"{_PLATEAU} SELECT user_id, min(it) AS first_it FROM s WHERE streak >= 3 GROUP BY user_id")
query("first_final", f"WITH {_SEQ}, {_CUM}, m AS (SELECT *, max(kills) OVER (PARTITION BY user_id) AS final FROM c) SELECT user_id, cast(max(final) AS bigint) AS final, min(CASE WHEN kills = final THEN it END) AS first_it FROM m GROUP BY user_id")
query("budget_lookup", f"WITH {_SEQ}, {_CUM} SELECT c.user_id, b.budget, cast(coalesce(max(CASE WHEN c.tokens <= b.budget THEN c.kills END), 0) AS bigint) AS best FROM c CROSS JOIN (VALUES (100), (500), (1000)) b(budget) GROUP BY c.user_id, b.budget")
query("two_errors", f"WITH {_SEQ}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY it) AS before FROM a) SELECT user_id, min(it) AS stop_it FROM l WHERE event_type = 'error' AND before = 'error' GROUP BY user_id")
# the order of the reasons counts; streaks are those an attempt sequence ends with; failed calls neither gain nor end a streak
query("stop_reason", f"""{_PLATEAU}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY it DESC) AS back FROM a),
 f AS (SELECT user_id, sum(gain) AS gains, count(*) AS n, count_if(back <= 2 AND event_type = 'error') AS failed FROM e GROUP BY user_id),
 z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY it DESC) AS back FROM s)
SELECT f.user_id, CASE WHEN gains = n THEN 'zero_survivors' WHEN z.streak >= 3 THEN 'plateau' WHEN failed = 2 THEN 'consecutive_infrastructure_errors' ELSE 'budget_exhausted' END AS reason
 FROM f LEFT JOIN z ON f.user_id = z.user_id AND z.back = 1""")
query("last_n_attempts", f"WITH {_SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY it DESC) AS back FROM a) SELECT user_id, event_id, it FROM r WHERE back <= 3")
query("attempt_history", """SELECT user_id, count(*) AS attempts, count_if(event_type = 'error') AS infra_errors, count_if(event_type <> 'error') AS strategy_attempts, count_if(event_type = 'purchase') AS productive FROM {events} GROUP BY user_id""")
# --- confusion and sets ---------------------------------------------------------
_KILL = "k AS (SELECT l_orderkey AS task, l_linenumber AS mutant, l_quantity > 20 AS ours, l_discount >= cast(0.05 AS double) AS theirs FROM {lineitem})"
_CONF = f"WITH {_KILL}, n AS (SELECT task, count_if(ours AND theirs) AS tp, count_if(ours AND NOT theirs) AS fp, count_if(theirs AND NOT ours) AS fn, count_if(NOT ours AND NOT theirs) AS tn FROM k GROUP BY task)"
query("confusion", f"{_CONF} SELECT task, tp, fp, fn, tn, round(cast(tp + tn AS double) / (tp + fp + fn + tn), 4) AS accuracy, CASE WHEN tp + fp > 0 THEN round(cast(tp AS double) / (tp + fp), 4) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN round(cast(tp AS double) / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(cast(2 * tp AS double) / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM n")
query("agreement", f"{_CONF} SELECT round(avg(cast(tp + tn AS double) / (tp + fp + fn + tn)), 6) AS accuracy, round(avg(CASE WHEN tp + fp > 0 THEN cast(tp AS double) / (tp + fp) ELSE 0 END), 6) AS prec, count(*) AS n FROM n")
query("survivors_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
query("live_semi", "SELECT c_custkey, c_mktsegment FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
query("new_kills_except", "SELECT c_custkey AS id FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
query("tp_intersect", "SELECT l_partkey AS id FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_discount > cast(0.08 AS double)")
query("kills_union", "SELECT l_partkey AS id FROM {lineitem} WHERE l_quantity > 49 UNION SELECT l_partkey FROM {lineitem} WHERE l_tax > cast(0.07 AS double)")
query("union_all_byname", "SELECT c_custkey AS id, c_name AS name, cast(NULL AS bigint) AS nation FROM {customer} UNION ALL SELECT s_suppkey, s_name, cast(s_nationkey AS bigint) FROM {supplier}")
query("dup_keys", "SELECT l_orderkey AS id, count(*) AS n FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 1")
query("dedup_first", "SELECT id, brand FROM (SELECT p_partkey AS id, p_brand AS brand, row_number() OVER (PARTITION BY substr(@md5(p_brand), 1, 10) ORDER BY p_partkey) AS r FROM {part}) t WHERE r = 1")
query("shard_first_wins", "SELECT id, shard FROM (SELECT id, shard, row_number() OVER (PARTITION BY id ORDER BY shard) AS r FROM (SELECT c_custkey AS id, 0 AS shard FROM {customer} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1 FROM {customer}) u) t WHERE r = 1")
# --- paired statistics -------------------------------------------------------------
_DIFF = "d AS (SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'click' THEN -value ELSE 0 END), 6) AS d, count(*) AS w FROM {events} GROUP BY user_id)"
query("sign_counts", f"WITH {_DIFF} SELECT count_if(d > cast(1e-12 AS double)) AS wins, count_if(d < cast(-1e-12 AS double)) AS losses, count_if(abs(d) <= cast(1e-12 AS double)) AS ties FROM d")
query("weighted_delta", f"WITH {_DIFF} SELECT round(sum(w * d) / sum(w), 6) AS delta FROM d")
query("subset_paired", "SELECT c.c_nationkey AS subset, count(*) AS n, round(avg(o.o_totalprice - c.c_acctbal), 4) AS mean_delta, count_if(o.o_totalprice > c.c_acctbal) AS wins FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey")
# counter-based resampling: the index depends on (replica, row, seed) only
_IX = "((b * 1103515245 + i * 12345 + 42) * 48271 %% 2147483647) %% n"
_REP = "(SELECT explode(sequence(cast(0 AS bigint), cast(199 AS bigint))) AS b)"
_REP_O = "(SELECT * FROM range(0, 200) t(b))"
_BOOT = f"""WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM {{customer}}),
 r AS (SELECT x.g, b, {_IX} AS ix FROM x CROSS JOIN %s t), m AS (SELECT r.g, r.b, %s AS m FROM r JOIN x ON x.g = r.g AND x.i = r.ix GROUP BY r.g, r.b)
SELECT g AS subset, round(avg(m), 4) AS mean, round(@quantile(m, cast(0.025 AS double)), 4) AS lo, round(@quantile(m, cast(0.975 AS double)), 4) AS hi FROM m GROUP BY g"""
query("bootstrap_mean_ci", _BOOT % (_REP, "avg(x.v)"), _BOOT % (_REP_O, "avg(x.v)"))
query("bootstrap_ratio_ci", _BOOT % (_REP, "CASE WHEN sum(x.i + 1) = 0 THEN 0 ELSE sum(x.v) / sum(x.i + 1) END"), _BOOT % (_REP_O, "CASE WHEN sum(x.i + 1) = 0 THEN 0 ELSE sum(x.v) / sum(x.i + 1) END"))
_CLUS = f"""WITH u AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM {{customer}} GROUP BY c_nationkey), x AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM u),
 r AS (SELECT b, {_IX} AS ix FROM x CROSS JOIN %s t), m AS (SELECT b, avg(x.v) AS m FROM r JOIN x ON x.i = r.ix GROUP BY b)
SELECT round(avg(m), 4) AS mean, round(@quantile(m, cast(0.025 AS double)), 4) AS lo, round(@quantile(m, cast(0.975 AS double)), 4) AS hi FROM m"""
query("clustered_ci", _CLUS % _REP, _CLUS % _REP_O)
# --- sampling -------------------------------------------------------------------------
query("first_n", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 50")
query("random_sample", "SELECT c_custkey FROM {customer} ORDER BY @md5(concat(cast(c_custkey AS @text), '-42')), c_custkey LIMIT 50")
query("stratified_sample", """WITH x AS (SELECT c_custkey, coalesce(nullif(c_mktsegment, ''), 'unknown') AS k, row_number() OVER (PARTITION BY coalesce(nullif(c_mktsegment, ''), 'unknown') ORDER BY @md5(concat(cast(c_custkey AS @text), '-42')), c_custkey) AS r FROM {customer}),
 s AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS nk FROM (SELECT DISTINCT k FROM x) d)
SELECT x.c_custkey, x.k FROM x JOIN s ON s.k = x.k WHERE x.r <= floor(102 / s.nk) + CASE WHEN s.pos < 102 % s.nk THEN 1 ELSE 0 END""")
query("manifest", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS subsets, min(c_custkey) AS lo, max(c_custkey) AS hi FROM {customer}")
# --- predicates as mutants: rows of lineitem are the tests ------------------------------
query("predicate_mutants", """SELECT m.operator, count(*) AS tests, count_if((CASE m.operator
  WHEN 'COMPARISON_FLIP' THEN l_quantity > 25 AND l_discount >= cast(0.05 AS double) WHEN 'BOUNDARY_SHIFT' THEN l_quantity <= 25 AND l_discount >= cast(0.05 AS double)
  WHEN 'BOOLEAN_FLIP' THEN l_quantity < 25 OR l_discount >= cast(0.05 AS double) WHEN 'CONSTANT_CHANGE' THEN l_quantity < 26 AND l_discount >= cast(0.05 AS double)
  WHEN 'ARITHMETIC_FLIP' THEN -l_quantity < 25 AND l_discount >= cast(0.05 AS double) ELSE NOT (l_quantity < 25 AND l_discount >= cast(0.05 AS double)) END)
  <> (l_quantity < 25 AND l_discount >= cast(0.05 AS double))) AS kills
FROM {lineitem} CROSS JOIN (VALUES ('COMPARISON_FLIP'), ('BOUNDARY_SHIFT'), ('BOOLEAN_FLIP'), ('CONSTANT_CHANGE'), ('ARITHMETIC_FLIP'), ('NEGATE_CONDITION')) m(operator) GROUP BY m.operator""")
# --- clusters: part brands as clusters, retail price as score -----------------------------
query("compression", "SELECT p_type AS task, count(*) AS total, count(DISTINCT p_brand) AS reps, round(cast(count(*) AS double) / count(DISTINCT p_brand), 4) AS ratio, round(@quantile(p_retailprice, cast(0.5 AS double)), 4) AS med FROM {part} GROUP BY p_type")
query("dynamic_targets", "SELECT cluster, id FROM (SELECT p_brand AS cluster, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS r FROM {part}) t WHERE r = 1")
query("representatives", """SELECT cluster, id FROM (SELECT s.*, row_number() OVER (PARTITION BY cluster ORDER BY p_retailprice DESC, id) AS pick FROM (SELECT p_brand AS cluster, p_partkey AS id, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM {part}) s WHERE r <= greatest(1, ceil(n * cast(0.4 AS double)))) t WHERE pick <= 1""")
query("kill_consistency", """WITH r AS (SELECT p_brand AS cluster, min(p_partkey) AS rep FROM {part} GROUP BY p_brand), x AS (SELECT p.p_brand AS cluster, avg(CASE WHEN (p.p_size > 25) = (q.p_size > 25) THEN cast(1 AS double) ELSE 0 END) AS c FROM {part} p JOIN r ON r.cluster = p.p_brand JOIN {part} q ON q.p_partkey = r.rep GROUP BY p.p_brand)
SELECT round(avg(c), 4) AS consistency FROM x""")
query("scaled_features", """SELECT p_partkey AS id, round((p_size - avg(p_size) OVER (PARTITION BY p_type)) / CASE WHEN stddev_pop(p_size) OVER (PARTITION BY p_type) = 0 THEN 1 ELSE stddev_pop(p_size) OVER (PARTITION BY p_type) END, 6) AS z FROM {part}""")
query("one_hot", "SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STEEL' THEN 1 ELSE 0 END AS m1, CASE WHEN p_type LIKE '%BRASS' THEN 1 ELSE 0 END AS m2 FROM {part}")
query("entropy_score", """WITH n AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS code, count(*) AS c FROM {events} GROUP BY user_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END),
 p AS (SELECT user_id, code, cast(c AS double) / sum(c) OVER (PARTITION BY user_id) AS p FROM n), s AS (SELECT user_id, -sum(p * ln(p)) / ln(cast(3 AS double)) AS h, sum(CASE WHEN code <> 0 THEN p ELSE 0 END) AS d FROM p GROUP BY user_id)
SELECT user_id, round(h, 4) AS entropy, round(d, 4) AS diff_rate, round(cast(0.7 AS double) * h + cast(0.3 AS double) * d, 4) AS information FROM s""")
# --- plots' data -------------------------------------------------------------------------------
query("histogram", """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem}) SELECT cast(least(11, floor((l_quantity - lo) / (hi - lo) * 12)) AS bigint) AS bin, count(*) AS n FROM {lineitem} CROSS JOIN b GROUP BY cast(least(11, floor((l_quantity - lo) / (hi - lo) * 12)) AS bigint)""")
# --- scalar functions -----------------------------------------------------------------------------
query("jsonish", "SELECT event_id, coalesce(@json(props, '$.k'), '') AS k FROM {events}")
query("subset_norm", "SELECT DISTINCT c_mktsegment AS raw, @replace_all(replace(replace(lower(trim(c_mktsegment)), '-', '_'), ' ', '_'), '^evoeval_', '') AS norm FROM {customer}")
query("unique_id", "SELECT c_custkey, concat('Set_', lower(c_mktsegment), '/', split_part(c_name, '#', 2)) AS id FROM {customer}")
query("parent_id", "SELECT s_suppkey, CASE WHEN regexp_extract(s_name, '#0*([0-9]+)$', 1) <> '' THEN concat('Base/', regexp_extract(s_name, '#0*([0-9]+)$', 1)) ELSE '' END AS parent FROM {supplier}")
query("safe_id", "SELECT p_partkey, trim(BOTH '_' FROM regexp_replace(p_type, '[^A-Za-z0-9_.-]+', '_')) AS safe FROM {part}", "SELECT p_partkey, trim(regexp_replace(p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS safe FROM part")
#: Categories of rejected checks by what the message holds, the first that fits counting.
_CATEGORIES = (("no check(candidate)", "NO_CHECK_FUNCTION_EXTRACTED"), ("syntax error", "SYNTAX_ERROR"), ("never calls candidate", "NO_CANDIDATE_CALL"), ("contains no assert", "NO_ASSERTION"), ("unproductive", "VALID_ZERO_KILL"), ("zero active mutants", "VALID_ZERO_KILL"), ("timeout", "CANONICAL_TIMEOUT"), ("forbidden", "FORBIDDEN_INTROSPECTION"), ("introspection", "FORBIDDEN_INTROSPECTION"))
_MESSAGES = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN 'Found: {text.upper()} at line 1'" for i, (text, _) in enumerate(_CATEGORIES)) + " WHEN 9 THEN 'ZeroDivisionError, timeout of syntax error' WHEN 10 THEN 'ValueError: bad' ELSE '' END"
query("failure_category", f"""WITH m AS (SELECT event_id, {_MESSAGES} AS message, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'def check(candidate): pass' END AS test FROM {{events}})
SELECT event_id, CASE WHEN trim(test) = '' THEN '{_CATEGORIES[0][1]}' {" ".join(f"WHEN position('{text}' IN lower(message)) > 0 THEN '{name}'" for text, name in _CATEGORIES)}
 WHEN message <> '' THEN 'CANONICAL_EXECUTION_FAILURE' ELSE 'NONE' END AS category FROM m""")
#: Providers by a model name's beginning.
_MODELS = ("gemini-2.5-pro", "GPT-5-mini", "o1", "o3-mini", "o4-mini", "ft:abc", "mock-1", "org/model-3b", "other")
query("provider_infer", f"""WITH m AS (SELECT p_partkey, CASE p_partkey % {len(_MODELS)} {" ".join(f"WHEN {i} THEN ' {name} '" for i, name in enumerate(_MODELS))} END AS raw FROM {{part}}),
 c AS (SELECT p_partkey, trim(raw) AS model, lower(trim(raw)) AS name FROM m WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '<%' AND trim(raw) NOT LIKE '%>')
SELECT p_partkey, model, CASE WHEN name LIKE 'gemini%' THEN 'gemini' WHEN name LIKE 'gpt-%' OR name LIKE 'o1%' OR name LIKE 'o3%' OR name LIKE 'o4%' OR name LIKE 'ft:%' THEN 'openai' WHEN name LIKE 'mock%' THEN 'mock' WHEN model LIKE '%/%' THEN 'hf' ELSE 'openai' END AS provider FROM c""")
query("bounded_text", "SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE concat(substr(c_name, 1, 5), '...', substr(c_name, length(c_name) - 3, 4)) END AS bounded FROM {customer}")
query("guarded_ratios", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 4) ELSE 0 END AS ratio FROM {lineitem}")
query("value_for_type", "SELECT DISTINCT p_type, CASE WHEN lower(p_type) LIKE '%steel%' THEN '[]' WHEN lower(p_type) LIKE '%brass%' THEN '{}' WHEN lower(p_type) LIKE '%tin%' THEN '0' ELSE 'None' END AS val FROM {part}".replace("'{}'", "'()'"))
