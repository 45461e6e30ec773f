"""Independent SQL (DuckDB) for the registered queries."""

from __future__ import annotations

import math

CODES = ["A", "N", "R", "F", "O", "BULK"]
_VOTES = ",\n  ".join(f"(count(*) FILTER (list_contains(string_split(labels, ','), '{c}')))::BIGINT AS votes_{c}" for c in CODES)
_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_VOTE_LIST = "[" + ", ".join(f"votes_{c}" for c in CODES) + "]"


def entropy(p: str) -> str:
    return f"(CASE WHEN {p} IN (0, 1) THEN 0.0 ELSE round(-({p} * ln({p}) + (1 - {p}) * ln(1 - {p})), 12) END)"


def r(*names: str) -> str:
    return ", ".join(f"round(({n})::DOUBLE, 6) AS {n}" for n in names)


VOTES = """
raw AS (SELECT 'order ' || o_orderkey AS text, o_orderpriority AS source, o_orderstatus AS bucket, l_suppkey::VARCHAR AS annotator,
  CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus || ',' || l_returnflag ELSE l_returnflag || ',' || l_linestatus END
    || CASE WHEN l_quantity >= 26 THEN ',BULK' ELSE '' END AS annotation,
  CASE l_suppkey % 4 WHEN 0 THEN 'Not Confident' WHEN 1 THEN 'Somewhat Confident' WHEN 2 THEN 'Confident' ELSE '' END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
exact AS (SELECT DISTINCT * FROM raw),
sem AS (SELECT DISTINCT bucket, source, text, annotator, array_to_string(list_sort(list_distinct(string_split(annotation, ','))), ',') AS labels, confidence FROM exact),
pairs AS (SELECT bucket, source, text, annotator, count(*) AS judgments FROM sem GROUP BY ALL HAVING count(*) > 1),
conf AS (SELECT DISTINCT bucket, source, text FROM pairs),
kept AS (SELECT s.* FROM sem s ANTI JOIN conf USING (bucket, source, text))"""
ITEMS = VOTES + f""",
items AS (SELECT bucket, source, text, sha256(to_json([bucket, source, text])::VARCHAR) AS item_id, sha256(text) AS content_id,
  count(DISTINCT annotator)::BIGINT AS n_annotators, count(*)::BIGINT AS n_votes,
  avg(CASE confidence WHEN 'Not Confident' THEN 0.0::DOUBLE WHEN 'Somewhat Confident' THEN 0.5::DOUBLE WHEN 'Confident' THEN 1.0::DOUBLE END) AS confidence_mean,
  {_VOTES} FROM kept GROUP BY bucket, source, text),
elig AS (SELECT * FROM items WHERE n_annotators >= 3)"""
LONG = ITEMS + f""",
points AS (SELECT *, (100 * v) // n_votes + ('0x' || substr(sha256(code || ':' || text), 1, 8))::BIGINT % 101 AS pt FROM
  (SELECT *, unnest({_LIST}) AS code, unnest({_VOTE_LIST}) AS v FROM elig)),
long AS (SELECT item_id, content_id, bucket, source, text, n_annotators, n_votes, confidence_mean, code,
  v::DOUBLE / n_votes AS h, pt::DOUBLE / 200 AS p, (4 * pt // 5)::DOUBLE / 200 AS q FROM points),
long2 AS (SELECT *, CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hp, CASE WHEN q >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hq,
  {entropy('h')}::DOUBLE AS uh, {entropy('p')}::DOUBLE AS up, {entropy('q')}::DOUBLE AS uq FROM long)"""


def _groups(source: str, target: int, namespace: str, name: str) -> str:
    return f""",
{name} AS (SELECT * FROM (SELECT text, size, coalesce(sum(size) OVER (ORDER BY k, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS taken_before
  FROM (SELECT text, count(*) AS size, sha256('{namespace}:42:' || text) AS k FROM {source} GROUP BY text)) WHERE taken_before < {target})"""


def _split(source: str, dev: int, sensitivity: int) -> str:
    return (
        _groups(source, dev, "dev", "devs")
        + f""",
halves AS (SELECT i.*, CASE WHEN text IN (SELECT text FROM devs) THEN 'dev' ELSE 'test' END AS split FROM {source} i),
tests AS (SELECT * FROM halves WHERE split = 'test')"""
        + _groups("tests", sensitivity, "sensitivity", "strict")
        + """,
assigned AS (SELECT *, split = 'test' AND text IN (SELECT text FROM strict) AS sensitivity FROM halves)"""
    )


SPLIT = LONG + _split("elig", 1000, 1000) + """,
sl AS (SELECT l.*, a.split, a.sensitivity FROM long2 l JOIN assigned a USING (item_id)),
t AS (SELECT * FROM sl WHERE split = 'test'), d AS (SELECT * FROM sl WHERE split = 'dev'), s AS (SELECT * FROM sl WHERE sensitivity)"""
DOCS = "docs AS (SELECT doc_id, lang AS bucket, source, text, sha256(text) AS content_id FROM documents)"


def rho(source: str, keys: str, x: str, y: str, out: str = "rho") -> str:
    part, by = (f"PARTITION BY {keys} ", f"GROUP BY {keys}") if keys else ("", "")
    own = f"{keys}, " if keys else ""
    tie = f"{keys}, " if keys else ""
    return f"""(SELECT {own}CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS {out} FROM
  (SELECT {own}rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {tie}{x}) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER ({part}ORDER BY {y}) + (count(*) OVER (PARTITION BY {tie}{y}) - 1) / 2.0::DOUBLE AS ry
   FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {by})"""


def auc(source: str, keys: str, y: str, x: str, out: str = "auc") -> str:
    return f"""(SELECT {keys}, (sum(rk) FILTER (yy) - p * (p + 1) / 2) / nullif(p * (n - p), 0) AS {out} FROM
  (SELECT *, count(*) FILTER (yy) OVER (PARTITION BY {keys})::DOUBLE AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM
   (SELECT {keys}, ({y})::BOOLEAN AS yy, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE AS rk FROM {source})) GROUP BY {keys}, p, n)"""


def macro(body: str, values: list[str], by: str = "") -> str:
    """Rows of ``body`` (code and values) and their plain means as code ``macro``; everything rounded."""
    extra, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {extra}code, {r(*values)} FROM (SELECT {extra}code, {', '.join(values)} FROM {body}
  UNION ALL SELECT {extra}'macro', {', '.join(f'avg({v})' for v in values)} FROM {body} {group})"""


BOOT = """,
num AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM {rows})),
draws AS (SELECT rep, idx, count(*) AS m FROM (SELECT r.rep, ('0x' || substr(sha256('{ns}:{seed}:' || r.rep || ':' || s.slot), 1, 8))::BIGINT % (SELECT count(*) FROM num) AS idx
  FROM range(20) r(rep), range((SELECT count(*) FROM num)) s(slot)) GROUP BY ALL),
w AS (SELECT rep, item_id, m FROM draws JOIN num USING (idx))"""


#: The chance of at most 0, 1, ... draws of a Poisson variable of mean 1, in shares of 2^-16.
_SHARES = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def poisson(rows: str, ident: str, ns: str, seed: int, reps: int) -> str:
    """CTE w(rep, ident, m) over the distinct identities of ``rows``."""
    part = lambda i: f"('0x' || substr(sha256({ident}::VARCHAR), {i}, 8))::BIGINT % 2147483647"
    c = ", ".join(f"('0x' || substr(sha256('{ns}:{seed}:' || rep || ':{j}'), 1, 8))::BIGINT % 2147483647 AS c{j}" for j in range(6))
    m = " + ".join(f"(u >= {t})::INT" for t in _SHARES)
    return f""",
ids AS (SELECT {ident}, {part(1)} AS x1, {part(9)} AS x2 FROM (SELECT DISTINCT {ident} FROM {rows})),
poly AS (SELECT rep, {c} FROM range({reps}) g(rep)),
w AS (SELECT rep, {ident}, {m} AS m FROM (SELECT rep, {ident}, ((((c0 * x1 + c1) % 2147483647 * x1 + c2) % 2147483647 * x1 + (c3 * x2 + c4) % 2147483647 * x2 % 2147483647 + c5) % 2147483647) // 32768 AS u FROM ids, poly))"""


def boot_means(values: dict[str, str], rows: str, after: dict[str, str] | None = None) -> str:
    names = list(values)
    sums = ", ".join(f"sum(m * v_{n}) / sum(m) AS v_{n}" for n in names)
    after = after or {n: f"v_{n}" for n in names}
    plain = ", ".join(f"avg(v_{n}) AS v_{n}" for n in names)
    own = ", ".join(f"{e} AS x_{n}" for n, e in after.items())
    flat = lambda table, keep: " UNION ALL ".join(f"SELECT {keep} '{n}' AS metric, code, x_{n} AS v FROM {table}" for n in after)
    means = ", ".join(f"avg(x_{n})" for n in after)
    columns = ", ".join(f"x_{n}" for n in after)
    return poisson(rows, "item_id", "boot", 42, 1000) + f""",
vals AS (SELECT item_id, code, {', '.join(f'{e} AS v_{n}' for n, e in values.items())} FROM {rows}),
reps AS (SELECT rep, code, {own} FROM (SELECT rep, code, {sums} FROM vals JOIN w USING (item_id) GROUP BY ALL)),
points0 AS (SELECT code, {own} FROM (SELECT code, {plain} FROM vals GROUP BY code)),
reps2 AS (SELECT rep, code, {columns} FROM reps UNION ALL SELECT rep, 'macro', {means} FROM reps GROUP BY rep),
points2 AS (SELECT code, {columns} FROM points0 UNION ALL SELECT 'macro', {means} FROM points0)
SELECT metric, code, {r('estimate')}, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high FROM
  (SELECT metric, code, v AS estimate FROM ({flat('points2', '')})) JOIN
  (SELECT metric, code, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM ({flat('reps2', 'rep,')}) GROUP BY ALL) USING (metric, code)"""


def q(prefix: str, body: str) -> str:
    return "WITH " + prefix.strip().lstrip(",") + "\n" + body


SQL: dict[str, str] = {}
SQL["uncertainty_validity"] = q(LONG, f"""SELECT code, n, {r('rho', 'squared_loss', 'hard_squared_loss')} FROM
  (SELECT code, count(*)::BIGINT AS n, avg((p - h) ** 2) AS squared_loss, avg((hp - h) ** 2) AS hard_squared_loss FROM long2 GROUP BY code) JOIN {rho('long2', 'code', 'uh', 'up')} USING (code)""")
SQL["exact_dedup_counts"] = q(VOTES, "SELECT (SELECT count(*) FROM raw)::BIGINT AS raw_rows, (SELECT count(*) FROM exact)::BIGINT AS distinct_rows")
SQL["semantic_dedup"] = q(VOTES, "SELECT bucket, source, count(*)::BIGINT AS votes, count(DISTINCT text)::BIGINT AS texts FROM sem GROUP BY ALL")
SQL["conflict_items"] = q(VOTES, "SELECT bucket, source, text FROM conf")
SQL["conflict_pairs"] = q(VOTES, "SELECT bucket, source, text, annotator, judgments::BIGINT AS judgments FROM pairs")
SQL["retained_votes"] = q(VOTES, "SELECT labels, confidence, count(*)::BIGINT AS votes FROM kept GROUP BY ALL")
SQL["vote_shares"] = q(ITEMS, "SELECT item_id, n_annotators, n_votes, round(confidence_mean, 6) AS confidence_mean, " + ", ".join(f"round(votes_{c}::DOUBLE / n_votes, 6) AS human_{c}" for c in CODES) + " FROM items")
SQL["eligible_items"] = q(ITEMS, "SELECT bucket, source, count(*)::BIGINT AS items FROM elig GROUP BY ALL")
SQL["excluded_items"] = q(ITEMS, "SELECT item_id, 'few annotators' AS reason FROM items WHERE n_annotators < 3 UNION ALL SELECT sha256(to_json([bucket, source, text])::VARCHAR), 'conflict' FROM conf")
SQL["annotator_histogram"] = q(ITEMS, "SELECT n_annotators, count(*)::BIGINT AS items FROM items GROUP BY ALL")
SQL["half_ties"] = q(LONG, "SELECT code, CASE WHEN h > 0.5 THEN 'pos' WHEN h < 0.5 THEN 'neg' ELSE 'tie' END AS side, count(*)::BIGINT AS items, (count(*) FILTER (h = 0.5))::BIGINT AS at_half FROM long GROUP BY ALL")
SQL["audit_summary"] = q(ITEMS, "SELECT " + ", ".join(f"(SELECT count(*) FROM {t})::BIGINT AS {n}" for n, t in (("raw_rows", "raw"), ("after_exact", "exact"), ("after_semantic", "sem"), ("conflicting_pairs", "pairs"), ("conflicted_items", "conf"), ("retained_votes", "kept"), ("retained_items", "items"), ("eligible_items", "elig"))))
_CONFIG = '{"codes":["A","N","R","F","O","BULK"],"dev_items_target":1000,"min_annotators_required":3,"seed":42,"sensitivity_items_target":1000}'
_LISTED = lambda x, t, where="TRUE": f"(SELECT coalesce(to_json(list_sort(list(DISTINCT {x})))::VARCHAR, '[]') FROM {t} WHERE {where})"
SQL["audit_record"] = q(ITEMS + _split("elig", 1000, 1000) + """,
respelt AS (SELECT bucket, source, text, annotator, array_to_string(list_sort(list_distinct(string_split(annotation, ','))), ',') AS labels, confidence FROM exact GROUP BY ALL HAVING count(*) > 1),
hist AS (SELECT n_annotators AS k, count(*) AS v FROM items GROUP BY 1)""", " UNION ALL ".join(f"SELECT '{field}' AS field, ({value})::VARCHAR AS value" for field, value in {
    "pipeline_version": "'1'", "config_fingerprint": f"sha256('{_CONFIG}')", "min_annotators_required": "3", "dev_items_target": "1000", "sensitivity_items_target": "1000",
    "raw_rows_before_exact_dedup": "SELECT count(*) FROM raw", "raw_rows_after_exact_dedup": "SELECT count(*) FROM exact",
    "exact_duplicate_rows_removed": "(SELECT count(*) FROM raw) - (SELECT count(*) FROM exact)", "semantic_duplicates_removed": "(SELECT count(*) FROM exact) - (SELECT count(*) FROM sem)",
    "semantic_duplicate_groups": "SELECT count(DISTINCT (bucket, source, text, annotator)) FROM respelt", "conflicting_item_annotator_groups": "SELECT count(*) FROM pairs",
    "items_excluded_for_conflicts": "SELECT count(*) FROM conf", "rows_excluded_for_conflicting_items": "(SELECT count(*) FROM sem) - (SELECT count(*) FROM kept)",
    "items_before_conflict_exclusion": "SELECT count(DISTINCT (bucket, source, text)) FROM raw", "items_remaining_after_conflict_exclusion": "SELECT count(*) FROM items",
    "retained_item_annotator_pairs_unique": "SELECT count(*) = count(DISTINCT (bucket, source, text, annotator)) FROM kept",
    "items_excluded_lt_min_annotators": "SELECT count(*) FROM items WHERE n_annotators < 3", "unique_items_all": "SELECT count(*) FROM items", "eligible_items": "SELECT count(*) FROM elig",
    "annotator_count_distribution_all": """SELECT '{' || coalesce(string_agg('"' || k || '":' || v, ',' ORDER BY k), '') || '}' FROM hist""",
    "dev_items": "SELECT count(*) FROM assigned WHERE split = 'dev'", "test_items": "SELECT count(*) FROM assigned WHERE split = 'test'", "sensitivity_items": "SELECT count(*) FROM assigned WHERE sensitivity",
    "exact_text_grouped_across_splits": "SELECT count(*) = 0 FROM (SELECT text FROM assigned GROUP BY text HAVING count(DISTINCT split) > 1)",
    "cross_source_exact_text_groups": "SELECT count(*) FROM (SELECT text FROM raw GROUP BY text HAVING count(DISTINCT (bucket, source)) > 1)",
    "sources": _LISTED("source", "raw"), "buckets": _LISTED("bucket", "raw"), "source_cells": _LISTED("bucket || ' :: ' || source", "raw"),
    "source_cell_count": "SELECT count(DISTINCT (bucket, source)) FROM raw", "confidence_values": _LISTED("confidence", "raw", "confidence <> ''"),
    "atomic_labels": _LISTED("label", "(SELECT unnest(string_split(labels, ',')) AS label FROM sem)"),
    "exact_half_ties_by_code": "SELECT '{' || " + " || ',' || ".join(f"""'"{c}":' || count(*) FILTER (2 * votes_{c} = n_votes)""" for c in CODES) + " || '}' FROM elig",
}.items()))
SQL["source_cells"] = q(ITEMS, "SELECT count(DISTINCT cell)::BIGINT AS cells, string_agg(DISTINCT cell, '|' ORDER BY cell) AS names FROM (SELECT bucket || ' :: ' || source AS cell FROM elig)")
SQL["atomic_labels"] = q(VOTES, "SELECT label, count(*)::BIGINT AS votes, count(DISTINCT (bucket, source, text))::BIGINT AS items FROM (SELECT *, unnest(string_split(labels, ',')) AS label FROM sem) GROUP BY label")
SQL["confidence_levels"] = q(VOTES, "SELECT confidence, count(*)::BIGINT AS votes, (CASE confidence WHEN 'Not Confident' THEN 0.0 WHEN 'Somewhat Confident' THEN 0.5 WHEN 'Confident' THEN 1.0 END)::DOUBLE AS value FROM sem GROUP BY confidence")
SQL["unknown_labels"] = q(VOTES, "SELECT DISTINCT label FROM (SELECT unnest(string_split(labels, ',')) AS label FROM sem) WHERE label NOT IN ('A', 'N', 'F', 'O', 'BULK')")
SQL["item_ids"] = q(DOCS, "SELECT sha256(to_json([bucket, source, doc_id::VARCHAR])::VARCHAR) AS item_id FROM docs")
SQL["content_ids"] = q(DOCS, "SELECT content_id, count(*)::BIGINT AS documents FROM docs GROUP BY ALL")
SQL["label_signatures"] = q(VOTES, "SELECT sg AS signature, sg AS again, count(*)::BIGINT AS rows FROM (SELECT array_to_string(list_sort(list_distinct(string_split(annotation, ','))), ',') AS sg FROM raw) GROUP BY ALL")
SQL["grouped_split"] = q(DOCS + _groups("docs", 100, "dev", "devs"), "SELECT sha256(text) AS content_id, size::BIGINT AS size, taken_before FROM devs")
SQL["sensitivity_subset"] = q(DOCS + _split("docs", 100, 50), "SELECT split, sensitivity, count(*)::BIGINT AS documents, count(DISTINCT content_id)::BIGINT AS texts FROM assigned GROUP BY ALL")
SQL["leak_check"] = q(DOCS + _split("docs", 100, 50) + ", planted AS (SELECT text, CASE WHEN doc_id % 10 = 0 THEN 'planted' ELSE split END AS split FROM assigned)",
    " UNION ALL ".join(f"SELECT text, count(DISTINCT split)::BIGINT AS splits FROM {t} GROUP BY text HAVING count(DISTINCT split) > 1" for t in ("planted", "assigned")))
SQL["cross_source_texts"] = q(DOCS, "SELECT content_id, count(DISTINCT (bucket, source))::BIGINT AS cells FROM docs GROUP BY ALL HAVING count(DISTINCT (bucket, source)) > 1")
SQL["hash_threshold_split"] = "SELECT CASE WHEN substr(sha256('next:' || text), 1, 16) < '1999999999999a00' THEN 'dev' ELSE 'test' END AS split, count(*)::BIGINT AS documents FROM documents GROUP BY ALL"
SQL["long_scores"] = q(LONG, f"SELECT item_id, code, {r('h', 'p', 'q')} FROM long")
SQL["wide_scores"] = q(LONG, "SELECT item_id, " + ", ".join(f'round(max(p) FILTER (code = \'{c}\'), 6) AS "{c}"' for c in CODES) + " FROM long GROUP BY item_id")
SQL["prediction_join"] = q(LONG, f"SELECT code, n, {r('mean_p', 'mean_h')} FROM (SELECT code, count(*)::BIGINT AS n, avg(p) AS mean_p, avg(h) AS mean_h FROM long GROUP BY code)")
SQL["prediction_completeness"] = q(ITEMS, "SELECT item_id, n_annotators FROM elig WHERE item_id[1] = '0'")
SQL["key_disjointness"] = q(SPLIT, "SELECT item_id, 'sound' AS side FROM (SELECT item_id FROM d INTERSECT SELECT item_id FROM t) UNION ALL SELECT DISTINCT item_id, 'planted' AS side FROM d WHERE item_id IN (SELECT item_id FROM t) OR item_id LIKE 'a%'")
SQL["cell_joins"] = q(LONG, f"SELECT bucket, source, code, {r('human', 'soft', 'hard')} FROM (SELECT bucket, source, code, avg(h) AS human, avg(p) AS soft, avg(hp) AS hard FROM long2 GROUP BY ALL)")
_METRICS = ["squared_loss", "hard_squared_loss", "absolute_loss", "hard_absolute_loss", "rho"]
SQL["foundation_metrics"] = q(SPLIT + f""",
m AS (SELECT * FROM (SELECT code, avg((p - h) ** 2) AS squared_loss, avg((hp - h) ** 2) AS hard_squared_loss, avg(abs(p - h)) AS absolute_loss, avg(abs(hp - h)) AS hard_absolute_loss FROM t GROUP BY code) JOIN {rho('t', 'code', 'uh', 'up')} USING (code))""", macro("m", _METRICS))
SQL["loss_deltas"] = q(SPLIT + ", m AS (SELECT code, avg((hp - h) ** 2 - (p - h) ** 2) AS squared_delta, avg(abs(hp - h) - abs(p - h)) AS absolute_delta FROM t GROUP BY code)", macro("m", ["squared_delta", "absolute_delta"]))
SQL["pairwise_disagreement_rho"] = q(SPLIT + ", pw AS (SELECT code, up, round(2 * n_annotators * h * (1 - h) / (n_annotators - 1), 12) AS dis FROM t), m AS " + rho("pw", "code", "up", "dis"), macro("m", ["rho"]))
SQL["confidence_vs_uncertainty"] = q(SPLIT + ", ci AS (SELECT item_id, round(avg(up), 10) AS u, round(1 - any_value(confidence_mean), 10) AS doubt FROM t GROUP BY item_id)", f"SELECT {r('rho')} FROM {rho('ci', '', 'u', 'doubt')}")
SQL["brier_identity"] = q(LONG, f"""SELECT code, {r('share_delta', 'vote_delta', 'coder_loss', 'vote_absolute')} FROM (SELECT code, avg((hp - h) ** 2 - (p - h) ** 2) AS share_delta,
  avg((h * (1 - hp) ** 2 + (1 - h) * hp ** 2) - (h * (1 - p) ** 2 + (1 - h) * p ** 2)) AS vote_delta,
  sum(n_votes * ((p - h) ** 2 + h * (1 - h))) / sum(n_votes) AS coder_loss, avg(h * (1 - p) + (1 - h) * p) AS vote_absolute FROM long2 GROUP BY code)""")

REVIEW = SPLIT + """,
ri AS (SELECT item_id, round(sum((p - h) ** 2), 10) AS sse, round(avg(up), 10) AS entropy, round(avg(p), 10) AS mean_p FROM t GROUP BY item_id),
nn AS (SELECT count(*) AS n FROM ri),
bud AS (SELECT b::BIGINT AS budget, round_even(n * b / 100.0::DOUBLE, 0)::BIGINT AS k FROM nn, (VALUES (0), (5), (10), (20), (30)) v(b))"""


def _curve(score: str) -> str:
    return f"""(SELECT budget, k AS reviewed, coalesce(sum(sse) FILTER (rk > k), 0) / ((SELECT n FROM nn) * 6) AS mse, '{score}' AS method FROM
  (SELECT sse, row_number() OVER (ORDER BY {score} DESC, item_id) AS rk FROM ri), bud GROUP BY budget, k)"""


SQL["triage_targeted"] = q(REVIEW, f"SELECT budget, reviewed, {r('mse')} FROM {_curve('entropy')}")
SQL["triage_methods"] = q(REVIEW, f"SELECT budget, reviewed, method, {r('mse')} FROM (" + " UNION ALL ".join(f"SELECT * FROM {_curve(s)}" for s in ("entropy", "mean_p", "sse")) + ")")
RANDOM = """,
rr AS (SELECT rep, item_id, row_number() OVER (PARTITION BY rep ORDER BY sha256('review:45:' || rep || ':' || item_id)) AS rk FROM ri, range(200) g(rep))"""
SQL["triage_random"] = q(REVIEW + RANDOM, f"""SELECT budget, {r('mse_mean')}, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high FROM
  (SELECT budget, avg(mse) AS mse_mean, quantile_cont(mse, 0.025) AS lo, quantile_cont(mse, 0.975) AS hi FROM
   (SELECT rep, budget, coalesce(sum(sse) FILTER (rk > k), 0) / ((SELECT n FROM nn) * 6) AS mse FROM rr JOIN ri USING (item_id), bud GROUP BY ALL) GROUP BY budget)""")
_TARGETED = [f"targeted_{b}" for b in (5, 10, 20, 30)]
CELLS = REVIEW + """,
rt AS (SELECT t.*, rk FROM t JOIN (SELECT item_id, row_number() OVER (ORDER BY entropy DESC, item_id) AS rk FROM ri) USING (item_id)),
cell AS (SELECT bucket, source, code, count(*)::BIGINT AS n, avg(h) AS human, avg(p) AS soft, avg(hp) AS hard, """ + ", ".join(
    f"avg(CASE WHEN rk <= (SELECT k FROM bud WHERE budget = {b}) THEN h ELSE p END) AS targeted_{b}" for b in (5, 10, 20, 30)) + " FROM rt GROUP BY ALL)"
SQL["cell_recovery"] = q(CELLS, f"SELECT bucket, source, code, n, {r('human', 'soft', 'hard', *_TARGETED)} FROM cell")
SQL["cell_recovery_summary"] = q(CELLS, f"SELECT method, {r('mae_unweighted', 'mae_weighted')} FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, avg(abs({m} - human)) AS mae_unweighted, sum(n * abs({m} - human)) / sum(n) AS mae_weighted FROM cell" for m in ("soft", "hard", *_TARGETED)) + ")")
RECOVERY = REVIEW + RANDOM + """,
re AS (SELECT rep, bucket, source, code, budget, count(*) AS n, avg(h) AS hu, avg(CASE WHEN rk <= k THEN h ELSE p END) AS e FROM t JOIN rr USING (item_id), bud WHERE budget > 0 GROUP BY ALL)"""
SQL["random_cell_recovery"] = q(RECOVERY, f"""SELECT budget, {r('mae_unweighted', 'mae_weighted')} FROM (SELECT budget, avg(a) AS mae_unweighted, avg(w) AS mae_weighted FROM
  (SELECT rep, budget, avg(abs(e - hu)) AS a, sum(n * abs(e - hu)) / sum(n) AS w FROM re GROUP BY ALL) GROUP BY budget)""")
SQL["random_cell_means"] = q(RECOVERY, f"SELECT bucket, source, code, budget, n, {r('random_mean')} FROM (SELECT bucket, source, code, budget, any_value(n)::BIGINT AS n, avg(e) AS random_mean FROM re GROUP BY ALL)")
SQL["cell_min_clusters"] = q(ITEMS, "SELECT bucket, source, count(DISTINCT content_id)::BIGINT AS clusters, b.least::BIGINT AS least FROM elig, (VALUES (200), (700)) b(least) GROUP BY ALL HAVING count(DISTINCT content_id) >= b.least")
_W = ["mean_abs_change", "flip_rate", "canonical_loss", "strict_loss", "rho_pq", "rho_p", "rho_q", "loss_delta", "rho_delta"]
SQL["wording_sensitivity"] = q(SPLIT + f""",
m AS (SELECT *, strict_loss - canonical_loss AS loss_delta, rho_q - rho_p AS rho_delta FROM
  (SELECT code, avg(abs(q - p)) AS mean_abs_change, avg((hp <> hq)::INT)::DOUBLE AS flip_rate, avg((p - h) ** 2) AS canonical_loss, avg((q - h) ** 2) AS strict_loss FROM s GROUP BY code)
  JOIN {rho('s', 'code', 'p', 'q', 'rho_pq')} USING (code) JOIN {rho('s', 'code', 'uh', 'up', 'rho_p')} USING (code) JOIN {rho('s', 'code', 'uh', 'uq', 'rho_q')} USING (code))""", macro("m", _W))
SQL["strict_sensitivity_summary"] = q(SPLIT + f""",
m AS (SELECT * FROM (SELECT code, avg(h) AS mean_h, avg(p) AS mean_p, avg(q) AS mean_q, avg(p - h) AS bias_p, avg(q - h) AS bias_q FROM s GROUP BY code) JOIN {rho('s', 'code', 'p', 'q')} USING (code))""",
    macro("m", ["mean_h", "mean_p", "mean_q", "bias_p", "bias_q", "rho"]))
CALIBRATED = SPLIT + """,
cm AS (SELECT code, sum(n_annotators * p) / sum(n_annotators) AS mp, sum(n_annotators * h) / sum(n_annotators) AS mh, sum(n_annotators) AS sw, count(*) AS n, avg(h) AS constant FROM d GROUP BY code),
fit AS (SELECT code, n, sw, mh AS coder_constant, constant, slope, mh - slope * mp AS intercept FROM (SELECT cm.*, slope FROM cm JOIN
  (SELECT code, CASE WHEN sum(n_annotators * (p - mp) ** 2) <= 1e-12 * greatest(any_value(sw), 1) THEN 0 ELSE sum(n_annotators * (p - mp) * (h - mh)) / sum(n_annotators * (p - mp) ** 2) END AS slope
   FROM d JOIN cm USING (code) GROUP BY code) USING (code))),
ct AS (SELECT t.*, constant, greatest(0, least(1, intercept + slope * p)) AS cal FROM t JOIN fit USING (code))"""
SQL["calibration_fit"] = q(CALIBRATED, f"SELECT code, n::BIGINT AS n, sw::BIGINT AS weight_sum, {r('intercept', 'slope', 'constant')} FROM fit")
SQL["calibration_apply"] = q(CALIBRATED, "SELECT item_id, code, round(cal, 4) AS calibrated FROM ct")
_M = ["squared_loss", "absolute_loss", "signed_bias", "cell_mae", "cell_mae_weighted"]
SQL["method_comparison"] = q(CALIBRATED + ", fl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS method, bucket, source, code, h, {e}::DOUBLE AS e FROM ct" for k, e in (("raw", "p"), ("hard", "hp"), ("constant", "constant"), ("calibrated", "cal"))) + """),
m AS (SELECT * FROM (SELECT method, code, avg((e - h) ** 2) AS squared_loss, avg(abs(e - h)) AS absolute_loss, avg(e - h) AS signed_bias FROM fl GROUP BY ALL) JOIN
  (SELECT method, code, avg(err) AS cell_mae, sum(n * err) / sum(n) AS cell_mae_weighted FROM (SELECT method, code, bucket, source, count(*) AS n, abs(avg(e) - avg(h)) AS err FROM fl GROUP BY ALL) GROUP BY ALL) USING (method, code))""", macro("m", _M, "method"))
SQL["prevalence_baselines"] = q(CALIBRATED, f"SELECT code, {r('constant', 'coder_constant')} FROM fit")
_C = ["mean_h", "mean_p", "signed_bias", "squared_loss", "absolute_loss", "sharpness", "mean_entropy"]
SQL["marginal_calibration"] = q(SPLIT, f"""SELECT split, code, n, {r(*_C)} FROM (SELECT split, code, count(*)::BIGINT AS n, avg(h) AS mean_h, avg(p) AS mean_p, avg(p - h) AS signed_bias, avg((p - h) ** 2) AS squared_loss,
  avg(abs(p - h)) AS absolute_loss, stddev_pop(p) AS sharpness, avg(up) AS mean_entropy FROM sl GROUP BY ALL)""")
SQL["reliability_bins"] = q(SPLIT, f"""SELECT code, bin::BIGINT AS bin, n, {r('mean_p', 'mean_h')} FROM (SELECT code, ((rk - 1) * least(10, c)) // c AS bin, avg(p) AS mean_p, avg(h) AS mean_h, count(*)::BIGINT AS n FROM
  (SELECT code, p, h, row_number() OVER (PARTITION BY code ORDER BY p, item_id) AS rk, count(*) OVER (PARTITION BY code) AS c FROM t) GROUP BY ALL)""")
SQL["disagreement_auc"] = q(SPLIT + ", mx AS (SELECT *, h > 0 AND h < 1 AS mixed FROM t)", f"""SELECT code, {r('prevalence', 'p_at_zero', 'p_at_mixed', 'p_at_one', 'auc_entropy', 'auc_p')} FROM
  (SELECT code, avg(mixed::INT)::DOUBLE AS prevalence, avg(p) FILTER (h = 0) AS p_at_zero, avg(p) FILTER (mixed) AS p_at_mixed, avg(p) FILTER (h = 1) AS p_at_one FROM mx GROUP BY code)
  JOIN {auc('mx', 'code', 'mixed', 'up', 'auc_entropy')} USING (code) JOIN {auc('mx', 'code', 'mixed', 'p', 'auc_p')} USING (code)""")
LABELLED = "lb AS (SELECT labels.*, n_chars::DOUBLE AS score, lang FROM labels JOIN documents USING (doc_id))"
SQL["quality_toxicity_auc"] = q(LABELLED, f"SELECT lang, {r('auc')}, target FROM (" + " UNION ALL ".join(f"SELECT *, '{t}' AS target FROM {auc('lb', 'lang', t, 'score')}" for t in ("quality", "toxic")) + ")")
SQL["labels_reliability"] = q(LABELLED, f"""SELECT 'all' AS code, bin::BIGINT AS bin, n, {r('mean_p', 'mean_h')} FROM (SELECT ((rk - 1) * least(7, c)) // c AS bin, avg(score) AS mean_p, avg(quality)::DOUBLE AS mean_h, count(*)::BIGINT AS n FROM
  (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS rk, count(*) OVER () AS c FROM lb) GROUP BY bin)""")
SQL["bootstrap_loss_ci"] = q(SPLIT + boot_means({"squared_delta": "(hp - h) ** 2 - (p - h) ** 2", "absolute_delta": "abs(hp - h) - abs(p - h)"}, "t"), "")
SQL["paired_bootstrap"] = q(CALIBRATED + boot_means({f"{m}_{n}": e.format(o=o) for n, o in (("raw", "p"), ("hard", "hp"), ("constant", "constant")) for m, e in (("squared", "(cal - h) ** 2 - ({o} - h) ** 2"), ("absolute", "abs(cal - h) - abs({o} - h)"), ("bias", "cal - {o}"))}, "ct"), "")
SQL["strict_bootstrap"] = q(SPLIT + boot_means({"squared_delta": "(q - h) ** 2 - (p - h) ** 2", "absolute_delta": "abs(q - h) - abs(p - h)", "bp": "p - h", "bq": "q - h"}, "s",
    {"squared_delta": "v_squared_delta", "absolute_delta": "v_absolute_delta", "bias_size": "abs(v_bq) - abs(v_bp)"}).replace(", 6)", ", 8)"), "")
SQL["bootstrap_spearman_ci"] = q(SPLIT + BOOT.format(rows="t", ns="boot", seed=43) + f""",
big AS (SELECT rep, code, uh, up FROM t JOIN w USING (item_id), range(m)),
rp AS {rho('big', 'rep, code', 'uh', 'up')}, pt AS {rho('t', 'code', 'uh', 'up', 'estimate')},
r2 AS (SELECT code, rho FROM rp UNION ALL SELECT 'macro', avg(rho) FROM rp GROUP BY rep), p2 AS (SELECT code, estimate FROM pt UNION ALL SELECT 'macro', avg(estimate) FROM pt)""",
    f"SELECT code, {r('estimate')}, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high FROM p2 JOIN (SELECT code, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM r2 GROUP BY code) USING (code)")
SQL["cluster_bootstrap"] = q(DOCS + """,
cl AS (SELECT content_id, sum(quality)::DOUBLE AS s, count(*) AS c FROM labels JOIN docs USING (doc_id) GROUP BY content_id)""" + poisson("cl", "content_id", "cluster", 44, 2000) + """,
bt AS (SELECT rep, sum(m * s) / sum(m * c) AS v FROM w JOIN cl USING (content_id) GROUP BY rep)""",
    "SELECT round((SELECT sum(s) / sum(c) FROM cl), 6) AS estimate, (SELECT count(*) FROM cl)::BIGINT AS clusters, round(quantile_cont(v, 0.025), 6) AS ci95_low, round(quantile_cont(v, 0.975), 6) AS ci95_high FROM bt")
_LISTS = (("closest", "true", "abs(p - 0.5)", 3), ("positive_disagreement", "p > 0.5 AND h < 0.5", "-abs(p - 0.5)", 3), ("negative_disagreement", "p < 0.5 AND h > 0.5", "-abs(p - 0.5)", 3), ("low", "h < 0.5", "h", 1), ("mixed", "h > 0 AND h < 1", "abs(h - 0.5)", 1), ("high", "h > 0.5", "-h", 1))
_cases, _used = "", []
for _name, _where, _order, _n in _LISTS:
    _anti = " AND (code, item_id) NOT IN (" + " UNION ALL ".join(f"SELECT code, item_id FROM c_{u}" for u in _used) + ")" if _used else ""
    _cases += f""",
c_{_name} AS (SELECT code, '{_name}' AS section, row_number() OVER (PARTITION BY code ORDER BY round({_order}, 12), item_id) AS place, item_id FROM d WHERE {_where}{_anti} QUALIFY place <= {_n})"""
    _used.append(_name)
SQL["review_cases"] = q(SPLIT + _cases, " UNION ALL ".join(f"SELECT code, section, place::BIGINT AS place, item_id FROM c_{u}" for u in _used))
JOBS = """
jb AS (SELECT concat_ws(':', conv_id, turn) AS item_id, CASE WHEN role = 'assistant' THEN 'strict' ELSE 'canonical' END AS variant, sha256(text) AS state, text FROM conversations),
cc AS (SELECT *, CASE WHEN ('0x' || substr(sha256('drift:' || item_id), 1, 8))::BIGINT % 50 = 0 THEN 'm2' ELSE 'm1' END AS returned_model FROM jb WHERE ('0x' || substr(sha256('done:' || item_id), 1, 8))::BIGINT % 3 <> 0),
pd AS (SELECT * FROM jb WHERE (item_id, variant, state) NOT IN (SELECT item_id, variant, state FROM cc))"""
SQL["pending_jobs"] = q(JOBS, "SELECT variant, count(*)::BIGINT AS jobs, min(item_id) AS first_item FROM pd GROUP BY variant")
SQL["next_jobs"] = q(JOBS, "SELECT item_id, variant FROM pd ORDER BY item_id, variant LIMIT 25")
SQL["completed_jobs"] = q(JOBS, "SELECT variant, count(*)::BIGINT AS jobs FROM cc GROUP BY variant")
SQL["response_records"] = q(JOBS, f"SELECT returned_model, consistent, calls, {r('mean_p')}, tokens FROM (SELECT returned_model, returned_model = 'm1' AS consistent, count(*)::BIGINT AS calls, avg((length(text) % 101) / 100.0::DOUBLE) AS mean_p, sum(length(text))::BIGINT AS tokens FROM cc GROUP BY ALL)")
SQL["usage_rollup"] = q(JOBS, "SELECT variant, returned_model, sum(length(text))::BIGINT AS input_tokens, (7 * count(*))::BIGINT AS output_tokens FROM cc GROUP BY ALL")
SQL["model_drift"] = q(JOBS, "SELECT DISTINCT returned_model FROM cc WHERE returned_model <> 'm1'")
SQL["payload_flatten"] = "SELECT event_type, count(*)::BIGINT AS events, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY ALL"
SQL["range_violations"] = "SELECT count(*)::BIGINT AS rows, (count(*) FILTER (l_quantity <> floor(l_quantity)))::BIGINT AS fractional FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 1 AND l_quantity BETWEEN 0 AND 1)"
SQL["constant_columns"] = "SELECT * FROM (SELECT 'o_orderstatus' AS \"column\", count(DISTINCT o_orderstatus)::BIGINT AS \"values\" FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::BIGINT FROM orders) WHERE \"values\" <> 1"
SQL["duplicate_keys"] = "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"
SQL["blank_identity"] = q(VOTES, "SELECT bucket, count(*)::BIGINT AS rows FROM raw WHERE confidence = '' GROUP BY ALL")
_CELL = "(SELECT DISTINCT lang, source FROM labels JOIN documents USING (doc_id) WHERE {})"
_TOXIC, _POOR = (f"SELECT * FROM {_CELL.format(w)}" for w in ("toxic = 1", "quality = 0"))
SQL["vocabulary_difference"] = f"({_TOXIC} EXCEPT {_POOR}) UNION ALL ({_POOR} EXCEPT {_TOXIC})"
SQL["scalar_functions"] = r"""SELECT doc_id, regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]', ' ', 'g') AS line, printf('%.3f', n_chars / 7.0::DOUBLE) AS number, upper(lang[1]) || lower(lang[2:]) AS title,
  round_even(n_chars / 10.0::DOUBLE, 0)::BIGINT AS half_even, n_chars % 2 = 0 AS flag, 'source+cell+name+2' AS parts FROM documents"""
SQL["evidence_fingerprint"] = """WITH h AS (SELECT sha256('{"item_id":"' || concat_ws(':', conv_id, turn) || '","variant":"' || CASE WHEN role = 'assistant' THEN 'strict' ELSE 'canonical' END || '"'
    || coalesce(',"state":"' || sha256(text) || '"', '') || '}') AS h FROM conversations),
l AS (SELECT h AS b, h || ':' || count(*) AS h, count(*) AS n FROM h GROUP BY h),
l9 AS (SELECT b[:9] AS b, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM l GROUP BY 1),
l6 AS (SELECT b[:6] AS b, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM l9 GROUP BY 1),
l3 AS (SELECT b[:3] AS b, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM l6 GROUP BY 1)
SELECT sum(n)::BIGINT AS records, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM l3"""
SQL["release_frame"] = "WITH " + ITEMS.strip() + " SELECT item_id, content_id, bucket, source, n_annotators, n_votes, votes_BULK IN (0, n_votes) AS unanimous FROM items WHERE n_annotators >= 3"
SQL["label_groups"] = "WITH " + VOTES.strip() + """ SELECT bucket, count(*) AS votes,
  (count(*) FILTER (confidence <> '' AND list_has_any(string_split(labels, ','), ['A', 'R'])))::BIGINT AS returned_chosen, count(*) FILTER (confidence <> '') AS returned_answered,
  (count(*) FILTER (confidence <> '' AND list_has_any(string_split(labels, ','), ['O', 'N'])))::BIGINT AS open_chosen, count(*) FILTER (confidence <> '') AS open_answered
  FROM sem GROUP BY bucket"""


def _suite(source: str, rules: list[tuple[str, str, int]], ctes: str = "") -> str:
    """(rule, aggregate, wanted) rows as a report."""
    found = ", ".join(f"({a})::BIGINT AS r{i}" for i, (_, a, _) in enumerate(rules))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS rule, r{i} AS found, {w}::BIGINT AS wanted, r{i} = {w} AS holds FROM found" for i, (n, _, w) in enumerate(rules))
    return f"WITH {ctes}found AS (SELECT {found} FROM {source}) {rows}"


_outside = lambda c: f"count(*) FILTER ({c} IS NULL OR NOT {c} BETWEEN 0 AND 1)"
SQL["line_validation"] = _suite(
    "lineitem",
    [("unique l_orderkey, l_linenumber", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", 0), ("l_returnflag present", "count(*) FILTER (l_returnflag IS NULL)", 0)]
    + [(f"{c} in [0, 1]", _outside(c), 0) for c in ("l_discount", "l_tax", "l_quantity")]
    + [(f"{c} whole, 1 or more", f"count(*) FILTER ({c} <> floor({c}) OR {c} < 1)", 0) for c in ("l_quantity", "l_extendedprice")]
    + [("l_linestatus only O", "count(*) FILTER (l_linestatus <> 'O')", 0), ("l_linestatus has O", "max((l_linestatus = 'O')::INT)", 1)],
)
_RELEASE = LONG.strip() + ", wide AS (SELECT item_id, content_id, bucket, source, n_annotators, " + ", ".join(f"max(h) FILTER (code = '{c}') AS human_{c}, max(p) FILTER (code = '{c}') AS p_{c}" for c in CODES) + " FROM long GROUP BY ALL), "
SQL["release_validation"] = _suite(
    "wide",
    [("unique item_id", "count(*) - count(DISTINCT item_id)", 0)] + [(f"{c} present", f"count(*) FILTER ({c} IS NULL)", 0) for c in ("content_id", "bucket", "source")]
    + [(f"{k}_{c} in [0, 1]", _outside(f"{k}_{c}"), 0) for c in CODES for k in ("human", "p")]
    + [("n_annotators whole, 3 or more", "count(*) FILTER (n_annotators < 3)", 0), ("model only m1", "0", 0), ("model has m1", "1", 1), ("-1 rows", "count(*)", -1), ("unique bucket", "count(*) - count(DISTINCT bucket)", 0)]
    + [("n_annotators whole, 4 or more", "count(*) FILTER (n_annotators < 4)", 0), ("bucket only O", "count(*) FILTER (bucket <> 'O')", 0), ("bucket has O", "max((bucket = 'O')::INT)", 1), ("unanimous everywhere", "count(*) FILTER (human_BULK NOT IN (0, 1))", 0)],
    _RELEASE,
)
SQL["committed_calls"] = """
WITH jobs AS (SELECT conv_id || ':' || turn AS item_id, CASE role WHEN 'assistant' THEN 'strict' ELSE 'canonical' END AS variant FROM conversations),
told AS (SELECT *, (('0x' || substr(sha256('done:' || item_id), 1, 8))::BIGINT % 3 <> 0)::BIGINT AS held FROM jobs)
SELECT variant, held, count(*) AS calls, min(item_id) AS first_item FROM told GROUP BY ALL"""
SQL["one_to_one_join"] = f"""SELECT o_orderstatus, count(*) AS orders, sum(lines)::BIGINT AS lines, {r('quantity')} FROM (SELECT o_orderstatus, lines, quantity FROM orders
  JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""".replace("round((quantity)", "round((sum(quantity))")
SQL["spelling_check"] = """WITH f AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN ' r' ELSE l_returnflag END AS s FROM lineitem),
n AS (SELECT lower(trim(s)) AS label, count(DISTINCT s) AS spellings FROM f GROUP BY 1)
SELECT w.label, coalesce(n.spellings, 0) AS spellings FROM (VALUES ('a'), ('n'), ('r'), ('x')) w(label) LEFT JOIN n USING (label) WHERE coalesce(n.spellings, 0) <> 1"""
SQL["annotator_counts"] = q(ITEMS, "SELECT n_annotators, count(*) AS items FROM items WHERE n_annotators < 3 GROUP BY 1")
SQL["split_sizes"] = q(SPLIT, """SELECT "group", rows FROM (SELECT b.g AS "group", count(a.split)::BIGINT AS rows, any_value(b.low) AS low, any_value(b.high) AS high FROM (VALUES ('dev', 1000, 1050), ('test', 1, 10), ('absent', 1, 5)) b(g, low, high)
  LEFT JOIN assigned a ON a.split = b.g GROUP BY b.g) WHERE rows < low OR rows > high""")
SQL["unlabelled_documents"] = "SELECT lang, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL GROUP BY lang"
SQL["single_row"] = "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region WHERE r_name LIKE 'EU%'"
