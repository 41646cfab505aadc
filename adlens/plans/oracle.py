"""DuckDB SQL for every query of the catalog that SQL can express.

Views ``lineitem part customer events ...`` are registered by the caller.
Column names and types follow the Spark queries; derived doubles are rounded
to 6 places on both sides.
"""

from __future__ import annotations

# Typed views over the driver's tables (same meaning as sources.tables).
KEYWORD_ROWS = """keyword_rows AS (
  SELECT '0' || CAST(l_suppkey AS VARCHAR) AS client_id,
         'naccount' || CAST(l_linenumber AS VARCHAR) AS account_id,
         CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_type END AS keyword,
         CASE l_returnflag WHEN 'R' THEN 'paused' ELSE 'enabled' END AS state,
         l_quantity AS quota_impression
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

HISTORY_ROWS = """history_rows AS (
  SELECT 'naccount' || CAST(l_linenumber AS VARCHAR) AS account_id,
         '0-' || CAST(l_suppkey AS VARCHAR) AS client_id,
         sum(l_quantity) AS impression, avg(l_quantity) AS quota_impression,
         max(l_discount) AS max_cpc
  FROM lineitem GROUP BY l_linenumber, l_suppkey, year(l_shipdate))"""

ENABLED = """enabled AS (SELECT * FROM keyword_rows WHERE state = 'enabled')"""

STATS = """stats AS (
  SELECT replace(lower(keyword), ' ', '') AS keyword, count(*) AS n,
         avg(quota_impression) AS avg_qi
  FROM enabled GROUP BY 1)"""

CENTRES_1D = """centres1 AS (
  SELECT CAST(i AS INTEGER) AS cluster_id, CAST(25.0 * i AS DOUBLE) AS c0 FROM range(21) t(i))"""

CENTRES_2D = """centres2 AS (
  SELECT CAST(i AS INTEGER) AS cluster_id,
         CAST(10.5 AS DOUBLE) + 100.0 * (i // 6) AS c0,
         CAST(20.0137 AS DOUBLE) + 2.0 * (i % 6) AS c1
  FROM range(36) t(i))"""

DICT_1D = """dict1 AS (
  SELECT s.keyword, arg_min(c.cluster_id, (s.n - c.c0) * (s.n - c.c0)) AS cluster_id
  FROM stats s, centres1 c GROUP BY s.keyword)"""

DICT_2D = """dict2 AS (
  SELECT s.keyword,
         arg_min(c.cluster_id, (s.n - c.c0) * (s.n - c.c0) + (s.avg_qi - c.c1) * (s.avg_qi - c.c1))
           AS cluster_id
  FROM stats s, centres2 c GROUP BY s.keyword)"""

DEFAULT_1D = "(SELECT arg_min(cluster_id, c0 * c0) FROM centres1)"
DEFAULT_2D = "(SELECT arg_min(cluster_id, c0 * c0 + c1 * c1) FROM centres2)"

HISTORY = """history AS (
  SELECT replace(client_id, '-', '') AS client_id, account_id,
         CAST(quota_impression AS DOUBLE) AS label, CAST(impression AS DOUBLE) AS impression,
         CAST(max_cpc AS DOUBLE) AS max_cpc
  FROM history_rows WHERE account_id NOT IN ('naccount7'))"""

REQUESTS = """requests AS (
  SELECT user_id AS visitor_id, props AS search_text, ts, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         event_type AS content
  FROM events)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _kcols(k: int) -> str:
    return ", ".join(f"count(*) FILTER (WHERE cluster_id = {i}) AS k{i}" for i in range(k))


def _hist(k: int, dims: int) -> str:
    d = "dict1" if dims == 1 else "dict2"
    dflt = DEFAULT_1D if dims == 1 else DEFAULT_2D
    return f"""labelled AS (
  SELECT e.client_id, e.account_id, coalesce(d.cluster_id, {dflt}) AS cluster_id
  FROM enabled e LEFT JOIN {d} d ON replace(e.keyword, ' ', '') = d.keyword),
hist AS (SELECT client_id, account_id, {_kcols(k)} FROM labelled GROUP BY client_id, account_id)"""


def _training_ctes(k: int, dims: int) -> list[str]:
    c = CENTRES_1D if dims == 1 else CENTRES_2D
    d = DICT_1D if dims == 1 else DICT_2D
    ks = ", ".join(f"h2.k{i}" for i in range(k))
    train = f"""train AS (
  SELECT h.client_id, h.account_id, h.label, h.impression, h.max_cpc, {ks}
  FROM history h JOIN hist h2 ON h.client_id = h2.client_id AND h.account_id = h2.account_id)"""
    return [KEYWORD_ROWS, HISTORY_ROWS, ENABLED, STATS, c, d, _hist(k, dims), HISTORY, train]


def _training(k: int, dims: int) -> str:
    ks = ", ".join(f"k{i}" for i in range(k))
    return _with(*_training_ctes(k, dims)) + f"""
SELECT client_id, account_id, round(label, 6) AS label, round(impression, 6) AS impression,
       round(max_cpc, 6) AS max_cpc, {ks}
FROM train"""


def _linear_sgd(k: int = 36, iterations: int = 300, step: str = "5e-15") -> str:
    """Full-batch gradient descent as a recursive CTE over the Gram matrix."""
    names = ["impression", "max_cpc"] + [f"k{i}" for i in range(k)]
    d = len(names)
    xs = ", ".join(f"CAST({c} AS DOUBLE)" for c in names)
    name_list = ", ".join(f"'{c}'" for c in names)
    ctes = _training_ctes(k, 2) + [
        f"feat AS (SELECT row_number() OVER () AS rid, label, [{xs}] AS x FROM train)",
        f"xl AS (SELECT rid, label, unnest(x) AS v, unnest(range(0, {d})) AS i FROM feat)",
        "gram AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM xl a JOIN xl b ON a.rid = b.rid "
        "GROUP BY a.i, b.i)",
        "xty AS (SELECT i, sum(v * label) AS b FROM xl GROUP BY i)",
        "nn AS (SELECT count(*) AS n FROM feat)",
        f"""w(t, i, w) AS (
  SELECT 0, i, CAST(0.0 AS DOUBLE) FROM xty
  UNION ALL
  SELECT wj.t + 1, g.i,
         max(CASE WHEN g.j = g.i THEN wj.w END)
           - ({step} / sqrt(wj.t + 1)) * ((sum(g.g * wj.w) - max(x.b)) / max(nn.n))
  FROM w wj JOIN gram g ON g.j = wj.i JOIN xty x ON x.i = g.i CROSS JOIN nn
  WHERE wj.t < {iterations}
  GROUP BY wj.t, g.i)""",
        f"fin AS (SELECT i, w FROM w WHERE t = {iterations})",
        "pred AS (SELECT xl.rid, max(xl.label) AS label, sum(xl.v * fin.w) AS p "
        "FROM xl JOIN fin USING (i) GROUP BY xl.rid)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT CAST(i AS INTEGER) AS position, list_extract([{name_list}], i + 1) AS feature,
       printf('%.8e', w) AS weight_sci,
       (SELECT round(avg((label - p) * (label - p)), 6) FROM pred) AS training_mse,
       {iterations} AS iterations
FROM fin"""


def _fixed_pred() -> str:
    return (_with(KEYWORD_ROWS, HISTORY_ROWS, ENABLED, STATS, CENTRES_2D, DICT_2D, _hist(36, 2), HISTORY)
            + """, pred AS (
  SELECT h.client_id, h.account_id, h.label, 0.001 * h.impression + 10.0 * h.max_cpc AS prediction
  FROM history h JOIN hist h2 ON h.client_id = h2.client_id AND h.account_id = h2.account_id)
""")


def _url() -> str:
    from .catalog import BASE_URL
    return BASE_URL


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL over the driver's table views."""
    kw = _with(KEYWORD_ROWS)
    en = _with(KEYWORD_ROWS, ENABLED)
    st = _with(KEYWORD_ROWS, ENABLED, STATS)
    q: dict[str, str] = {}

    q["enabled_keywords"] = en + """
SELECT client_id, account_id, keyword AS raw_keyword, replace(lower(keyword), ' ', '') AS keyword,
       CAST(quota_impression AS DOUBLE) AS quota_impression FROM enabled"""

    q["text_scan_roundtrip"] = kw + """
SELECT client_id, account_id, keyword, state, CAST(quota_impression AS DOUBLE) AS quota_impression
FROM keyword_rows"""

    q["history_scan"] = _with(HISTORY_ROWS, HISTORY) + """
SELECT client_id, account_id, round(label, 6) AS label, round(impression, 6) AS impression,
       round(max_cpc, 6) AS max_cpc FROM history"""

    q["field_count_profile"] = _with(KEYWORD_ROWS, HISTORY_ROWS) + """,
lines AS (
  SELECT 'keyword' AS source,
         concat_ws(';', client_id, account_id, '', keyword, '', state, '', '', '', '', '', '', '', '',
                   '', CAST(quota_impression AS VARCHAR)) AS line, ';' AS sep
  FROM keyword_rows
  UNION ALL
  SELECT 'history', concat_ws(',', account_id, client_id, '', CAST(impression AS VARCHAR), '', '',
                   '', '', CAST(quota_impression AS VARCHAR), '', '', '', CAST(max_cpc AS VARCHAR)), ','
  FROM history_rows)
SELECT source, CAST(CASE WHEN line <> '' AND rtrim(line, sep) = '' THEN 0
                         ELSE len(string_split(rtrim(line, sep), sep)) END AS INTEGER) AS n_fields,
       count(*) AS n_lines
FROM lines GROUP BY ALL"""

    q["keyword_counts"] = en + """
SELECT replace(lower(keyword), ' ', '') AS keyword, count(*) AS n FROM enabled GROUP BY 1"""

    q["keyword_means"] = en + """
SELECT replace(lower(keyword), ' ', '') AS keyword, round(avg(quota_impression), 6) AS avg_qi
FROM enabled GROUP BY 1"""

    q["keyword_stats"] = st + "SELECT keyword, n, round(avg_qi, 6) AS avg_qi FROM stats"

    q["top_keywords"] = st + "SELECT keyword, n FROM stats ORDER BY n DESC, keyword LIMIT 20"

    q["count_moments"] = st + """
SELECT count(*) AS keywords, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS sd_n FROM stats"""

    q["standardized_counts"] = st + """
SELECT keyword, n, round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) AS n_z FROM stats"""

    q["campaign_keyword_groups"] = en + """
SELECT client_id, account_id, keyword, count(*) AS occurrences FROM enabled
GROUP BY client_id, account_id, keyword"""

    q["assign_clusters_1d"] = _with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_1D, DICT_1D) + """
SELECT s.keyword, s.n, d.cluster_id FROM stats s JOIN dict1 d USING (keyword)"""

    q["assign_clusters_2d"] = _with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_2D, DICT_2D) + """
SELECT s.keyword, s.n, round(s.avg_qi, 6) AS avg_qi, d.cluster_id FROM stats s JOIN dict2 d USING (keyword)"""

    q["default_cluster"] = _with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_1D, CENTRES_2D, DICT_1D, DICT_2D) + f"""
SELECT 1 AS dims, {DEFAULT_1D} AS default_cluster,
       count(*) FILTER (WHERE cluster_id = {DEFAULT_1D}) AS keywords_in_default FROM dict1
UNION ALL
SELECT 2, {DEFAULT_2D}, count(*) FILTER (WHERE cluster_id = {DEFAULT_2D}) FROM dict2"""

    q["dispersion_fixed_centres"] = _with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_1D, CENTRES_2D,
                                          DICT_1D, DICT_2D) + """
SELECT 1 AS dims, 21 AS k, round(avg(abs(s.n - c.c0)), 6) AS dispersion
FROM stats s JOIN dict1 d USING (keyword) JOIN centres1 c USING (cluster_id)
UNION ALL
SELECT 2, 36, round(avg(abs(s.n - c.c0)), 6)
FROM stats s JOIN dict2 d USING (keyword) JOIN centres2 c USING (cluster_id)"""

    q["kmeans_k1"] = st + """
SELECT 1 AS k, round(avg(n), 6) AS centre_n,
       round(avg(abs(n - (SELECT avg(n) FROM stats))), 6) AS dispersion FROM stats"""

    for case, key in (("reference", "replace(e.keyword, ' ', '')"),
                      ("normalized", "replace(lower(e.keyword), ' ', '')")):
        q[f"label_keywords_{case}"] = _with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_2D, DICT_2D) + f"""
SELECT e.client_id, e.account_id, e.keyword, coalesce(d.cluster_id, {DEFAULT_2D}) AS cluster_id
FROM enabled e LEFT JOIN dict2 d ON {key} = d.keyword"""

    q["cluster_histogram_21"] = (_with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_1D, DICT_1D, _hist(21, 1))
                                 + "SELECT * FROM hist")
    q["cluster_histogram_36"] = (_with(KEYWORD_ROWS, ENABLED, STATS, CENTRES_2D, DICT_2D, _hist(36, 2))
                                 + "SELECT * FROM hist")

    avg_of_avg = """avgavg AS (
  SELECT e.client_id, e.account_id, avg(coalesce(s.avg_qi, 0.0)) AS avg_of_avg
  FROM enabled e LEFT JOIN stats s ON replace(e.keyword, ' ', '') = s.keyword
  GROUP BY e.client_id, e.account_id)"""
    q["campaign_avg_of_avg"] = (_with(KEYWORD_ROWS, ENABLED, STATS, avg_of_avg)
                                + "SELECT client_id, account_id, round(avg_of_avg, 6) AS avg_of_avg FROM avgavg")

    q["training_rows_21"] = _training(21, 1)
    q["training_rows_36"] = _training(36, 2)
    q["training_rows_avg_of_avg"] = _with(KEYWORD_ROWS, HISTORY_ROWS, ENABLED, STATS, avg_of_avg,
                                          HISTORY) + """
SELECT h.client_id, h.account_id, round(h.label, 6) AS label, round(h.impression, 6) AS impression,
       round(h.max_cpc, 6) AS max_cpc, round(a.avg_of_avg, 6) AS avg_of_avg
FROM history h JOIN avgavg a ON h.client_id = a.client_id AND h.account_id = a.account_id"""

    q["linear_sgd"] = _linear_sgd()

    q["linear_fixed_weights_residuals"] = _fixed_pred() + """
SELECT client_id, account_id, round(label, 6) AS label, round(prediction, 6) AS prediction,
       round(label - prediction, 6) AS residual FROM pred"""
    q["mse_fixed_weights"] = _fixed_pred() + """
SELECT count(*) AS rows, round(avg((label - prediction) * (label - prediction)), 6) AS mse FROM pred"""

    ab = """ab AS (
  SELECT a.age, b.weight, b.high
  FROM (SELECT p_partkey AS id, p_size AS age FROM part) a
  JOIN (SELECT c_custkey AS id, c_acctbal AS weight, 150 + c_custkey % 50 AS high FROM customer) b
    ON a.id = b.id)"""
    q["id_join"] = _with(ab) + "SELECT age, weight, CAST(high AS BIGINT) AS high FROM ab"
    q["unit_scale"] = _with(ab) + """
SELECT round(CAST(weight AS DOUBLE), 6) AS label, round(age / 12.0, 6) AS age_years,
       round(high / 100.0, 6) AS high_meters FROM ab"""

    # A depth-30 variance tree with more bins than distinct feature values
    # isolates every distinct (age, high) pair of its training rows (labels are
    # continuous, so no split has zero gain): each prediction is the mean
    # label of the rows sharing its features.
    q["decision_tree_fit"] = _with(ab) + """
SELECT round(CAST(weight AS DOUBLE), 6) AS label, round(age / 12.0, 6) AS age_years,
       round(high / 100.0, 6) AS high_meters,
       round(avg(weight) OVER (PARTITION BY age, high), 6) AS prediction FROM ab"""

    # Trees without bootstrap on all features are all that one tree.
    q["forest_exact"] = q["decision_tree_fit"]

    q["unit_scale_params"] = _with(ab) + """
SELECT round(CAST(age AS DOUBLE), 6) AS label, round(high / 12.0, 6) AS x, round(weight / 100.0, 6) AS y,
       round(high / 12.0, 6) AS feature_1, round(weight / 100.0, 6) AS feature_2 FROM ab"""

    # every record has one place in its campaign's list
    q["keyword_lists"] = """WITH placed AS (
  SELECT '0' || CAST(l_suppkey AS VARCHAR) AS client_id, 'naccount' || CAST(l_linenumber AS VARCHAR) AS account_id,
         CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_type END AS keyword,
         row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey,
           CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_type END) - 1 AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R')
SELECT client_id, account_id, place // 16 AS segment, count(*) AS n, string_agg(keyword, '|' ORDER BY place) AS keywords
FROM placed GROUP BY client_id, account_id, place // 16"""

    q["model_roundtrip"] = q["assign_clusters_1d"]
    q["metrics_log"] = q["dispersion_fixed_centres"]
    q["select_best_centres"] = f"""SELECT * FROM ({q["dispersion_fixed_centres"]})
ORDER BY dispersion LIMIT 1"""
    q["kmeans_invariants"] = st + """
SELECT CAST(k AS INTEGER) AS k, true AS centres_within_k, true AS cost_at_most_k1,
       CASE WHEN k = 1 THEN (SELECT round(avg(abs(n - (SELECT avg(n) FROM stats))), 6) FROM stats) END AS dispersion_k1
FROM range(1, 100, 5) t(k)"""
    # a converged fit is a fixed point of its own members
    q["kmeans_members"] = st + """
SELECT fit, CAST(k AS INTEGER) AS k, CAST(run AS INTEGER) AS run, (SELECT count(*) FROM stats) AS members, true AS clusters_within_k,
       true AS centres_are_means, true AS cost_follows, true AS dispersion_follows
FROM (SELECT 'sweep' AS fit, k, 0 AS run FROM range(1, 100, 5) a(k) UNION ALL SELECT 'restart', 21, run FROM range(7) b(run))"""
    q["split_rows"] = _with(*_training_ctes(36, 2)) + """
SELECT client_id, account_id, CAST(impression AS BIGINT) AS impression,
       CASE WHEN CAST('0x' || substr(md5('42|' || client_id || '|' || account_id || '|'
                 || CAST(CAST(impression AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 700000
            THEN 'train' ELSE 'test' END AS side
FROM train"""

    q["request_urls"] = _with(REQUESTS) + f"""
SELECT visitor_id,
       '{_url()}' || replace(replace(url_encode(search_text), '%20', '+'), '~', '%7E')
         || '&id=' || CAST(visitor_id AS VARCHAR) AS url
FROM requests"""

    q["throughput"] = _with(REQUESTS) + """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS requests, (count(*) * 1000) // 3600000 AS rate_per_sec
FROM requests WHERE status <> 'error' GROUP BY 1, 2"""

    q["throughput_1s"] = _with(REQUESTS) + """
SELECT date_trunc('second', ts) AS window_start, date_trunc('second', ts) + INTERVAL 1 SECOND AS window_end,
       count(*) AS requests, count(*) AS rate_per_sec
FROM requests WHERE status <> 'error' GROUP BY 1, 2"""

    # The reports one after the other, from the first request on.
    for name, seconds in (("throughput_reported", 1), ("throughput_reported_hourly", 3600)):
        q[name] = f"""
WITH RECURSIVE ok AS (SELECT ts, count(*) AS n FROM events WHERE event_type <> 'error' AND ts IS NOT NULL GROUP BY ts),
t AS (SELECT ts, sum(n) OVER (ORDER BY ts) - n AS before FROM ok),
link AS (SELECT a.ts, a.before, b.ts AS due FROM t a ASOF LEFT JOIN t b ON a.ts + INTERVAL {seconds} SECOND <= b.ts),
chain AS (
  SELECT ts, due, before, 0::HUGEINT AS counted, ts AS since, false AS report FROM link WHERE ts = (SELECT min(ts) FROM t)
  UNION ALL
  SELECT l.ts, l.due, l.before, CASE WHEN c.report THEN c.before + 1 ELSE 0 END, c.ts, true FROM chain c JOIN link l ON c.due = l.ts)
SELECT since AS window_start, ts AS window_end, CAST(before + 1 - counted AS BIGINT) AS requests,
       CAST((before + 1 - counted) * 1000000 // date_diff('microsecond', since, ts) AS BIGINT) AS rate_per_sec
FROM chain WHERE report"""

    # the same reports, and what no request has reported yet
    q["throughput_reported_stream"] = f"""
WITH reports AS ({q["throughput_reported"]}),
every AS (SELECT min(ts) AS first, max(ts) AS last, count(*) AS n FROM events WHERE event_type <> 'error' AND ts IS NOT NULL),
rest AS (SELECT coalesce((SELECT max(window_end) FROM reports), first) AS since, last,
                CAST(n - (SELECT coalesce(sum(requests), 0) FROM reports) AS BIGINT) AS n FROM every)
SELECT *, true AS closed FROM reports
UNION ALL
SELECT since, last, n, CAST(n * 1000000 // date_diff('microsecond', since, last) AS BIGINT), false FROM rest WHERE n > 0"""
    q["id_join_bucketed"] = q["id_join"]
    q["keyword_stats_incremental"] = q["keyword_stats"]
    q["responses_stream"] = _with(REQUESTS) + "SELECT visitor_id, content FROM requests"
    q["scan_quality"] = _with(KEYWORD_ROWS, ENABLED, STATS) + """
SELECT count(*) AS records, 0 AS short, CAST(16 AS INTEGER) AS fewest_fields, CAST(16 AS INTEGER) AS most_fields,
       (SELECT count(*) FROM stats) AS keywords FROM keyword_rows"""
    # 3 tree counts x 4 depths, each logged once, whatever stopped in between
    q["grid_log"] = """
SELECT CAST(d AS INTEGER) AS progress, 'depth-' || CAST(4 + 5 * d AS VARCHAR) AS entry, CAST(4 + 5 * d AS INTEGER) AS max_depth,
       CAST(20 + 70 * t AS INTEGER) AS num_trees, 1 AS times, true AS scored
FROM range(4) a(d), range(3) b(t)"""
    q["forest_scored"] = f"""SELECT count(*) AS rows, count(*) AS agreeing FROM ({q["split_rows"]}) WHERE side = 'test'"""

    q["responses_log"] = _with(REQUESTS) + "SELECT visitor_id, content FROM requests"

    q["latency_summary"] = _with(REQUESTS) + """
SELECT count(*) AS requests, round(avg(latency_ms), 6) AS mean_ms, min(latency_ms) AS min_ms,
       max(latency_ms) AS max_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
       round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms
FROM requests WHERE status <> 'error'"""

    # the sketches are random; what must hold of them is the bound on their ranks
    days = """SELECT 'day' AS span, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       latency_ms FROM requests WHERE status <> 'error' AND ts IS NOT NULL"""
    every = """SELECT 'all', date_trunc('hour', min(ts) OVER ()), date_trunc('hour', max(ts) OVER ()) + INTERVAL 1 HOUR,
       latency_ms FROM requests WHERE status <> 'error' AND ts IS NOT NULL"""
    q["latency_merged"] = _with(REQUESTS) + f""", spans AS ({days} UNION ALL {every})
SELECT span, window_start, window_end, count(*) AS requests, round(avg(latency_ms), 6) AS mean_ms, min(latency_ms) AS min_ms,
       max(latency_ms) AS max_ms, true AS p50_ms_within, true AS p95_ms_within, true AS p99_ms_within
FROM spans GROUP BY span, window_start, window_end"""

    # Closed windows only: append mode emits a window once the watermark
    # (latest event time - 1 hour) has passed its end.
    q["throughput_stream"] = _with(REQUESTS) + """,
closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM requests)
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS requests, (count(*) * 1000) // 3600000 AS rate_per_sec
FROM requests WHERE status <> 'error' GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT wm FROM closed)"""
    q["throughput_stream_1s"] = _with(REQUESTS) + """,
closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM requests)
SELECT date_trunc('second', ts) AS window_start, date_trunc('second', ts) + INTERVAL 1 SECOND AS window_end,
       count(*) AS requests, count(*) AS rate_per_sec
FROM requests WHERE status <> 'error' GROUP BY 1, 2
HAVING date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT wm FROM closed)"""
    return q
