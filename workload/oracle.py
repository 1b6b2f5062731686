"""DuckDB SQL that computes the same results from the same tables, query by query."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --- shared parts ------------------------------------------------------------

M = """m AS (
  SELECT event_type AS series_id, event_id AS seq, ts, epoch_us(ts) AS us, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events)"""

BINS = """span AS (
  SELECT event_type AS series_id, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events GROUP BY 1),
bins AS (
  SELECT series_id, t0, greatest(1, ceil((t1 - t0) / {w}))::BIGINT AS bins FROM span),
binned AS (
  SELECT event_type AS series_id, least(floor((epoch_us(ts) - t0) / {w})::BIGINT, bins - 1) AS seq, {agg} AS value
  FROM events JOIN bins ON event_type = series_id GROUP BY 1, 2),
grid AS (
  SELECT series_id, t0, bins AS n, unnest(range(0, bins)) AS seq FROM bins),
h AS (
  SELECT g.series_id, g.seq, g.seq AS idx, g.n, g.t0 + CAST((g.seq + 0.5) * {w} AS BIGINT) AS us, b.value
  FROM grid g LEFT JOIN binned b ON g.series_id = b.series_id AND g.seq = b.seq)"""


def hourly(agg: str = "avg(value)") -> str:
    return BINS.format(w="3600000000.0", agg=agg)


def rnd(expr: str, name: str, digits: int = 6) -> str:
    scale = 10.0 ** digits
    return f"floor(({expr}) * {scale} + 0.501) / {scale} AS {name}"


FP = "substr(sha256({name}), 1, 16)"

# --- catalogue, filters, labels ------------------------------------------------

ORACLE["catalog"] = "SELECT event_type AS name, count(*) AS points FROM events GROUP BY 1"
ORACLE["metric_names"] = "SELECT DISTINCT event_type AS name FROM events"
ORACLE["last_n_points"] = f"WITH {M} SELECT series_id, seq, value FROM m WHERE idx >= n - 1000"
ORACLE["filter_name"] = "SELECT event_type AS name, event_id AS seq, value FROM events WHERE event_type = 'purchase'"
K = "regexp_extract(props, '[0-9]+')"
ORACLE["filter_label"] = f"SELECT event_type AS name, event_id AS seq, value FROM events WHERE {K} = '5'"
ORACLE["fingerprint"] = f"""
SELECT event_id AS seq, substr(sha256(event_type || '|k=' || {K} || '|user=' || user_id), 1, 16) AS fingerprint,
       event_type || '{{k=' || {K} || ',user=' || user_id || '}}' AS series_key
FROM events"""
ORACLE["extra_labels"] = """
SELECT event_id AS seq, event_type || '{env=prod,k=override,user=' || user_id || '}' AS series_key FROM events"""
ORACLE["series_by_label"] = f"""
SELECT event_type || '{{k=' || {K} || '}}' AS series_id, count(value) AS n, {rnd('avg(value)', 'mean')},
       {rnd('stddev_pop(value)', 'sd')}, min(value) AS vmin, max(value) AS vmax
FROM events GROUP BY 1"""
ORACLE["enough_points"] = """
SELECT CAST(user_id AS VARCHAR) AS series_id, event_id AS seq, value
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE c >= 60"""
ORACLE["too_few_points"] = """
SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS points FROM events GROUP BY 1 HAVING count(*) < 60"""
ORACLE["counter_names"] = """
WITH named AS (
  SELECT event_type || CASE WHEN value > 300 THEN '_TOTAL' WHEN value > 200 THEN '_sum' WHEN value > 100 THEN '_Bytes_in'
                            WHEN value > 50 THEN '_totals' ELSE '_usage' END AS name FROM events)
SELECT name, CASE WHEN ends_with(lower(name), '_total') OR ends_with(lower(name), '_count') OR ends_with(lower(name), '_sum')
            OR contains(lower(name), 'octets') OR contains(lower(name), 'packets') OR contains(lower(name), 'errors')
            OR contains(lower(name), 'bytes') OR contains(lower(name), 'frames') OR contains(lower(name), 'drops')
       THEN 1 ELSE 0 END AS is_counter, count(*) AS n
FROM named GROUP BY 1, 2"""

# --- statistics ----------------------------------------------------------------

ORACLE["series_moments"] = f"""
SELECT event_type AS series_id, count(value) AS n, {rnd('avg(value)', 'mean')}, {rnd('stddev_pop(value)', 'sd')},
       min(value) AS vmin, max(value) AS vmax FROM events GROUP BY 1"""
ORACLE["series_quantiles"] = "SELECT event_type AS series_id, count(value) AS n, " + ", ".join(
    rnd(f"quantile_cont(value, {q})", c)
    for c, q in (("p01", 0.01), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99))) + " FROM events GROUP BY 1"
MAD = """mid AS (SELECT event_type AS series_id, median(value) AS median FROM events GROUP BY 1),
dev AS (SELECT series_id, count(value) AS n, any_value(mid.median) AS median, median(abs(value - mid.median)) AS mad
        FROM events JOIN mid ON event_type = series_id GROUP BY 1)"""
ORACLE["median_abs_deviation"] = f"WITH {MAD} SELECT series_id, n, {rnd('median', 'median')}, {rnd('mad', 'mad')} FROM dev"
STEPS = f"""{M},
steps AS (SELECT *, (us - lag(us) OVER (PARTITION BY series_id ORDER BY idx)) / 1e6 AS dt FROM m)"""
ORACLE["median_interval"] = f"WITH {STEPS} SELECT series_id, {rnd('median(dt)', 'interval')} FROM steps GROUP BY 1"

# --- counters, gaps, grids -----------------------------------------------------

C = """o AS (
  SELECT o_orderpriority AS series_id, epoch_us(o_orderdate) AS us, o_orderkey AS seq,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
              ROWS UNBOUNDED PRECEDING) % 4294967296 AS DOUBLE) AS value FROM orders),
c AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY us, seq) AS prev FROM o),
delta AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value >= prev THEN value - prev
                         ELSE 4294967296.0 - prev + value END AS d FROM c)"""
ORACLE["counter_delta"] = f"WITH {C} SELECT series_id, seq, {rnd('d', 'value', 2)} FROM delta"
ORACLE["counter_delta_64"] = f"""WITH {C}
SELECT series_id, seq, {rnd("CASE WHEN value < prev THEN pow(2.0, 64) - prev + value ELSE d END / pow(2.0, 32)", 'value')}
FROM delta"""
ORACLE["counter_max_rate"] = f"""WITH {C}
SELECT series_id, seq, {rnd('CASE WHEN d > 40000000.0 THEN 0.0 ELSE d END', 'value', 2)} FROM delta"""
ORACLE["counter_wraps"] = f"""WITH {C}
SELECT series_id, seq, CAST(coalesce(value < prev, false) AS INTEGER) AS wrapped FROM c"""

for _m, _agg in (("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("sum", "sum(value)"),
                 ("first", "arg_min(value, (ts, event_id))"), ("last", "arg_max(value, (ts, event_id))")):
    ORACLE[f"resample_hourly_{_m}"] = f"WITH {hourly(_agg)} SELECT series_id, seq, us, {rnd('value', 'value')} FROM h"
ORACLE["resample_median"] = f"""WITH {STEPS},
span AS (SELECT series_id, min(us) AS t0, max(us) AS t1, round(median(dt) * 1e6) AS w FROM steps GROUP BY 1),
bins AS (SELECT *, greatest(1, ceil((t1 - t0) / w))::BIGINT AS bins FROM span),
binned AS (SELECT series_id, least(floor((us - t0) / w)::BIGINT, bins - 1) AS seq, avg(value) AS value
           FROM m JOIN bins USING (series_id) GROUP BY 1, 2),
grid AS (SELECT series_id, unnest(range(0, bins)) AS seq FROM bins)
SELECT g.series_id, g.seq, {rnd('b.value', 'value')}
FROM grid g LEFT JOIN binned b ON g.series_id = b.series_id AND g.seq = b.seq"""
for _m, _agg in (("mean", "avg"), ("max", "max"), ("min", "min")):
    ORACLE[f"downsample_{_m}"] = f"""WITH {M}
SELECT series_id, idx // 10 AS seq, {rnd(f'{_agg}(value)', 'value')} FROM m GROUP BY 1, 2"""
ORACLE["gaps_detected"] = f"""WITH {STEPS}, mid AS (SELECT series_id, median(dt) AS w FROM steps GROUP BY 1)
SELECT series_id, idx - 1 AS start_idx, idx AS end_idx, {rnd('dt', 'duration')}
FROM steps JOIN mid USING (series_id) WHERE dt > w * 1.5"""
ORACLE["gaps_expected"] = f"""WITH {STEPS}
SELECT series_id, idx - 1 AS start_idx, idx AS end_idx, {rnd('dt', 'duration')} FROM steps WHERE dt > 2400"""

GAPPY = f"""{M},
g AS (SELECT series_id, seq, us, idx, CASE WHEN value >= 20 THEN value END AS value FROM m)"""
ORACLE["fill_zero"] = f"WITH {GAPPY} SELECT series_id, seq, {rnd('coalesce(value, 0.0)', 'value')} FROM g"


def linear(base: str, table: str, limit: float | None, digits: int | None = 6) -> str:
    inner = "lv + (rv - lv) * ((us - lu)::DOUBLE / (ru - lu))"
    if limit is None:
        guess = f"CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN {inner} ELSE coalesce(lv, rv) END"
    else:
        guess = (f"CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN ru - lu <= {limit * 1e6} THEN {inner} END "
                 f"WHEN lv IS NOT NULL AND us - lu <= {limit * 1e6} THEN lv END")
    filled = f"CASE WHEN value IS NOT NULL THEN value ELSE {guess} END" + (" AS value" if digits is None else "")
    back = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""WITH {base},
p AS (SELECT *, CASE WHEN value IS NOT NULL THEN us END AS vu FROM {table}),
n AS (SELECT *, last_value(value IGNORE NULLS) OVER {back} AS lv, last_value(vu IGNORE NULLS) OVER {back} AS lu,
             first_value(value IGNORE NULLS) OVER {ahead} AS rv, first_value(vu IGNORE NULLS) OVER {ahead} AS ru FROM p)
SELECT series_id, seq, {filled if digits is None else rnd(filled, 'value', digits)} FROM n"""


def directional(way: str, limit: float | None) -> str:
    broken = "false" if limit is None else f"coalesce(abs(us - near) > {limit * 1e6}, false)"
    return f"""WITH {GAPPY},
s AS (SELECT *, lag(us) OVER (PARTITION BY series_id ORDER BY idx {way}) AS near FROM g),
k AS (SELECT *, sum(CASE WHEN value IS NOT NULL OR {broken} THEN 1 ELSE 0 END)
                OVER (PARTITION BY series_id ORDER BY idx {way} ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT series_id, seq, {rnd('max(value) OVER (PARTITION BY series_id, part)', 'value')} FROM k"""


ORACLE["fill_linear"] = linear(GAPPY, "g", None)
ORACLE["fill_linear_maxgap"] = linear(GAPPY, "g", 1800.0)
ORACLE["fill_hourly"] = linear(hourly(), "h", None)
ORACLE["quantiles_generated"] = f"""WITH filled AS ({linear(BINS.format(w="60000000.0", agg="avg(value)"), "h", None, None)})
SELECT series_id, count(value) AS n, {", ".join(rnd(f"quantile_cont(value, {q})", c, 5) for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))}
FROM filled GROUP BY 1"""
ORACLE["fill_ffill"] = directional("ASC", None)
ORACLE["fill_bfill"] = directional("DESC", None)
ORACLE["fill_ffill_maxgap"] = directional("ASC", 1800.0)
ORACLE["fill_bfill_maxgap"] = directional("DESC", 1800.0)

# --- outliers, normalisation -----------------------------------------------------

Q = """q AS (SELECT event_type AS series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
             quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99,
             avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)"""
E = "events JOIN q ON event_type = series_id"
IQR_OUT = "(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"
ORACLE["outliers_iqr"] = f"WITH {Q} SELECT series_id, event_id AS seq, CAST({IQR_OUT} AS INTEGER) AS is_outlier FROM {E}"
ORACLE["outliers_zscore"] = f"""WITH {Q}
SELECT series_id, event_id AS seq, CAST(abs(value - mean) / sd > 3 AS INTEGER) AS is_outlier FROM {E}"""
ORACLE["outliers_mad"] = f"""WITH {MAD}
SELECT series_id, event_id AS seq, CAST(abs(0.6745 * (value - median) / mad) > 3.5 AS INTEGER) AS is_outlier
FROM events JOIN dev ON event_type = series_id"""
ORACLE["clip"] = f"""WITH {Q}
SELECT series_id, event_id AS seq, {rnd('least(greatest(value, p01), p99)', 'value')} FROM {E}"""
GOOD = f"""{Q}, x AS (SELECT series_id, event_id AS seq, value, {IQR_OUT} AS bad FROM {E}),
good AS (SELECT series_id, median(value) AS md, avg(value) AS av, min(value) AS lo, max(value) AS hi
         FROM x WHERE NOT bad GROUP BY 1)"""
for _m, _expr in (("nan", "NULL"), ("median", "md"), ("mean", "av"), ("clip", "least(greatest(value, lo), hi)")):
    ORACLE[f"replace_{_m}"] = f"""WITH {GOOD}
SELECT series_id, seq, {rnd(f'CASE WHEN bad THEN {_expr} ELSE value END', 'value')} FROM x JOIN good USING (series_id)"""
ORACLE["norm_z"] = f"WITH {Q} SELECT series_id, event_id AS seq, {rnd('(value - mean) / sd', 'value')} FROM {E}"
ORACLE["norm_minmax"] = f"""WITH {Q}
SELECT series_id, event_id AS seq, {rnd('(value - lo) / (hi - lo) * 2 - 1', 'value')} FROM {E}"""
ORACLE["norm_robust"] = f"WITH {Q} SELECT series_id, event_id AS seq, {rnd('(value - q2) / (q3 - q1)', 'value')} FROM {E}"
ORACLE["norm_log"] = f"SELECT event_type AS series_id, event_id AS seq, {rnd('ln(1 + greatest(value, 0) + 1)', 'value')} FROM events"
ORACLE["norm_saved"] = f"""
WITH p AS (SELECT event_type AS series_id, avg(value) AS mean, stddev_pop(value) AS sd FROM events
           WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT series_id, event_id AS seq, {rnd('(value - mean) / sd', 'value')}
FROM events JOIN p ON event_type = series_id WHERE ts >= TIMESTAMP '2024-01-16'"""

# --- season --------------------------------------------------------------------

TREND24 = f"""{hourly()},
t AS (SELECT *, 24 AS period, idx % 24 AS phase, avg(value) OVER (PARTITION BY series_id ORDER BY idx
             ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM h)"""
ORACLE["moving_average_24"] = f"WITH {TREND24} SELECT series_id, seq, {rnd('trend', 'trend')} FROM t"


def acf(table: str) -> str:
    """Lag with the largest autocorrelation of a table (series_id, idx, n, value)."""
    return f"""stat AS (SELECT series_id, avg(value) AS mean FROM {table} GROUP BY 1),
cen AS (SELECT series_id, idx, n, coalesce(value - mean, 0) AS c FROM {table} JOIN stat USING (series_id)),
lags AS (SELECT DISTINCT series_id, unnest(range(2, least(greatest(3, n // 3), n // 2) + 1)) AS lag FROM cen),
dots AS (SELECT l.series_id, l.lag, sum(a.c * b.c) AS dot
         FROM lags l JOIN cen a ON a.series_id = l.series_id
         JOIN cen b ON b.series_id = l.series_id AND b.idx = a.idx + l.lag GROUP BY 1, 2),
best AS (SELECT series_id, arg_max(lag, (dot, -lag)) AS period FROM dots GROUP BY 1)"""


ORACLE["period_long"] = f"""WITH w AS (
  SELECT 'all' AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n, value FROM events), {acf('w')}
SELECT series_id, CAST(period AS BIGINT) AS period FROM best"""
ORACLE["period_estimate"] = f"WITH {hourly()}, {acf('h')} SELECT series_id, CAST(period AS BIGINT) AS period FROM best"


def seasonal(table: str, mult: bool = False) -> str:
    off = "value / nullif(trend, 0)" if mult else "value - trend"
    level = "CASE WHEN level = 0 THEN raw ELSE raw / level END" if mult else "raw - level"
    rest = "value / nullif(trend * seasonal, 0)" if mult else "value - trend - seasonal"
    return f"""ph AS (SELECT series_id, phase, coalesce(avg({off}), 0) AS raw FROM {table} GROUP BY 1, 2),
lv AS (SELECT series_id, avg(raw) AS level FROM ph GROUP BY 1),
se AS (SELECT series_id, phase, {level} AS seasonal FROM ph JOIN lv USING (series_id)),
parts AS (SELECT *, {rest} AS residual FROM {table} JOIN se USING (series_id, phase))"""


PARTS = (f"SELECT series_id, seq, CAST(period AS BIGINT) AS period, {rnd('trend', 'trend')}, "
         f"{rnd('seasonal', 'seasonal')}, {rnd('residual', 'residual')} FROM parts")
ORACLE["decompose_add"] = f"WITH {TREND24}, {seasonal('t')} {PARTS}"
ORACLE["decompose_mult"] = f"WITH {TREND24}, {seasonal('t', True)} {PARTS}"
TRENDP = f"""{hourly()}, {acf('h')},
t AS (SELECT a.series_id, a.seq, a.idx, any_value(a.value) AS value, any_value(p.period) AS period,
             a.idx % any_value(p.period) AS phase, avg(b.value) AS trend
      FROM h a JOIN best p ON a.series_id = p.series_id
      JOIN h b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx - p.period // 2 AND a.idx + p.period // 2
      GROUP BY 1, 2, 3)"""
ORACLE["decompose_estimated"] = f"WITH {TRENDP}, {seasonal('t')} {PARTS}"

# --- detectors -----------------------------------------------------------------


def scores(source: str, score: str, is_anomaly: str, digits: int = 6, seq: str = "seq") -> str:
    return (f"SELECT series_id, {seq} AS seq, {rnd(score, 'score', digits)}, "
            f"CAST({is_anomaly} AS INTEGER) AS is_anomaly FROM {source}")


ZS = "abs(value - mean) / sd"
IQ = "greatest((q1 - 1.5 * (q3 - q1) - value) / (q3 - q1), (value - q3 - 1.5 * (q3 - q1)) / (q3 - q1), 0)"
ORACLE["detect_zscore"] = f"WITH {Q} " + scores(E, ZS, f"{ZS} > 3", seq="event_id")
ODD = """ev AS (SELECT event_type AS series_id, event_id AS seq, event_type IN ('click', 'error') AND event_id % 97 = 0 AS odd, value FROM events),
has AS (SELECT series_id, bool_or(odd) AS odd_series, avg(value) AS mean, stddev_pop(value) AS sd FROM ev GROUP BY 1),
iv AS (SELECT series_id, seq, CASE WHEN odd THEN 'inf'::DOUBLE ELSE value END AS value, odd FROM ev),
iq AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM iv GROUP BY 1),
zs AS (SELECT series_id, seq, CASE WHEN odd_series THEN 0 ELSE abs(value - mean) / sd END AS z FROM iv JOIN has USING (series_id))"""
ORACLE["detect_infinite"] = f"""WITH {ODD}
SELECT series_id, seq, 'zscore' AS detector, {rnd('z', 'score')}, CAST(z > 3 AS INTEGER) AS is_anomaly FROM zs
UNION ALL SELECT series_id, seq, 'mask', NULL, CAST(z > 3 AS INTEGER) FROM zs
UNION ALL SELECT series_id, seq, 'iqr', CASE WHEN NOT odd THEN {rnd(IQ, 'x').removesuffix(' AS x')} END, CAST({IQR_OUT} AS INTEGER) FROM iv JOIN iq USING (series_id)"""
ORACLE["detect_iqr"] = f"WITH {Q} " + scores(E, IQ, IQR_OUT, seq="event_id")
SW = f"""{M},
w AS (SELECT *, count(value) OVER f AS c, avg(value) OVER f AS wm, stddev_pop(value) OVER f AS ws FROM m
      WINDOW f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)),
wz AS (SELECT *, CASE WHEN c > 1 AND ws > 0 THEN abs(value - wm) / ws ELSE 0 END AS z FROM w)"""
ORACLE["detect_zscore_window"] = f"WITH {SW} " + scores("wz", "z", "z > 3")
STL = """rs AS (SELECT series_id, avg(residual) AS rm, CASE WHEN stddev_pop(residual) = 0 THEN 1 ELSE stddev_pop(residual) END AS rd
       FROM parts GROUP BY 1),
z AS (SELECT *, coalesce(abs((residual - rm) / rd), 0) AS z FROM parts JOIN rs USING (series_id))"""
ORACLE["detect_stl"] = f"WITH {TREND24}, {seasonal('t')}, {STL} " + scores("z", "z", "z > 3")
ORACLE["detect_stl_estimated"] = f"WITH {TRENDP}, {seasonal('t')}, {STL} " + scores("z", "z", "z > 3")

# Extreme deviates: the t quantile at 0.9999 by its expansion in 1 / df, which has converged for
# series of this length (above about 250 rows the probability is always 0.9999).
Z9999 = 3.719016485455709
TQ = (f"({Z9999} + {(Z9999**3 + Z9999) / 4!r} / df + {(5*Z9999**5 + 16*Z9999**3 + 3*Z9999) / 96!r} / (df * df) "
      f"+ {(3*Z9999**7 + 19*Z9999**5 + 17*Z9999**3 - 15*Z9999) / 384!r} / (df * df * df) "
      f"+ {(79*Z9999**9 + 776*Z9999**7 + 1482*Z9999**5 - 1920*Z9999**3 - 945*Z9999) / 92160!r} / (df * df * df * df))")
GESD = f"""{M},
rounds AS (
  SELECT series_id, 0 AS k, []::BIGINT[] AS gone, NULL::BIGINT AS tested, NULL::DOUBLE AS stat, true AS hit
  FROM m GROUP BY 1
  UNION ALL
  SELECT series_id, k, CASE WHEN stat > crit THEN list_append(gone, tested) ELSE gone END, tested, stat, stat > crit
  FROM (
    SELECT series_id, k, gone, tested, stat, (nv - k) * t / sqrt((nv - k - 1 + t * t) * (nv - k + 1)) AS crit
    FROM (
      SELECT *, {TQ} AS t FROM (
        SELECT s.series_id, s.k, s.gone, s.nv, CAST(s.nv - s.k - 1 AS DOUBLE) AS df,
               arg_max(m.idx, (abs(m.value - s.mean), -m.idx)) AS tested, max(abs(m.value - s.mean)) / any_value(s.sd) AS stat
        FROM (SELECT r.series_id, r.k + 1 AS k, r.gone, count(*) AS nv, avg(m.value) AS mean, stddev_samp(m.value) AS sd
              FROM rounds r JOIN m ON m.series_id = r.series_id AND NOT list_contains(r.gone, m.idx)
              WHERE r.hit AND r.k < 10 GROUP BY r.series_id, r.k, r.gone) s
        JOIN m ON m.series_id = s.series_id AND NOT list_contains(s.gone, m.idx)
        GROUP BY s.series_id, s.k, s.gone, s.nv)))),
tested AS (SELECT series_id, tested AS idx, stat, hit FROM rounds WHERE k > 0),
gesd AS (SELECT m.*, coalesce(stat, 0) AS score, coalesce(hit, false) AS hit FROM m LEFT JOIN tested USING (series_id, idx))"""
ORACLE["detect_gesd"] = f"WITH RECURSIVE {GESD} " + scores("gesd", "score", "hit")

LAGS = ", ".join(f"lag(value, {9 - j}) OVER w AS v{j}" for j in range(10))
VEC = f"""{M}, v AS (SELECT * FROM (SELECT *, {LAGS} FROM m WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE idx >= 9)"""
CENTROID = f"""{VEC},
c AS (SELECT series_id, {', '.join(f'avg(v{j}) AS c{j}' for j in range(10))} FROM v GROUP BY 1),
dist AS (SELECT v.series_id, idx, sqrt({' + '.join(f'(v{j} - c{j}) * (v{j} - c{j})' for j in range(10))}) AS d
         FROM v JOIN c ON v.series_id = c.series_id),
lim AS (SELECT series_id, quantile_cont(d, 0.95) AS t, max(d) AS top FROM dist GROUP BY 1),
out AS (SELECT m.series_id, m.seq, coalesce(d, 0) / top AS s, coalesce(d > t, false) AS hit
        FROM m JOIN lim USING (series_id) LEFT JOIN dist USING (series_id, idx))"""
ORACLE["detect_centroid"] = f"WITH {CENTROID} " + scores("out", "s", "hit")

PAIR = "sqrt(" + " + ".join(f"(a.v{j} - b.v{j}) * (a.v{j} - b.v{j})" for j in range(10)) + ")"
NEAR = f"""{VEC},
near AS (SELECT series_id, idx, min(d, 20) AS ds, arg_min(nid, d, 20) AS nids
         FROM (SELECT a.series_id, a.idx, b.idx AS nid, {PAIR} AS d
               FROM v a JOIN v b ON a.series_id = b.series_id AND a.idx <> b.idx) GROUP BY 1, 2)"""
ORACLE["detect_knn"] = f"""WITH {NEAR},
own AS (SELECT series_id, idx, list_sum(ds) / 20 AS others, list_sum(ds[1:19]) / 20 AS d FROM near),
lim AS (SELECT series_id, quantile_cont(others, 0.95) AS t, max(d) AS top FROM own GROUP BY 1),
out AS (SELECT m.series_id, m.seq, coalesce(d, 0) / top AS s, coalesce(d > t, false) AS hit
        FROM m JOIN lim USING (series_id) LEFT JOIN own USING (series_id, idx)) """ + scores("out", "s", "hit")
ORACLE["detect_lof"] = f"""WITH {NEAR},
e AS (SELECT series_id, idx, unnest(ds) AS d, unnest(nids) AS nid FROM near),
kd AS (SELECT series_id, idx AS nid, ds[20] AS kd FROM near),
den AS (SELECT series_id, idx, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM e JOIN kd USING (series_id, nid) GROUP BY 1, 2),
fac AS (SELECT e.series_id, e.idx, avg(o.lrd) / any_value(p.lrd) AS f
        FROM e JOIN den o ON o.series_id = e.series_id AND o.idx = e.nid
        JOIN den p ON p.series_id = e.series_id AND p.idx = e.idx GROUP BY 1, 2),
lim AS (SELECT series_id, quantile_cont(f, 0.95) AS t, max(f) AS top FROM fac GROUP BY 1),
out AS (SELECT m.series_id, m.seq, coalesce(f, 0) / top AS s, coalesce(f > t, false) AS hit
        FROM m JOIN lim USING (series_id) LEFT JOIN fac USING (series_id, idx)) """ + scores("out", "s", "hit")

Z95 = 1.959963984540054
FI = """f AS (SELECT *, regr_slope(value, pos) OVER r AS slope, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS level,
             stddev_pop(value) OVER r AS sd FROM x
      WINDOW r AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
out AS (SELECT series_id, seq, CASE WHEN pos >= 20 THEN abs(value - level - slope) / greatest({z} * sd, 0.5e-10) ELSE 0 END AS s,
               pos >= 20 AND abs(value - level - slope) > {z} * sd AS hit FROM f WHERE current)""".format(z=Z95)
ORACLE["detect_forecast_interval"] = f"WITH {M}, x AS (SELECT *, idx AS pos, true AS current FROM m), {FI} " + scores("out", "s", "hit", 4)
ORACLE["detect_forecast_interval_baseline"] = f"""WITH {M}, x AS (
  SELECT series_id, seq, value, idx + n AS pos, true AS current FROM m
  UNION ALL SELECT series_id, seq, value, idx, false FROM m), {FI} """ + scores("out", "s", "hit", 4)
ORACLE["detect_custom"] = f"""WITH {M},
c AS (SELECT *, abs(value - median(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS s
      FROM m) """ + scores("c", "s", "s > 150")
ORACLE["detect_trained"] = f"""
WITH q AS (SELECT event_type AS series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events
           WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) """ + scores(
    E + " WHERE ts >= TIMESTAMP '2024-01-16'", IQ, IQR_OUT, seq="event_id")

# --- ensembles ---------------------------------------------------------------

THREE = f"""{SW}, {Q},
s AS (SELECT wz.series_id, seq, {ZS} AS s0, {IQ} AS s1, z AS s2, {ZS} > 3 AS f0, {IQR_OUT} AS f1, z > 3 AS f2
      FROM wz JOIN q USING (series_id)),
top AS (SELECT series_id, max(s0) AS t0, max(s1) AS t1, max(s2) AS t2 FROM s GROUP BY 1),
v AS (SELECT *, CAST(f0 AS INTEGER) + CAST(f1 AS INTEGER) + CAST(f2 AS INTEGER) AS votes FROM s JOIN top USING (series_id))"""


def three(rule: str, w1: float = 1.0) -> str:
    return (f"WITH {THREE} SELECT series_id, seq, {rnd(f'(s0 / t0 + {w1} * s1 / t1 + s2 / t2) / {w1 + 2}', 'score')}, "
            f"CAST({rule} AS INTEGER) AS is_anomaly, votes FROM v")


ORACLE["ensemble_majority"] = three("votes > 1.5")
ORACLE["ensemble_unanimous"] = three("votes = 3")
ORACLE["ensemble_any"] = three("votes > 0")
ORACLE["ensemble_weighted"] = three("CAST(f0 AS INTEGER) + 3 * CAST(f1 AS INTEGER) + CAST(f2 AS INTEGER) > 2.5", 3.0)
ORACLE["ensemble_threshold"] = three("votes / 3.0 >= 0.6")
TWO = f"""{Q},
s AS (SELECT series_id, event_id AS seq, ts, value, {ZS} AS s0, {IQ} AS s1, {ZS} > 3 AS f0, {IQR_OUT} AS f1 FROM {E}),
top AS (SELECT series_id, max(s0) AS t0, max(s1) AS t1 FROM s GROUP BY 1),
pair AS (SELECT *, (s0 / t0 + s1 / t1) / 2 AS score FROM s JOIN top USING (series_id))"""
ORACLE["detector_report"] = f"""WITH {TWO},
l AS (SELECT series_id, 'zscore' AS detector, s0 AS s, CAST(f0 AS INTEGER) AS f FROM s
      UNION ALL SELECT series_id, 'iqr', s1, CAST(f1 AS INTEGER) FROM s)
SELECT series_id, detector, count(*) AS points, CAST(sum(f) AS BIGINT) AS anomaly_count, {rnd('avg(f)', 'anomaly_ratio')},
       {rnd('max(s)', 'max_score')} FROM l GROUP BY 1, 2"""


def grade(score: str) -> str:
    return f"CASE WHEN {score} >= 0.9 THEN 4 WHEN {score} >= 0.7 THEN 3 WHEN {score} >= 0.5 THEN 2 WHEN {score} >= 0.3 THEN 1 ELSE 0 END"


ANOM = f"{TWO}, a AS (SELECT *, epoch_us(ts) AS us, {grade('score')} AS severity FROM pair WHERE f0 AND f1)"
AOUT = (f"SELECT series_id, seq, us, {rnd('value', 'value')}, {rnd('score', 'score')}, severity, "
        "'zscore,iqr' AS detectors FROM a")
ORACLE["detect_ensemble"] = f"WITH {ANOM} {AOUT}"
MULT = """CASE WHEN isodow(ts) >= 6 THEN 2.0 WHEN hour(ts) >= 8 AND hour(ts) < 18 THEN 1.0
               WHEN hour(ts) < 6 THEN 2.0 ELSE 1.5 END"""
ORACLE["detect_context"] = f"WITH {ANOM} {AOUT} WHERE score >= 0.5 * {MULT}"
ORACLE["top_anomalies"] = f"WITH {ANOM} {AOUT} ORDER BY a.score DESC, series_id, us, seq LIMIT 10"
CLEAN = f"""{GOOD}, xx AS (SELECT x.series_id, x.seq, CASE WHEN bad THEN md ELSE value END AS value FROM x JOIN good USING (series_id)),
q2 AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS sd
       FROM xx GROUP BY 1)"""


def two_on(table: str, params: str, rule: str) -> str:
    """Anomalies of the default pair over a table (series_id, seq, us, value)."""
    return f"""s AS (SELECT t.series_id, t.seq, t.us, t.value, coalesce({ZS}, 0) AS s0, coalesce({IQ}, 0) AS s1,
             coalesce({ZS} > 3, false) AS f0, coalesce({IQR_OUT}, false) AS f1 FROM {table} t JOIN {params} USING (series_id)),
top AS (SELECT series_id, max(s0) AS t0, max(s1) AS t1 FROM s GROUP BY 1),
b AS (SELECT *, (CASE WHEN t0 > 0 THEN s0 / t0 ELSE s0 END + CASE WHEN t1 > 0 THEN s1 / t1 ELSE s1 END) / 2 AS score
      FROM s JOIN top USING (series_id)),
a AS (SELECT *, {grade('score')} AS severity FROM b WHERE {rule})"""


AOUT2 = (f"SELECT series_id, seq, us, {rnd('value', 'value')}, {rnd('score', 'score')}, severity, "
         "concat_ws(',', CASE WHEN f0 THEN 'zscore' END, CASE WHEN f1 THEN 'iqr' END) AS detectors FROM a")
ORACLE["detect_default"] = f"""WITH {CLEAN},
cl AS (SELECT xx.*, epoch_us(e.ts) AS us FROM xx JOIN events e ON e.event_id = xx.seq),
{two_on('cl', 'q2', 'f0 AND f1')} {AOUT2}"""
ORACLE["detect_any"] = f"""WITH filled AS ({linear(GAPPY, 'g', None, 12)}),
cl AS (SELECT f.series_id, f.seq, epoch_us(e.ts) AS us, f.value FROM filled f JOIN events e ON e.event_id = f.seq),
q2 AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS sd
       FROM cl GROUP BY 1),
{two_on('cl', 'q2', 'f0 OR f1')} {AOUT2}"""
ORACLE["detect_by_gesd"] = f"""WITH RECURSIVE {GESD},
top AS (SELECT series_id, max(score) AS t FROM gesd GROUP BY 1),
a AS (SELECT series_id, seq, us, value, score / t AS s FROM gesd JOIN top USING (series_id) WHERE hit)
SELECT series_id, seq, us, {rnd('value', 'value')}, {rnd('s', 'score')}, {grade('s')} AS severity, 'gesd' AS detectors FROM a"""
ORACLE["detection_overview"] = f"""WITH {ANOM},
t AS (SELECT event_type AS series_id, count(*) AS total_points FROM events GROUP BY 1),
f AS (SELECT series_id, count(*) AS n, max(severity) AS worst FROM a GROUP BY 1)
SELECT series_id, total_points, coalesce(n, 0) AS anomaly_count,
       ['info', 'low', 'medium', 'high', 'critical'][coalesce(worst, 0) + 1] AS max_severity
FROM t LEFT JOIN f USING (series_id)"""
ORACLE["anomaly_rollup"] = f"WITH {ANOM} SELECT series_id, severity, count(*) AS anomalies FROM a GROUP BY ROLLUP (series_id, severity)"
ORACLE["preprocess_series"] = f"""WITH filled AS ({linear(hourly(), 'h', None, 12)}),
f AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM filled GROUP BY 1),
x AS (SELECT series_id, seq, value, {IQR_OUT} AS bad FROM filled JOIN f USING (series_id)),
g AS (SELECT series_id, median(value) AS md FROM x WHERE NOT bad GROUP BY 1),
y AS (SELECT series_id, seq, CASE WHEN bad THEN md ELSE value END AS value FROM x JOIN g USING (series_id)),
z AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS sd FROM y GROUP BY 1)
SELECT series_id, seq, {rnd('(value - mean) / sd', 'value')} FROM y JOIN z USING (series_id)"""
ORACLE["preprocess_counters"] = f"""WITH {C},
f AS (SELECT series_id, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM delta GROUP BY 1),
x AS (SELECT series_id, seq, d, (d < q1 - 1.5 * (q3 - q1) OR d > q3 + 1.5 * (q3 - q1)) AS bad FROM delta JOIN f USING (series_id)),
g AS (SELECT series_id, min(d) AS lo, max(d) AS hi FROM x WHERE NOT bad GROUP BY 1)
SELECT series_id || '_total' AS series_id, seq, {rnd('CASE WHEN bad THEN least(greatest(d, lo), hi) ELSE d END', 'value', 2)}
FROM x JOIN g USING (series_id)"""
ORACLE["preprocess_steps"] = """
SELECT DISTINCT CASE WHEN value > 100 THEN event_type || '_total' ELSE event_type END AS series_id,
       CASE WHEN value > 100 THEN 'unwrap_counters,fill_gaps,handle_outliers' ELSE 'fill_gaps,handle_outliers' END AS steps
FROM events"""
ORACLE["temporal_context"] = f"""
SELECT event_id AS seq, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
       CAST(hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) < 6 AS INTEGER) AS is_business_hours,
       CAST({MULT} AS DOUBLE) AS multiplier FROM events"""
# summer time from the last Sunday of March to that of October, at 01:00 UTC
ORACLE["temporal_context_zone"] = f"""
WITH y AS (SELECT event_id AS seq, ts, make_date(year(ts), 3, 31) AS m3, make_date(year(ts), 10, 31) AS m10 FROM events),
z AS (SELECT seq, ts, m3 - CAST(isodow(m3) % 7 AS INTEGER) + INTERVAL 1 HOUR AS a, m10 - CAST(isodow(m10) % 7 AS INTEGER) + INTERVAL 1 HOUR AS b FROM y),
t AS (SELECT seq, ts + CASE WHEN ts >= a AND ts < b THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS ts FROM z)
SELECT seq, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
       CAST(hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) < 6 AS INTEGER) AS is_business_hours,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS local FROM t"""
ORACLE["severity_matrix"] = f"""
WITH a AS (SELECT event_id, user_id AS mins, event_type IN ('error', 'click') AS crit, event_id % 2 = 0 AS corr,
                  {grade('(value / 200)')} AS s FROM events),
b AS (SELECT *, CASE WHEN mins > 30 THEN least(4, s + 1) WHEN mins > 10 AND s < 3 THEN s + 1 ELSE s END AS s1 FROM a),
c AS (SELECT *, CASE WHEN crit AND s1 < 3 THEN s1 + 1 ELSE s1 END AS s2 FROM b),
d AS (SELECT event_id, CASE WHEN corr AND s2 < 4 THEN s2 + 1 ELSE s2 END AS severity FROM c)
SELECT event_id, CAST(severity AS INTEGER) AS severity, ['info', 'low', 'medium', 'high', 'critical'][severity + 1] AS label FROM d"""
CORR = f"""{ANOM},
links AS (SELECT DISTINCT x.series_id AS m1, y.series_id AS m2 FROM a x JOIN a y
          ON x.series_id <> y.series_id AND abs(x.us - y.us) <= 300000000),
reach AS (SELECT DISTINCT series_id AS m, series_id AS o FROM a
          UNION SELECT reach.m, links.m2 FROM reach JOIN links ON links.m1 = reach.o),
comp AS (SELECT m AS metric, min(o) AS component, count(*) AS size FROM reach GROUP BY 1),
big AS (SELECT * FROM comp WHERE size > 1 OR (SELECT count(*) FROM comp) = 1)"""
ORACLE["severity_symbols"] = f"""
SELECT event_id, ['ℹ️', '🟡', '🟠', '🔴', '🚨'][severity + 1] AS symbol,
       coalesce(['ℹ️', '🟡', '🟠', '🔴', '🚨'][severity + 4], '❓') AS beyond FROM ({ORACLE['severity_matrix']})"""
ORACLE["correlated_metrics"] = f"WITH RECURSIVE {CORR} SELECT metric, component, size FROM big"
ORACLE["regraded"] = f"""WITH RECURSIVE {CORR}
SELECT series_id, seq, CASE WHEN metric IS NOT NULL AND severity < 4 THEN severity + 1 ELSE severity END AS severity
FROM a LEFT JOIN big ON series_id = metric"""

# --- forecasting -------------------------------------------------------------

REV = """d AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts, sum(l_extendedprice * (1 - l_discount)) AS value
      FROM lineitem GROUP BY 1, 2),
s AS (SELECT series_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
             count(*) OVER (PARTITION BY series_id) AS n FROM d)"""
CUM = """d0 AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts, count(*) AS c FROM lineitem GROUP BY 1, 2),
d AS (SELECT series_id, ts, CAST(sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM d0),
s AS (SELECT series_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
             count(*) OVER (PARTITION BY series_id) AS n FROM d)"""
FIT = """iv AS (SELECT series_id, median(dt) AS dt FROM (
        SELECT series_id, (us - lag(us) OVER (PARTITION BY series_id ORDER BY us)) / 1e6 AS dt FROM s) GROUP BY 1),
fit AS (SELECT series_id, count(*) AS n, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS icept,
               regr_r2(value, idx) AS r2, avg(value) AS mean, stddev_pop(value) AS sd, arg_max(value, idx) AS cur,
               max(us) AS last_us FROM s GROUP BY 1),
res AS (SELECT s.series_id, stddev_pop(value - (slope * idx + icept)) AS rsd FROM s JOIN fit USING (series_id) GROUP BY 1)"""
PROJECTED = f"""{REV}, {FIT}, {acf('s')},
t AS (SELECT a.series_id, a.idx, any_value(a.value) AS value, any_value(p.period) AS period, a.idx % any_value(p.period) AS phase,
             avg(b.value) AS trend
      FROM s a JOIN best p ON a.series_id = p.series_id
      JOIN s b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx - p.period // 2 AND a.idx + p.period // 2
      GROUP BY 1, 2),
{seasonal('t')},
steps AS (SELECT fit.*, period, unnest(range(0, 60)) AS step FROM fit JOIN best USING (series_id)),
p AS (SELECT steps.series_id, step, last_us + CAST(round((step + 1) * dt * 1e6) AS BIGINT) AS us,
             slope * (n + step) + icept + seasonal AS predicted,
             {Z95} * rsd * sqrt(1 + 1.0 / n + power(n + step - (n - 1) / 2.0, 2) / (n * (n * n - 1.0) / 12)) AS w
      FROM steps JOIN iv USING (series_id) JOIN res USING (series_id)
      JOIN se ON se.series_id = steps.series_id AND se.phase = (n + step) % period)"""
ORACLE["forecast_points"] = f"""WITH {PROJECTED}
SELECT series_id, CAST(step AS INTEGER) AS step, us, {rnd('predicted', 'predicted', 2)}, {rnd('predicted - w', 'lower', 2)},
       {rnd('predicted + w', 'upper', 2)} FROM p"""
# one half less the series z + z^3 / 3 + z^5 / 15 + ... times the density
ORACLE["sla_risk"] = f"""WITH {PROJECTED},
z AS (SELECT series_id, step, (500000.0 - predicted) / (w / {Z95}) AS z FROM p WHERE step < 24 AND w > 0),
k AS (SELECT series_id, step, any_value(z) AS z, sum(exp((2 * k + 1) * ln(abs(z)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))) AS total
      FROM (SELECT *, unnest(range(0, 200)) AS k FROM z) WHERE abs(z) < 9 GROUP BY 1, 2),
c AS (SELECT series_id, CASE WHEN z.z <= -9 THEN 1.0 WHEN z.z >= 9 THEN 0.0
             ELSE 0.5 - sign(z.z) * exp(-z.z * z.z / 2) / sqrt(2 * pi()) * coalesce(total, 0) END AS chance
      FROM z LEFT JOIN k USING (series_id, step))
SELECT series_id, {rnd('coalesce(max(chance), 0.0)', 'sla_risk_score')} FROM fit LEFT JOIN c USING (series_id) GROUP BY 1"""
# P(|T| > t) with n - 2 degrees of freedom, where r2 is the squared sine of the angle: a finite sum of powers of its cosine
ORACLE["trend_pvalue"] = f"""WITH {REV}, {FIT},
terms AS (SELECT series_id, n - 2 AS df, r2, unnest(range(0, (n - 2 - CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END) // 2)) AS k FROM fit),
sums AS (SELECT series_id, sum(exp(k * ln(1 - r2) + CASE WHEN df % 2 = 0 THEN lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)
                                   ELSE 2 * lgamma(k + 1) - lgamma(2 * k + 2) + k * ln(4) END)) AS total FROM terms GROUP BY 1),
pv AS (SELECT series_id, greatest(0.0, 1 - CASE WHEN n % 2 = 0 THEN sqrt(r2) * total
                                     ELSE 2 / pi() * (atan2(sqrt(r2), sqrt(1 - r2)) + sqrt(r2 * (1 - r2)) * total) END) AS p
       FROM fit JOIN sums USING (series_id))
SELECT series_id, {rnd('p', 'p_value', 8)}, CAST(p < 0.05 AS INTEGER) AS significant FROM pv"""
ORACLE["forecast_summary"] = f"""WITH {CUM}, {FIT},
x AS (SELECT *, slope * n + icept AS level, CASE WHEN slope > 0 AND slope * n + icept < 1000000.0
             THEN (1000000.0 - (slope * n + icept)) / slope * dt END AS ahead FROM fit JOIN iv USING (series_id))
SELECT series_id, CAST(0.95 AS DOUBLE) AS confidence, {rnd('slope / dt', 'trend_slope', 10)}, {rnd('ahead / 86400', 'days_to_exhaustion', 3)},
       strftime(make_timestamp(CAST(last_us + round(ahead * 1e6) AS BIGINT)), '%Y-%m-%d') AS exhaustion_day,
       CAST(30 AS INTEGER) AS n_points FROM x"""
ORACLE["trend_summary"] = f"""WITH {REV}, {FIT}
SELECT series_id, 'ok' AS status, {rnd('slope', 'slope', 4)}, {rnd('r2', 'r_squared', 8)},
       CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
       {rnd('cur', 'current_value', 2)}, {rnd('mean', 'mean', 2)}, {rnd('sd', 'sd', 2)} FROM fit"""
ORACLE["forecast_recent"] = f"""WITH {M},
f AS (SELECT series_id, regr_slope(value, idx) AS slope, arg_max(value, idx) AS level, stddev_pop(value) AS sd
      FROM m WHERE idx >= n - 20 GROUP BY 1),
p AS (SELECT *, unnest(range(0, 12)) AS step FROM f),
q AS (SELECT series_id, step, level + slope * (step + 1) AS mean, {Z95} * sd * sqrt(1 + step / 12.0) AS w FROM p)
SELECT series_id, CAST(step AS INTEGER) AS step, {rnd('mean', 'mean', 4)}, {rnd('mean - w', 'lower', 4)}, {rnd('mean + w', 'upper', 4)} FROM q"""
ORACLE["forecast_custom"] = f"""WITH {M},
f AS (SELECT series_id, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM m WHERE idx >= n - 100 GROUP BY 1)
SELECT series_id, CAST(unnest(range(0, 3)) AS INTEGER) AS step, {rnd('mean', 'mean')}, {rnd('lo', 'lower')}, {rnd('hi', 'upper')} FROM f"""

# --- alerts ------------------------------------------------------------------

FIRE = f"""fire AS (
  SELECT {FP.format(name='event_type')} AS fp, event_type AS metric_name, epoch_us(ts) AS us, event_id AS seq, value,
         least(value / 490.0, 1.0) AS score, {grade('least(value / 490.0, 1.0)')} AS severity FROM events)"""
CMD = f"""cmd AS (
  SELECT {FP.format(name="CASE WHEN value > 250 THEN 'click' ELSE 'error' END")} AS fp, epoch_us(ts) AS us, event_id AS seq,
         CASE WHEN value > 250 THEN 'resolve' ELSE 'acknowledge' END AS kind
  FROM events WHERE event_type = 'purchase' AND (value > 250 OR value < 15))"""
SIL = f"""sil0 AS (
  SELECT {FP.format(name="CASE WHEN value > 300 THEN 'signup' ELSE 'view' END")} AS fp, epoch_us(ts) AS s0
  FROM events WHERE event_type = 'purchase' AND (value > 300 OR value < 20)),
sil AS (SELECT fp, s0, least(s0 + 5400000000, coalesce(lead(s0) OVER (PARTITION BY fp ORDER BY s0), s0 + 5400000000)) AS s1 FROM sil0)"""
MUTED = """f AS (SELECT fire.*, EXISTS (SELECT 1 FROM sil WHERE sil.fp = fire.fp AND fire.us >= s0 AND fire.us < s1) AS muted FROM fire)"""


def lifecycle(fires_cte: str, with_commands: bool, window_us: int = 300_000_000) -> str:
    """Episodes from a table f(fp, metric_name, us, seq, value, score, severity, muted)."""
    resolves = "UNION ALL SELECT fp, us, seq, 'resolve', NULL, NULL, NULL, NULL FROM cmd WHERE kind = 'resolve'" if with_commands else ""
    acks = "UNION ALL SELECT fp, us, seq, 'acknowledge', NULL, NULL, NULL, NULL, 0 FROM cmd WHERE kind = 'acknowledge'" if with_commands else ""
    return f"""{fires_cte},
ev AS (SELECT fp, us, seq, 'fire' AS kind, metric_name, value, score, severity FROM f WHERE NOT muted {resolves}),
mk AS (SELECT *, lag(us) OVER o AS pu, lag(kind) OVER o AS pk FROM ev WINDOW o AS (PARTITION BY fp ORDER BY us, seq)),
st AS (SELECT fp, us, seq, kind, metric_name, value, score, severity,
              CASE WHEN kind = 'fire' AND (pu IS NULL OR pk = 'resolve' OR us - pu >= {window_us}) THEN 1 ELSE 0 END AS starts FROM mk),
al AS (SELECT * FROM st UNION ALL SELECT fp, us, seq, 'muted', NULL, NULL, NULL, NULL, 0 FROM f WHERE muted {acks}),
ep AS (SELECT *, sum(starts) OVER (PARTITION BY fp ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS episode FROM al),
ch AS (SELECT *, CASE WHEN starts = 1 THEN 'firing' WHEN kind = 'acknowledge' THEN 'acknowledged' WHEN kind = 'muted' THEN 'silenced' END AS change
       FROM ep WHERE episode > 0),
run AS (SELECT fp, episode, any_value(metric_name) AS metric_name, max(severity) AS severity,
               min(us) FILTER (kind = 'fire') AS first_us, max(us) FILTER (kind = 'fire') AS last_fire,
               min(us) FILTER (kind = 'resolve') AS resolved, count(*) FILTER (kind = 'fire') AS count,
               arg_max(value, (us, seq)) FILTER (kind = 'fire') AS value, arg_max(score, (us, seq)) FILTER (kind = 'fire') AS score,
               arg_min(value, (us, seq)) FILTER (kind = 'fire') AS v0, arg_min(score, (us, seq)) FILTER (kind = 'fire') AS c0,
               arg_max(change, (us, seq)) FILTER (change IS NOT NULL) AS change
        FROM ch GROUP BY 1, 2),
alerts AS (SELECT 'alert-' || fp || '-' || (first_us // 1000000) AS id, fp AS fingerprint, episode, metric_name, severity,
                  CASE WHEN resolved IS NOT NULL THEN 'resolved' ELSE change END AS state, first_us,
                  coalesce(resolved, last_fire) AS last_us, count, value, score,
                  printf('Anomaly detected on %s: value=%.2f, score=%.2f', metric_name, v0, c0) AS message,
                  episode = max(episode) OVER (PARTITION BY fp) AS cur FROM run)"""


ALERTS = (f"SELECT id, fingerprint, metric_name, CAST(severity AS INTEGER) AS severity, state, first_us, last_us, count, "
          f"{rnd('value', 'value')}, {rnd('score', 'score')}, message")
PLAIN = f"{FIRE}, f AS (SELECT *, false AS muted FROM fire)"
ORACLE["alert_episodes"] = f"WITH {lifecycle(PLAIN, False)} {ALERTS}, CAST(cur AS INTEGER) AS is_current FROM alerts"
ORACLE["alert_silenced"] = f"WITH {FIRE}, {SIL}, {MUTED} SELECT fp AS fingerprint, seq FROM f WHERE muted"
FULL = lifecycle(f"{FIRE}, {SIL}, {CMD}, {MUTED}", True)
ORACLE["alert_lifecycle"] = f"WITH {FULL} {ALERTS}, CAST(cur AS INTEGER) AS is_current FROM alerts"
ORACLE["alert_active"] = f"""WITH {FULL}
SELECT fingerprint, metric_name, state, count FROM alerts WHERE cur AND state IN ('firing', 'acknowledged')"""
CMDS = lifecycle(f"{CMD}, {PLAIN}", True)
ORACLE["alert_history"] = f"""WITH {CMDS}
SELECT id, count, {rnd('(last_us - first_us) / 6e7', 'duration_minutes')} FROM alerts WHERE state = 'resolved'"""
# an alert that is still firing 30 minutes after its start is raised by one level, from the severity it had until then
ORACLE["stream_alerts"] = f"""WITH {FULL},
stops AS (SELECT fp, episode, min(us) FILTER (kind <> 'fire') AS stop, min(us) FILTER (kind = 'fire') AS first_us FROM ch GROUP BY 1, 2),
ends AS (SELECT fp, episode, first_us + 1800000000 AS due, least(stop, lead(first_us) OVER (PARTITION BY fp ORDER BY episode)) AS stop FROM stops),
sev AS (SELECT ch.fp, ch.episode, max(severity) AS severity, max(severity) FILTER (us <= due) AS until_due, any_value(due) AS due, any_value(stop) AS stop
        FROM ch JOIN ends USING (fp, episode) WHERE kind = 'fire' GROUP BY 1, 2),
raised AS (SELECT fp AS fingerprint, episode,
                  CASE WHEN (stop IS NULL OR stop > due) AND until_due < 4 THEN greatest(severity, until_due + 1) ELSE severity END AS severity FROM sev)
SELECT id, fingerprint, metric_name, CAST(raised.severity AS INTEGER) AS severity, state, first_us, last_us, count,
       {rnd('value', 'value')}, {rnd('score', 'score')}, message FROM alerts JOIN raised USING (fingerprint, episode)"""
ORACLE["alert_escalated"] = f"""WITH {lifecycle(f"{FIRE}, f AS (SELECT *, false AS muted FROM fire)", False, 2_400_000_000)},
ticks AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) AS t FROM events)
SELECT id, CAST(CASE WHEN cur AND state = 'firing'
                     THEN least(4, severity + (SELECT count(*) FROM ticks WHERE t > first_us + 1800000000)) ELSE severity END AS INTEGER) AS severity
FROM alerts"""
ORACLE["alert_outbox"] = f"""WITH {CMDS},
ch2 AS (SELECT unnest(['webhook', 'email', 'slack', 'pagerduty']) AS channel),
lab AS (SELECT *, ['info', 'low', 'medium', 'high', 'critical'][severity + 1] AS label FROM alerts)
SELECT channel, fingerprint AS dedup_key, CASE WHEN channel = 'webhook' THEN id END AS id,
       CASE WHEN channel = 'email' THEN '[Ops ' || upper(label) || '] ' || metric_name END AS subject,
       CASE WHEN channel = 'slack' THEN ['#36a64f', '#daa520', '#ff8c00', '#ff4500', '#dc143c'][severity + 1] END AS color,
       CASE WHEN channel = 'slack' THEN printf('%.4f', value) END AS shown_value,
       CASE WHEN channel = 'pagerduty' THEN CASE WHEN state = 'firing' THEN 'trigger' ELSE 'resolve' END END AS event_action,
       CASE WHEN channel = 'pagerduty' THEN ['info', 'warning', 'warning', 'error', 'critical'][severity + 1] END AS pager_severity
FROM lab, ch2"""

# --- maintenance ---------------------------------------------------------------

WIN = """win AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 1704067200000000 + (c_custkey * 37 % 43200) * 60000000 AS s,
         1704067200000000 + (c_custkey * 37 % 43200) * 60000000 + CAST(c_nationkey AS BIGINT) * 30000000 AS e,
         CASE c_mktsegment WHEN 'BUILDING' THEN ['click'] WHEN 'AUTOMOBILE' THEN ['sign', 'err'] WHEN 'MACHINERY' THEN ['purchase']
                           WHEN 'HOUSEHOLD' THEN ['77'] ELSE ['view'] END AS targets,
         c_acctbal > 0 AS recal, c_mktsegment AS seg FROM customer),
tg AS (SELECT *, unnest(targets) AS t FROM win)"""
NOW = "1705320000000000"
HITS = f"""{WIN}, lab AS (SELECT event_type AS series_id, event_id AS seq, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS u, {K} AS k FROM events),
hits AS (SELECT DISTINCT lab.series_id, seq, id FROM lab JOIN tg ON us BETWEEN s AND e
         AND (contains(series_id, t) OR contains(u, t) OR contains(k, t)))"""
ORACLE["maintenance_suppressed"] = f"WITH {HITS} SELECT DISTINCT series_id, seq FROM hits"
ORACLE["maintenance_survivors"] = f"WITH {HITS} SELECT series_id, seq FROM lab WHERE seq NOT IN (SELECT seq FROM hits)"
ORACLE["maintenance_matches"] = f"WITH {HITS} SELECT seq, id AS window_id FROM hits"
ORACLE["maintenance_many_targets"] = f"""WITH {WIN},
own AS (SELECT id, s, s + (CAST(id AS BIGINT) % 24 + 1) * 3600000000 AS e, unnest([id, 'ic' || id, right(name, 2)]) AS t FROM win),
lab AS (SELECT event_type AS series_id, event_id AS seq, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS u, {K} AS k FROM events)
SELECT DISTINCT seq, id AS window_id FROM lab JOIN own ON us BETWEEN s AND e
  AND (contains(series_id, t) OR contains(u, t) OR contains(k, t))"""
ORACLE["maintenance_long_windows"] = f"""WITH {WIN},
lw AS (SELECT CAST(id AS BIGINT) AS id, e, targets,
              s - 1000000 * CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN CAST(id AS BIGINT) % 40 * 31536000
                                                        WHEN 1 THEN CAST(id AS BIGINT) % 50 * 86400 ELSE 0 END AS s FROM win)
SELECT event_id AS seq, count(*) AS windows, min(id) AS first_window
FROM events JOIN lw ON epoch_us(ts) BETWEEN s AND e AND len(list_filter(targets, lambda t: contains(event_type, t))) > 0 GROUP BY 1"""
ORACLE["maintenance_due"] = f"""WITH {WIN}
SELECT id, name FROM win WHERE recal AND {NOW} > e AND {NOW} >= e + 900000000 AND seg <> 'BUILDING'"""
ORACLE["maintenance_listing"] = f"""WITH {WIN}
SELECT id, CAST({NOW} BETWEEN s AND e AS INTEGER) AS is_active, {rnd('(e - s) / 6e7', 'duration_minutes')} FROM win WHERE NOT ({NOW} > e)"""
ORACLE["maintenance_json"] = f"""WITH {WIN}
SELECT id, {rnd('s / 1e6', 'start_time', 3)}, {rnd('e / 1e6', 'end_time', 3)}, len(targets) AS targets, CAST(recal AS INTEGER) AS recalibrate,
       CAST({NOW} BETWEEN s AND e AS INTEGER) AS is_active, {rnd('(e - s) / 6e7', 'duration_minutes')} FROM win"""
ORACLE["maintenance_expired"] = f"WITH {WIN} SELECT id FROM win WHERE e < {NOW} - 86400000000"
BARE = f"""{WIN}, bare AS (SELECT event_type AS series_id, event_id AS seq, epoch_us(ts) AS us, value FROM events),
bhits AS (SELECT DISTINCT series_id, seq, id, e, recal FROM bare JOIN tg ON us BETWEEN s AND e AND contains(series_id, t))"""
ORACLE["maintenance_refit"] = f"""WITH {BARE},
since AS (SELECT series_id, max(e) AS e FROM bhits WHERE recal AND {NOW} > e AND {NOW} >= e + 900000000 GROUP BY 1)
SELECT series_id, count(*) AS n, {rnd('avg(value)', 'mean')}, {rnd('stddev_pop(value)', 'sd')}
FROM bare JOIN since USING (series_id) WHERE us > e + 900000000 GROUP BY 1"""
ORACLE["stream_suppressed"] = f"WITH {BARE} SELECT series_id, seq FROM bare WHERE seq NOT IN (SELECT seq FROM bhits)"
ORACLE["maintenance_changes"] = f"""WITH {WIN},
last AS (SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st,
                arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr, max(epoch_us(o_orderdate)) AS us FROM orders GROUP BY 1)
SELECT id, name, s AS start_us, e AS end_us FROM win WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, CASE WHEN st = 'O' THEN pr ELSE 'Maintenance' END, us, us + 3600000000 FROM last WHERE st <> 'F'"""
ORACLE["alert_from_anomalies"] = f"""WITH {ANOM}, {BARE},
f AS (SELECT {FP.format(name='series_id')} AS fp, series_id AS metric_name, us, seq, value, score, severity, false AS muted
      FROM a WHERE seq NOT IN (SELECT seq FROM bhits)), {lifecycle('nothing AS (SELECT 1)', False)}
{ALERTS}, CAST(cur AS INTEGER) AS is_current FROM alerts"""
ORACLE["health"] = f"""WITH {WIN}, {CMDS}
SELECT (SELECT count(*) FROM alerts WHERE cur AND state <> 'resolved') AS active_alerts,
       (SELECT count(*) FROM win WHERE {NOW} BETWEEN s AND e) AS active_maintenance_windows"""

# --- sources and sinks ---------------------------------------------------------

ORACLE["prom_parse"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) // 1000 * 1000 AS us, CAST(user_id AS VARCHAR) AS user_label,
       {K} AS k, event_id AS seq, 'prod' AS env FROM events"""
ORACLE["statsd_parse"] = f"""
SELECT event_type AS name, {rnd("CASE WHEN event_type = 'click' THEN value / 0.5 ELSE value END", 'value')},
       CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' WHEN 'error' THEN 'timer' ELSE 'x' END AS type,
       CAST(user_id AS VARCHAR) AS user_label, event_id AS seq, 'true' AS flagged FROM events"""
ORACLE["stream_statsd"] = f"SELECT event_type AS name, {rnd('value / 0.25', 'value')}, event_id AS seq FROM events"
SNMP = """o AS (
  SELECT o_orderpriority AS host, o_orderstatus AS st, o_orderkey AS seq, epoch_us(o_orderdate) AS us,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w % 4294967296 AS DOUBLE) AS value
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, lag(value) OVER (PARTITION BY host, st ORDER BY us, seq) AS prev FROM o),
x AS (SELECT *, CASE WHEN st IN ('F', 'O') THEN CASE WHEN prev IS NULL THEN 'ifInOctets' ELSE 'ifInOctets_delta' END ELSE 'sysUpTime' END AS name,
             CASE WHEN st IN ('F', 'O') AND prev IS NOT NULL THEN CASE WHEN value >= prev THEN value - prev ELSE 4294967296.0 - prev + value END
                  ELSE value END AS v, CASE WHEN st IN ('F', 'O') THEN 'bytes' ELSE 'ticks' END AS unit,
             CASE st WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '0' END AS if_index FROM p)"""
ORACLE["snmp_parse"] = f"""WITH {SNMP}
SELECT name, seq, {rnd('v', 'value', 1)}, unit, 'snmp://' || host || ':161' AS source, host, if_index, 'a' AS site FROM x"""
ORACLE["stream_counters"] = f"WITH {SNMP} SELECT name, seq, {rnd('v', 'value', 1)}, unit, if_index FROM x"
ORACLE["csv_roundtrip"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS user_label, event_id AS seq,
       CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, 'prod' AS env FROM events WHERE value >= 5"""
ORACLE["csv_mixed_headers"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, 'say "' || user_id || '", ok' AS note, event_id AS seq FROM events"""
ORACLE["json_roundtrip"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS user_label, event_id AS seq,
       'prod' AS env FROM events WHERE value >= 5"""
ORACLE["json_one_document"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS user_label, event_id AS seq,
       'a }} "]" {{' AS note FROM events WHERE value >= 5"""
ORACLE["format_auto"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, event_id AS seq FROM events"""
ORACLE["store_ingest"] = """
SELECT event_type AS name, count(*) AS points, (SELECT count(*) FROM events WHERE value >= 5) AS ingested
FROM events WHERE value >= 5 GROUP BY 1"""
ORACLE["metrics_serde"] = f"""
SELECT event_type AS name, {rnd('value', 'value')}, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS user_label,
       'events' AS source, '' AS unit FROM events"""
ORACLE["anomaly_sink"] = f"WITH {ANOM} SELECT series_id AS metric_name, us, {rnd('value', 'value')}, {rnd('score', 'score')}, severity FROM a"
ORACLE["union_batches"] = f"""
SELECT event_type AS name, CASE WHEN value > 100 THEN '' END AS unit, count(*) AS points, {rnd('sum(value)', 'total', 2)}
FROM events GROUP BY 1, 2"""

# --- streams -----------------------------------------------------------------

ORACLE["stream_zscore"] = f"WITH {SW} SELECT series_id, seq, {rnd('z', 'score')} FROM wz"
ORACLE["stream_scored"] = ORACLE["detect_zscore"]
# with a closing row, every bin is emitted
ORACLE["stream_resample_closed"] = f"""
WITH b AS (SELECT event_type AS series_id, epoch_us(date_trunc('hour', ts)) AS bin_us, avg(value) AS value FROM events GROUP BY 1, 2)
SELECT series_id, bin_us, {rnd('value', 'value')} FROM b"""
ORACLE["stream_sliding_closed"] = f"""
WITH s AS (SELECT event_type AS series_id, value, unnest([epoch_us(ts) // 7200000000 * 7200000000 - i * 7200000000 for i in range(0, 3)]) AS span_us FROM events),
b AS (SELECT series_id, span_us, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM s GROUP BY 1, 2)
SELECT series_id, span_us, n, {rnd('mean', 'mean')}, {rnd('sd', 'sd')} FROM b"""
ORACLE["stream_resample"], ORACLE["stream_sliding"] = ORACLE["stream_resample_closed"], ORACLE["stream_sliding_closed"]
