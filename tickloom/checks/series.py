"""Time-series analytics (M) and aggregate / table functions (V4, V5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.registry import SQL, query
from tickloom.functions import udfs
from tickloom.operators import detectors as D
from tickloom.operators import models as M

C = F.col
K, O = ["series"], ["ts"]
W = "PARTITION BY series ORDER BY ts"


def raw(t):
    """Raw events per venue; the grouped operators put them on their own grid."""
    return t.ev.select(C("exchange").alias("series"), "ts", "value")


@query("m1_zscore_global", uses="ev", doubles="z_score", sql="""WITH s AS (SELECT exchange AS series, avg(value) AS m, stddev_samp(value) AS sd FROM ev GROUP BY 1)
       SELECT exchange AS series, ts, (value - m) / sd AS z_score, abs((value - m) / sd) > 3 AS is_anomaly FROM ev JOIN s ON ev.exchange = s.series""")
def _(t):
    return D.anomalies_zscore(raw(t), K, O).drop("value")


@query("m1_zscore_rolling", uses="hourly", doubles="z_score", sql=f"""WITH r AS (SELECT *, CASE WHEN count(*) OVER w >= 48 THEN (value - avg(value) OVER w) / stddev_samp(value)
       OVER w END AS z FROM hourly WINDOW w AS ({W} ROWS 47 PRECEDING)) SELECT series, ts, z AS z_score, coalesce(abs(z) > 3, false) AS is_anomaly FROM r""")
def _(t):
    return D.anomalies_zscore(t.hourly, K, O, window=48).drop("value")


IQR = """CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - value) / (q3 - q1) WHEN value > q3 + 1.5 * (q3 - q1) THEN (value - q3 - 1.5 * (q3 - q1)) / (q3 - q1)
       ELSE 0 END AS score, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_anomaly"""


@query("m2_iqr_global", uses="ev", doubles="score", sql=f"""WITH s AS (SELECT exchange AS series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY
       1) SELECT series, ts, {IQR} FROM ev JOIN s ON ev.exchange = s.series""")
def _(t):
    return D.anomalies_iqr(raw(t), K, O).drop("value")


@query("m2_iqr_rolling", uses="hourly", doubles="score", sql=f"""WITH r AS (SELECT *, CASE WHEN count(*) OVER w >= 48 THEN quantile_cont(value, 0.25) OVER w END AS q1, CASE WHEN
       count(*) OVER w >= 48 THEN quantile_cont(value, 0.75) OVER w END AS q3 FROM hourly WINDOW w AS ({W} ROWS 47 PRECEDING)) SELECT series, ts, {IQR} FROM r""")
def _(t):
    return D.anomalies_iqr(t.hourly, K, O, window=48).drop("value")


@query("m3_cusum", uses="hourly", doubles="cusum_pos cusum_neg score", sql=f"""WITH m AS (SELECT series, avg(value) AS m, stddev_samp(value) AS sd FROM hourly GROUP BY 1), z AS (SELECT h.series,
       h.ts, (value - m) / sd AS z, row_number() OVER ({W.replace('series', 'h.series').replace('ts', 'h.ts')}) AS i FROM hourly h JOIN m ON h.series = m.series), l AS (SELECT
       *, list(CASE WHEN i = 1 THEN 0 ELSE z - 0.1 END) OVER w AS u, list(CASE WHEN i = 1 THEN 0 ELSE -z - 0.1 END) OVER w AS d FROM z WINDOW w AS ({W} ROWS UNBOUNDED
       PRECEDING)), c AS (SELECT series, ts, list_reduce(u, lambda a, x: greatest(0, a + x)) AS cusum_pos, list_reduce(d, lambda a, x: greatest(0, a + x)) AS cusum_neg FROM l)
       SELECT *, greatest(cusum_pos, cusum_neg) AS score, greatest(cusum_pos, cusum_neg) > 5 AS is_anomaly FROM c""")
def _(t):
    return D.anomalies_cusum(t.hourly, K, O, drift=0.1).drop("value")


@query("m4_mad_global", uses="ev", doubles="score", sql="""WITH a AS (SELECT exchange AS series, quantile_cont(value, 0.5) AS m FROM ev GROUP BY 1), b AS (SELECT series, ts, abs(value - m) AS d
       FROM ev JOIN a ON ev.exchange = a.series), c AS (SELECT series, quantile_cont(d, 0.5) AS mad FROM b GROUP BY 1) SELECT b.series, ts, d / (mad * 1.4826) AS score, d / (mad
       * 1.4826) > 3.5 AS is_anomaly FROM b JOIN c ON b.series = c.series""")
def _(t):
    return D.anomalies_mad(raw(t), K, O).drop("value")


@query("m4_mad_rolling", uses="hourly", doubles="score", sql=f"""WITH r AS (SELECT *, list(value) OVER ({W} ROWS 48 PRECEDING) AS xs FROM hourly), m AS (SELECT *, list_median(xs) AS m FROM r),
       d AS (SELECT *, list_median([abs(x - m) for x in xs]) AS mad FROM m) SELECT series, ts, CASE WHEN len(xs) >= 3 AND mad > 0 THEN abs(value - m) / (mad * 1.4826) END AS
       score, coalesce(len(xs) >= 3 AND mad > 0 AND abs(value - m) / (mad * 1.4826) > 3.5, false) AS is_anomaly FROM d""")
def _(t):
    return D.anomalies_mad(t.hourly, K, O, window=48).drop("value")


@query("m5_seasonal_esd")
def _(t):
    return M.anomalies_seasonal_esd(raw(t), K, "1 hour", period=24)


@query("m6_anomaly_job", uses="ev", doubles="rate", sql="""WITH s AS (SELECT exchange AS series, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value,
       0.75) AS q3 FROM ev GROUP BY 1), f AS (SELECT s.series, ts, abs((value - m) / sd) > 3 AS z, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS i FROM ev JOIN s
       ON ev.exchange = s.series), l AS (SELECT series, ts, 'zscore' AS method, z AS a FROM f UNION ALL SELECT series, ts, 'iqr', i FROM f), r AS (SELECT *, row_number() OVER
       (PARTITION BY series, method ORDER BY ts DESC) AS rn FROM l), p AS (SELECT series, method, count(*) AS points, count(*) FILTER (a) AS anomalies, bool_or(a) FILTER (rn <=
       10) AS recent_warning, count(*) FILTER (a) / count(*) AS rate FROM r GROUP BY 1, 2), h AS (SELECT *, count(*) FILTER (rate > 0.05) OVER (PARTITION BY series) AS hits FROM
       p) SELECT series, method, points, anomalies, recent_warning, rate, CASE WHEN hits = 2 THEN 'HIGH' WHEN hits > 0 THEN 'MEDIUM' ELSE 'LOW' END AS consensus FROM h""")
def _(t):
    return D.anomaly_job(raw(t), K, O, methods=("zscore", "iqr"))


@query("m6_anomaly_job_all_methods", uses="ev", doubles="rate", sql="""WITH s AS (SELECT exchange AS series, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
       quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY 1), f AS (SELECT s.*, ts, value, (value - m) / sd AS z, abs(value - q2) AS dev, row_number() OVER (PARTITION BY exchange ORDER BY ts) AS i FROM ev JOIN s
       ON ev.exchange = s.series), a AS (SELECT series, quantile_cont(dev, 0.5) AS mad FROM f GROUP BY 1), u AS (SELECT f.*, mad, sum(CASE WHEN i = 1 THEN 0 ELSE z END) OVER w AS su FROM f JOIN a ON f.series =
       a.series WINDOW w AS (PARTITION BY f.series ORDER BY ts ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, greatest(su - min(su) OVER w, max(su) OVER w - su) > 5 AS cs FROM u WINDOW w AS
       (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)), l AS (SELECT series, ts, 'zscore' AS method, abs(z) > 3 AS a FROM c UNION ALL SELECT series, ts, 'iqr', value < q1 - 1.5 * (q3 - q1) OR
       value > q3 + 1.5 * (q3 - q1) FROM c UNION ALL SELECT series, ts, 'cusum', cs FROM c UNION ALL SELECT series, ts, 'mad', dev / (mad * 1.4826) > 3.5 FROM c), r AS (SELECT *, row_number() OVER
       (PARTITION BY series, method ORDER BY ts DESC) AS rn FROM l), p AS (SELECT series, method, count(*) AS points, count(*) FILTER (a) AS anomalies, bool_or(a) FILTER (rn <= 10) AS recent_warning,
       count(*) FILTER (a) / count(*) AS rate FROM r GROUP BY 1, 2), h AS (SELECT *, count(*) FILTER (rate > 0.05) OVER (PARTITION BY series) AS hits FROM p) SELECT series, method, points, anomalies,
       recent_warning, rate, CASE WHEN hits = 4 THEN 'HIGH' WHEN hits > 0 THEN 'MEDIUM' ELSE 'LOW' END AS consensus FROM h""")
def _(t):
    return D.anomaly_job(raw(t), K, O)


@query("m7_changepoints_cusum")
def _(t):
    return M.changepoints_cusum(raw(t), K, "1 hour")


@query("m8_changepoints_binseg")
def _(t):
    return M.changepoints_binseg(raw(t), K, "1 hour", penalty=500.0)


@query("m9_changepoints_bocpd")
def _(t):
    return M.changepoints_bocpd(raw(t), K, "1 hour")


@query("m10_basic_features", uses="hourly", digits=7, doubles="mean std variance min max skewness kurtosis trend_slope trend_r_squared acf_lag1 acf_lag5 return_mean diff_std p10 median p90",
       sql=f"""WITH a AS (SELECT series, value AS x, row_number() OVER w AS i, lag(value) OVER w AS l1, lag(value, 5) OVER w AS l5, value - lag(value) OVER w AS d FROM hourly WINDOW w AS
       ({W})), b AS (SELECT *, d * lag(d) OVER (PARTITION BY series ORDER BY i) < 0 AS cr FROM a), m AS (SELECT series, avg(value) AS m, var_pop(value) AS v FROM hourly GROUP BY 1)
       SELECT b.series, count(*) AS length, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance, min(x) AS min, max(x) AS max, avg(pow(x - m, 3)) / pow(max(v), 1.5) AS
       skewness, avg(pow(x - m, 4)) / pow(max(v), 2) - 3 AS kurtosis, regr_slope(x, i) AS trend_slope, pow(corr(x, i), 2) AS trend_r_squared, sum((x - m) * (l1 - m)) / (max(v) *
       count(*)) AS acf_lag1, sum((x - m) * (l5 - m)) / (max(v) * count(*)) AS acf_lag5, avg(x / l1 - 1) AS return_mean, stddev_samp(d) AS diff_std, count(*) FILTER (cr) AS
       zero_crossings, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.9) AS p90 FROM b JOIN m ON b.series = m.series GROUP BY 1""")
def _(t):
    return D.basic_features(t.hourly, K, O).select(
        "series", "length", "mean", "std", "variance", "min", "max", "skewness", "kurtosis", "trend_slope", "trend_r_squared", "acf_lag1", "acf_lag5",
        "return_mean", "diff_std", "zero_crossings", "p10", "median", "p90")


@query("m10_extra_features")
def _(t):
    return M.extra_features(raw(t), K, "1 hour")


@query("m11_sample_entropy")
def _(t):
    return M.sample_entropy(raw(t), K, "1 hour")


@query("m12_hurst_rs")
def _(t):
    return M.hurst_rs(raw(t), K, "1 hour")


@query("m13_seasonality")
def _(t):
    return M.seasonality(raw(t), K, "1 hour")


@query("m14_decompose", uses="hourly", doubles="trend seasonal residual", sql=f"""WITH a AS (SELECT *, row_number() OVER (o) AS i, CASE WHEN count(*) OVER (o ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25
       THEN (sum(value) OVER (o ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(value, 12) OVER (o) + lead(value, 12) OVER (o)) / 2) / 24 END AS trend FROM hourly WINDOW o AS
       ({W})), p AS (SELECT series, (i - 1) % 24 AS ph, avg(value - trend) AS s FROM a GROUP BY 1, 2), q AS (SELECT *, s - avg(s) OVER (PARTITION BY series) AS seasonal FROM p)
       SELECT a.series, a.ts, trend, seasonal, value - trend - seasonal AS residual FROM a JOIN q ON a.series = q.series AND (a.i - 1) % 24 = q.ph""")
def _(t):
    return D.decompose(t.hourly, K, O, 24).drop("value")


@query("m15_series_regime", uses="hourly", doubles="volatility vol_percentile trend_slope", sql=f"""WITH a AS (SELECT *, row_number() OVER (o) AS i, value / lag(value) OVER (o) - 1 AS r FROM hourly WINDOW o AS ({W})),
       b AS (SELECT *, CASE WHEN count(r) OVER (o ROWS 19 PRECEDING) >= 20 THEN stddev_samp(r) OVER (o ROWS 19 PRECEDING) * sqrt(252) END AS rv, stddev_samp(r) OVER (o ROWS 49
       PRECEDING) * sqrt(252) AS v, regr_slope(value, i) OVER (o ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS sl, avg(value) OVER (o ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)
       AS m FROM a WINDOW o AS ({W})), c AS (SELECT *, list_filter(list(rv) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda x: x IS NOT NULL) AS h FROM b), d AS
       (SELECT *, len([x for x in h if x < v]) / (i - 1) AS vp FROM c WHERE i > 50) SELECT series, ts, v AS volatility, vp AS vol_percentile, sl AS trend_slope, CASE WHEN vp > 0.9
       THEN 'HIGH_VOLATILITY' WHEN vp < 0.1 THEN 'LOW_VOLATILITY' WHEN sl > 0.001 * m THEN 'TRENDING_UP' WHEN sl < -0.001 * m THEN 'TRENDING_DOWN' ELSE 'RANGING' END AS regime
       FROM d""")
def _(t):
    return D.series_regime(t.hourly, K, O).drop("value")


REGIME_SQL = SQL["m15_series_regime"]


@query("m15_transition_matrix", doubles="probability", sql=f"""WITH r AS ({REGIME_SQL}), t AS (SELECT series, lag(regime) OVER ({W}) AS from_label, regime AS to_label FROM r), n AS (SELECT series, from_label,
       to_label, count(*) AS n FROM t WHERE from_label IS NOT NULL GROUP BY 1, 2, 3) SELECT *, n / sum(n) OVER (PARTITION BY series, from_label) AS probability FROM n""")
def _(t):
    return D.transition_matrix(D.series_regime(t.hourly, K, O), K, O)


@query("m16_mann_kendall")
def _(t):
    return M.mann_kendall(raw(t), K, "1 hour")


@query("m16_mann_kendall_seasonal")
def _(t):
    return M.mann_kendall(raw(t), K, "1 hour", "seasonal", 24)


@query("m16_mann_kendall_modified")
def _(t):
    return M.mann_kendall(raw(t), K, "6 hours", "modified")


@query("m17_dtw")
def _(t):
    """Every venue against the one named view."""
    pairs = t.ev.select(C("exchange").alias("a")).distinct().where("a <> 'view'").withColumn("b", F.lit("view"))
    return M.dtw(raw(t), "series", pairs, "6 hours", window=10)


@query("m18_similar_patterns")
def _(t):
    return M.similar_patterns(t.hourly, K, O, [40.0, 60.0, 50.0, 45.0, 70.0, 40.0], k=5)


@query("m19_forecast")
def _(t):
    return M.forecast(raw(t), K, "1 hour", "holt_winters")


@query("m20_auto_forecast")
def _(t):
    return M.auto_forecast(raw(t), K, "1 hour")


@query("m21_ensemble")
def _(t):
    return M.ensemble(M.all_forecasts(raw(t), K, "1 hour", methods=("naive", "seasonal_naive", "drift", "theta")), K)


@query("m22_stack_forecasts")
def _(t):
    return M.stack_forecasts(raw(t), K, "1 hour", methods=("naive", "seasonal_naive", "theta"))


PRED = "p AS (SELECT exchange AS series, ts, value AS y, lag(value) OVER (PARTITION BY exchange ORDER BY ts) AS yhat FROM ev)"


def naive_pairs(t):
    from tickloom.operators.windows import lag_change
    d = lag_change(raw(t), K, O, "value")
    return d.select("series", "ts", C("value").alias("y"), C("prev").alias("yhat"))


@query("m23_forecast_metrics", uses="ev", doubles="mape rmse mae mse mase smape r2 bias max_error median_ae coverage direction_accuracy", sql=f"""WITH {PRED}, q AS (SELECT *, abs(y - yhat) AS
       ae, y - lag(y) OVER w AS dy, yhat - lag(yhat) OVER w AS dp FROM p WHERE yhat IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, avg(ae / abs(y)) * 100
       AS mape, sqrt(avg(ae * ae)) AS rmse, avg(ae) AS mae, avg(ae * ae) AS mse, avg(ae) / avg(abs(dy)) AS mase, avg(2 * ae / (abs(y) + abs(yhat))) * 100 AS smape, 1 - sum(ae *
       ae) / (var_pop(y) * count(*)) AS r2, avg(yhat - y) AS bias, max(ae) AS max_error, quantile_cont(ae, 0.5) AS median_ae, avg(CASE WHEN y BETWEEN yhat - 50 AND yhat + 50
       THEN 100 ELSE 0 END) AS coverage, avg(CASE WHEN dy IS NOT NULL THEN CASE WHEN sign(dy) = sign(dp) THEN 1 ELSE 0 END END) * 100 AS direction_accuracy, count(*) AS points
       FROM q GROUP BY 1""")
def _(t):
    d = naive_pairs(t).withColumns({"lo": C("yhat") - 50, "hi": C("yhat") + 50})
    return D.forecast_metrics(d, K, O, lower="lo", upper="hi")


def _folds_sql(cols):
    return (f"WITH i AS (SELECT series, ts, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM hourly), f AS (SELECT *, unnest(range(5)) AS fold FROM i), "
            f"b AS (SELECT *, {cols} FROM f), r AS (SELECT series, ts, pos, CAST(fold AS INTEGER) AS fold, CASE WHEN pos >= t0 AND pos < t1 THEN 'test' WHEN pos >= a0 AND pos < a1 "
            "THEN 'train' END AS role FROM b WHERE a1 > a0 AND t1 > t0 AND ok) SELECT * FROM r WHERE role IS NOT NULL")


FOLD_SQL = {
    "expanding": """0 AS a0, greatest(0, greatest(floor(n * 0.1) * 2, n // 6) + fold * floor(n * 0.1) - floor(n * 0.01)) AS a1, greatest(floor(n * 0.1) * 2, n // 6) + fold *
        floor(n * 0.1) AS t0, least(greatest(floor(n * 0.1) * 2, n // 6) + (fold + 1) * floor(n * 0.1), n) AS t1, true AS ok""",
    "sliding": """CAST(fold * floor((n - floor(n * 0.9 / 5) - floor(n * 0.1)) / 5) AS BIGINT) AS a0, a0 + floor(n * 0.9 / 5) AS a1, a1 + floor(n * 0.01) AS t0, least(t0 + floor(n * 0.1), n) AS t1,
        true AS ok""",
    "purged": "0 AS a0, greatest(0, fold * (n // 5) - floor(n * 0.01)) AS a1, fold * (n // 5) AS t0, least((fold + 1) * (n // 5), n) AS t1, true AS ok",
    "blocked": """0 AS a0, greatest(0, (fold + 1) * (n // 6) - floor(n * 0.01)) AS a1, (fold + 1) * (n // 6) AS t0, least((fold + 2) * (n // 6), n) AS t1, true AS ok""",
    "walk_forward": "0 AS a0, 200 + fold * 100 AS a1, 200 + fold * 100 AS t0, 250 + fold * 100 AS t1, 250 + fold * 100 <= n AS ok"}


def _register_folds(name, params):
    @query(f"m24_cv_folds_{name}", uses="hourly", sql=_folds_sql(FOLD_SQL[name]))
    def _(t):
        return D.cv_folds(t.hourly, K, O, name, **params).drop("value")


for _name, _params in {"expanding": {"test_pct": 0.1}, "sliding": {"test_pct": 0.1}, "purged": {}, "blocked": {},
                       "walk_forward": {"min_train": 200, "test_size": 50, "step": 100}}.items():
    _register_folds(_name, _params)


@query("m24_cv_folds_combinatorial", uses="hourly", sql=f"""WITH i AS (SELECT series, ts, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM hourly), g AS (SELECT x.g AS g1,
       y.g AS g2, CAST(row_number() OVER (ORDER BY x.g, y.g) - 1 AS INTEGER) AS fold FROM (SELECT unnest(range(5)) AS g) x, (SELECT unnest(range(5)) AS g) y WHERE x.g < y.g), r AS
       (SELECT series, ts, pos, fold, CASE WHEN (pos >= g1 * (n // 5) AND pos < CASE WHEN g1 < 4 THEN (g1 + 1) * (n // 5) ELSE n END) OR (pos >= g2 * (n // 5) AND pos < CASE WHEN
       g2 < 4 THEN (g2 + 1) * (n // 5) ELSE n END) THEN 'test' WHEN pos < greatest(0, g1 * (n // 5) - floor(n * 0.01) - floor(n * 0.01)) THEN 'train' END AS role FROM i, g WHERE g1
       > 0) SELECT * FROM r WHERE role IS NOT NULL""")
def _(t):
    return D.cv_folds(t.hourly, K, O, "combinatorial").drop("value")


@query("m25_backtest")
def _(t):
    return M.backtest(raw(t), K, "1 hour", min_train=400, test_size=48, step=96)


@query("m25_compare_methods")
def _(t):
    return M.compare_methods(M.backtest(raw(t), K, "6 hours", min_train=60, test_size=12, step=20, period=4), K)


@query("m26_recommend_method")
def _(t):
    return M.recommend_method(D.basic_features(t.hourly, K, O), M.extra_features(raw(t), K, "1 hour"), M.seasonality(raw(t), K, "1 hour"), K)


def halves(t):
    d = raw(t)
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    return d.where(C("ts") < mid), d.where(C("ts") >= mid)


HALVES = "h AS (SELECT exchange AS series, value AS x, ts < TIMESTAMP '2024-01-16' AS r FROM ev)"


@query("m27_drift_ks", uses="ev", doubles="statistic", digits=9, sql=f"""WITH {HALVES}, n AS (SELECT series, count(*) FILTER (r) AS n_ref, count(*) FILTER (NOT r) AS n_cur FROM h GROUP BY 1), v AS (SELECT series, x,
       count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM h GROUP BY 1, 2), c AS (SELECT series, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM v WINDOW w AS (PARTITION BY
       series ORDER BY x)) SELECT c.series, n_ref, n_cur, max(abs(ca / n_ref - cb / n_cur)) AS statistic FROM c JOIN n ON c.series = n.series GROUP BY 1, 2, 3""")
def _(t):
    return D.drift_ks(*halves(t), K, "value").drop("p_value", "drift")


@query("m28_drift_psi", uses="ev", doubles="psi", sql=f"""WITH {HALVES}, e AS (SELECT series, min(x) FILTER (r) AS lo, max(x) FILTER (r) AS hi, count(*) FILTER (r) AS nr, count(*) FILTER (NOT r) AS nc FROM h GROUP
       BY 1), b AS (SELECT h.series, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS b, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS c FROM h JOIN e ON h.series = e.series
       WHERE x BETWEEN lo AND hi GROUP BY 1, 2), g AS (SELECT e.*, CAST(unnest(range(10)) AS DOUBLE) AS b FROM e), p AS (SELECT g.series, (coalesce(a, 0) + 1e-10) / (nr + 1e-9) AS p,
       (coalesce(c, 0) + 1e-10) / (nc + 1e-9) AS q FROM g LEFT JOIN b ON g.series = b.series AND g.b = b.b) SELECT series, sum((q - p) * ln(q / p)) AS psi, sum((q - p) * ln(q / p)) >
       0.25 AS drift FROM p GROUP BY 1""")
def _(t):
    return D.drift_psi(*halves(t), K, "value")


@query("m29_drift_js", uses="ev", doubles="js", sql=f"""WITH {HALVES}, e AS (SELECT series, min(x) AS lo, max(x) AS hi, count(*) FILTER (r) AS nr, count(*) FILTER (NOT r) AS nc FROM h GROUP BY 1), b AS (SELECT
       h.series, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS b, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS c FROM h JOIN e ON h.series = e.series GROUP BY 1, 2), g AS
       (SELECT e.*, CAST(unnest(range(10)) AS DOUBLE) AS b FROM e), d AS (SELECT g.series, coalesce(a, 0) / nr / ((hi - lo) / 10) + 1e-10 AS p, coalesce(c, 0) / nc / ((hi - lo) / 10)
       + 1e-10 AS q FROM g LEFT JOIN b ON g.series = b.series AND g.b = b.b), s AS (SELECT series, p / sum(p) OVER (PARTITION BY series) AS p, q / sum(q) OVER (PARTITION BY series) AS
       q FROM d) SELECT series, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) > 0.1 AS
       drift FROM s GROUP BY 1""")
def _(t):
    return D.drift_js(*halves(t), K, "value")


@query("m30_drift_online")
def _(t):
    return M.drift_online(raw(t), K, "1 hour", threshold=200.0)


@query("m31_drift_report")
def _(t):
    d = naive_pairs(t).select("series", "ts", C("y").alias("actual"), C("yhat").alias("predicted"))
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    return D.drift_report(d.where(C("ts") < mid), d.where(C("ts") >= mid), K)


@query("v4_udaf_entropy_hurst")
def _(t):
    return t.hourly.groupBy("series").agg(udfs.hurst_udaf()("ts", "value").alias("hurst_exponent"))


@query("v4_udaf_entropy")
def _(t):
    return t.hourly.groupBy("series").agg(udfs.entropy_udaf()("ts", "value").alias("sample_entropy"))


@query("v5_udtf_cv_bounds", uses="ev", sql="""WITH n AS (SELECT symbol, count(*) AS n FROM ev GROUP BY 1) SELECT symbol, CAST(fold AS INTEGER) AS fold, (fold + 1) * (n // 6) AS train_stop, (fold + 1) * (n // 6) AS
       test_start, least((fold + 2) * (n // 6), n) AS test_stop FROM n, (SELECT unnest(range(5)) AS fold)""")
def _(t):
    udfs.register_table_functions(t.spark)
    n = t.ev.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return t.spark.sql("SELECT symbol, f.* FROM {n}, LATERAL cv_bounds(n, 5) f", n=n)


@query("v5_udtf_book_levels", uses="books", doubles="price qty", sql="""SELECT vec_id, CAST(unnest(range(1, 11)) AS INTEGER) AS level, unnest([x.price for x in bids]) AS price, unnest([x.qty for x in bids]) AS qty
       FROM books""")
def _(t):
    udfs.register_table_functions(t.spark)
    text = F.to_json(F.transform("bids", lambda x: F.array(x["price"], x["qty"])))
    b = t.books.select("vec_id", text.alias("body"))
    return t.spark.sql("SELECT vec_id, l.* FROM {b}, LATERAL book_levels(body) l", b=b)
