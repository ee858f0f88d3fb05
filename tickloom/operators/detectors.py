"""Detectors, decomposition, drift and forecast scoring as window and aggregate plans over many series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import safe_div
from tickloom.operators.dominance import earlier_below
from tickloom.operators.series import attach, bounded, plan_series, quantiles, running
from tickloom.operators.windows import rows

C = F.col


def _global_z(df: DataFrame, keys, value: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return attach(df, s, keys).withColumn("z_score", F.when(C("_s") > 0, (C(value) - C("_m")) / C("_s"))).drop("_m", "_s")


def anomalies_zscore(df: DataFrame, keys, order, value: str = "value", threshold: float = 3.0, window: int | None = None) -> DataFrame:
    """Distance from the mean in sample deviations, of the whole series or of the last ``window`` rows."""
    if window is None:
        out = _global_z(df, keys, value)
    else:
        plan = plan_series(df, keys, order, depth=window)

        def body(d, p):
            w = rows(p, window)
            sd = F.stddev_samp(value).over(w)
            return d.withColumn("z_score", F.when((F.count(value).over(w) >= window) & (sd > 0), (C(value) - F.avg(value).over(w)) / sd))
        out = bounded(df, plan, window, body)
    return out.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


def anomalies_iqr(df: DataFrame, keys, order, value: str = "value", multiplier: float = 1.5, window: int | None = None) -> DataFrame:
    """Outside the quartiles by more than ``multiplier`` interquartile ranges; the score counts ranges."""
    if window is None:
        out = attach(df, quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}), keys)
    else:
        plan = plan_series(df, keys, order, depth=window)

        def body(d, p):
            w = rows(p, window)
            full = F.count(value).over(w) >= window
            return d.withColumns({"_q1": F.when(full, F.percentile(value, 0.25).over(w)), "_q3": F.when(full, F.percentile(value, 0.75).over(w))})
        out = bounded(df, plan, window, body)
    iqr, x = C("_q3") - C("_q1"), C(value)
    low, high = C("_q1") - multiplier * iqr, C("_q3") + multiplier * iqr
    return out.withColumns({
        "score": F.when((x < low) & (iqr > 0), (low - x) / iqr).when((x > high) & (iqr > 0), (x - high) / iqr).otherwise(0.0),
        "is_anomaly": F.coalesce((x < low) | (x > high), F.lit(False))}).drop("_q1", "_q3")


def anomalies_cusum(df: DataFrame, keys, order, value: str = "value", threshold: float = 5.0, drift: float = 0.0) -> DataFrame:
    """Two-sided cumulative sum of z-scores without reset.

    max(0, previous + step) equals the prefix sum minus its lowest prefix so far, so two running
    aggregates replace the recursion; the first row counts 0.
    """
    z = _global_z(df, keys, value)
    plan = plan_series(z, keys, order, depth=1)
    step = bounded(z, plan, 1, lambda d, p: d.withColumn("_first", F.lag(order[0]).over(p.window()).isNull()))
    step = step.withColumns({"_up": F.when(C("_first"), 0.0).otherwise(C("z_score") - drift),
                             "_dn": F.when(C("_first"), 0.0).otherwise(-C("z_score") - drift)})
    s = running(step, plan, {"_su": ("sum", "_up"), "_sd": ("sum", "_dn")})
    s = running(s, plan, {"_mu": ("min", "_su"), "_md": ("min", "_sd")})
    return s.withColumns({"cusum_pos": C("_su") - C("_mu"), "cusum_neg": C("_sd") - C("_md")}).withColumn(
        "score", F.greatest("cusum_pos", "cusum_neg")).withColumn("is_anomaly", C("score") > threshold).drop(
        "z_score", "_first", "_up", "_dn", "_su", "_sd", "_mu", "_md")


def _median(arr: Column) -> Column:
    s, n = F.array_sort(arr), F.size(arr)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def anomalies_mad(df: DataFrame, keys, order, value: str = "value", threshold: float = 3.5, window: int | None = None) -> DataFrame:
    """Robust z-score: distance from the median in units of 1.4826 median absolute deviations."""
    if window is None:
        med = attach(df, quantiles(df, keys, value, {"_med": 0.5}), keys).withColumn("_dev", F.abs(C(value) - C("_med")))
        out = attach(med, quantiles(med, keys, "_dev", {"_mad": 0.5}), keys)
        score = F.when(C("_mad") > 0, C("_dev") / (C("_mad") * 1.4826))
        drop = ["_med", "_dev", "_mad"]
    else:
        plan = plan_series(df, keys, order, depth=window + 1)
        out = bounded(df, plan, window + 1, lambda d, p: d.withColumn("_xs", F.collect_list(value).over(rows(p, window + 1))))
        out = out.withColumn("_med", _median(C("_xs")))
        out = out.withColumn("_mad", _median(F.transform("_xs", lambda x: F.abs(x - C("_med")))))
        score = F.when((F.size("_xs") >= 3) & (C("_mad") > 0), F.abs(C(value) - C("_med")) / (C("_mad") * 1.4826))
        drop = ["_xs", "_med", "_mad"]
    return out.withColumn("score", score).withColumn("is_anomaly", F.coalesce(C("score") > threshold, F.lit(False))).drop(*drop)


def anomaly_job(df: DataFrame, keys, order, value: str = "value", methods=("zscore", "iqr", "cusum", "mad")) -> DataFrame:
    """Anomaly count and rate per series and method, a warning for the last ten points, and the consensus."""
    found = {"zscore": anomalies_zscore, "iqr": anomalies_iqr, "cusum": anomalies_cusum, "mad": anomalies_mad}
    base = df.select(*keys, *order, value)
    parts = [found[m](base, keys, order, value).select(*keys, *order, F.lit(m).alias("method"), "is_anomaly") for m in methods]
    long = reduce(DataFrame.unionByName, parts)
    newest = Window.partitionBy(*keys, "method").orderBy(*[C(c).desc() for c in order])
    recent = (long.withColumn("_r", F.row_number().over(newest)).where(C("_r") <= 10).groupBy(*keys, "method")
              .agg(F.max("is_anomaly").alias("recent_warning")))
    per = long.groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(C("is_anomaly"), 1)).alias("anomalies"))
    per = per.join(recent, [*keys, "method"]).withColumn("rate", C("anomalies") / C("points"))
    over = Window.partitionBy(*keys)          # one row per method
    hits = F.sum(F.when(C("rate") > 0.05, 1).otherwise(0)).over(over)
    return per.withColumn("consensus", F.when(hits == len(methods), "HIGH").when(hits > 0, "MEDIUM").otherwise("LOW"))


def decompose(df: DataFrame, keys, order, period: int, value: str = "value", model: str = "additive") -> DataFrame:
    """Trend by centred moving average, seasonal means per phase, remainder."""
    half = period // 2
    plan = plan_series(df, keys, order, depth=half)
    one = running(df.withColumn("_one", F.lit(1)), plan, {"_i": ("sum", "_one")}).drop("_one")
    even = period % 2 == 0

    def body(d, p):
        w = p.window()
        frame = w.rowsBetween(-half, half)
        total = F.sum(value).over(frame)
        if even:
            total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        return d.withColumn("trend", F.when(F.count(value).over(frame) == 2 * half + 1, total / period))
    d = bounded(one, plan, half, body, ahead=half).withColumn("_phase", F.pmod(C("_i") - 1, F.lit(period)))
    add = model == "additive"
    d = d.withColumn("_free", C(value) - C("trend") if add else C(value) / C("trend"))
    per = d.groupBy(*keys, "_phase").agg(F.avg("_free").alias("_p"))
    mean = F.avg("_p").over(Window.partitionBy(*keys))           # ``period`` rows per key
    per = per.withColumn("seasonal", C("_p") - mean if add else C("_p") / mean).drop("_p")
    d = attach(d, per, [*keys, "_phase"])
    rest = C(value) - C("trend") - C("seasonal") if add else C(value) / C("trend") / C("seasonal")
    return d.withColumn("residual", rest).drop("_i", "_phase", "_free")


def series_regime(df: DataFrame, keys, order, value: str = "value", lookback: int = 50, vol_window: int = 20) -> DataFrame:
    """HIGH_VOLATILITY / LOW_VOLATILITY / TRENDING_UP / TRENDING_DOWN / RANGING of every point after ``lookback``.

    The volatility is placed among all rolling volatilities up to the point; positions without a rolling volatility count as
    not below. A long series is cut into chunks of time and ranges of volatility for that.
    """
    depth = lookback + vol_window + 2
    plan = plan_series(df, keys, order, depth=depth)
    base = running(df.withColumn("_one", F.lit(1)), plan, {"_i": ("sum", "_one")}).drop("_one")
    year = math.sqrt(252)

    def body(d, p):
        w, past = p.window(), rows(p, lookback, end=-1)
        prev = F.lag(value).over(w)
        d = d.withColumn("_r", F.when(prev != 0, C(value) / prev - 1))
        vw = rows(p, vol_window)
        return d.withColumns({
            "_rv": F.when(F.count("_r").over(vw) >= vol_window, F.stddev_samp("_r").over(vw) * year),
            "_v": F.stddev_samp("_r").over(rows(p, lookback)) * year,
            "_cov": F.covar_pop(C("_i").cast("double"), C(value)).over(past), "_var": F.var_pop("_i").over(past), "_mean": F.avg(value).over(past)})

    d = bounded(base, plan, depth, body)
    d = earlier_below(d, keys, order, "_rv", "_v", "_below").where(C("_i") > lookback)
    slope = safe_div(C("_cov"), C("_var"))
    d = d.withColumns({"volatility": C("_v"), "vol_percentile": C("_below") / (C("_i") - 1), "trend_slope": slope})
    return d.withColumn("regime", F.when(C("vol_percentile") > 0.9, "HIGH_VOLATILITY").when(C("vol_percentile") < 0.1, "LOW_VOLATILITY")
                        .when(C("trend_slope") > 0.001 * C("_mean"), "TRENDING_UP").when(C("trend_slope") < -0.001 * C("_mean"), "TRENDING_DOWN")
                        .otherwise("RANGING")).drop("_r", "_rv", "_v", "_cov", "_var", "_mean", "_below", "_i")


def transition_matrix(df: DataFrame, keys, order, label: str = "regime") -> DataFrame:
    """Share of every next label after each label (staying included)."""
    plan = plan_series(df, keys, order, depth=1)
    got = bounded(df, plan, 1, lambda d, p: d.withColumn("_f", F.lag(label).over(p.window()))).where(C("_f").isNotNull())
    n = got.groupBy(*keys, C("_f").alias("from_label"), C(label).alias("to_label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", C("n") / F.sum("n").over(Window.partitionBy(*keys, "from_label")))


def basic_features(df: DataFrame, keys, order, value: str = "value") -> DataFrame:
    """Moments, quantiles, linear trend, autocorrelations and change statistics of each series, JVM-side."""
    plan = plan_series(df, keys, order, depth=10)
    base = running(df.withColumn("_one", F.lit(1)), plan, {"_i": ("sum", "_one")}).drop("_one")
    x = C(value)

    def body(d, p):
        w = p.window()
        d = d.withColumns({**{f"_l{k}": F.lag(value, k).over(w) for k in (1, 2, 5, 10)}})
        d = d.withColumns({"_d": x - C("_l1"), "_ret": F.when(C("_l1") != 0, x / C("_l1") - 1)})
        return d.withColumn("_cross", F.when(F.lag("_d").over(w) * C("_d") < 0, 1).otherwise(0))
    d = bounded(base, plan, 10, body)
    mean = d.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_var"))
    d = attach(d, mean, keys)

    def acf(k):
        return safe_div(F.sum((x - C("_m")) * (C(f"_l{k}") - C("_m"))), F.max("_var") * F.count(F.lit(1))).alias(f"acf_lag{k}")
    i = C("_i").cast("double")
    cov, vi, vx = F.covar_pop(i, x), F.var_pop(i), F.var_pop(x)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        safe_div(cov, vi).alias("trend_slope"), safe_div(cov * cov, vi * vx).alias("trend_r_squared"), *[acf(k) for k in (1, 2, 5, 10)],
        (F.stddev_samp("_ret") * math.sqrt(252)).alias("volatility"), F.avg("_ret").alias("return_mean"), F.skewness("_ret").alias("return_skew"),
        F.kurtosis("_ret").alias("return_kurtosis"), F.avg("_d").alias("diff_mean"), F.stddev_samp("_d").alias("diff_std"),
        F.sum("_cross").alias("zero_crossings"))
    q = quantiles(df, keys, value, {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    return out.join(q, list(keys)).withColumns({"range": C("max") - C("min"), "iqr": C("p75") - C("p25")})


# ---- forecast scoring and folds ----

def forecast_metrics(df: DataFrame, keys, order, y: str = "y", yhat: str = "yhat", lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Error measures of forecasts per key; MASE scales by the naive one-step error of y itself."""
    d = df.where(C(y).isNotNull() & C(yhat).isNotNull()).withColumn("_ae", F.abs(C(y) - C(yhat)))
    plan = plan_series(d, keys, order, depth=1)
    d = bounded(d, plan, 1, lambda q, p: q.withColumns({"_dy": C(y) - F.lag(y).over(p.window()), "_dp": C(yhat) - F.lag(yhat).over(p.window())}))
    e = C(y) - C(yhat)
    inside = F.avg(F.when(C(y).between(C(lower), C(upper)), 100.0).otherwise(0.0)) if lower else F.lit(None).cast("double")
    out = d.groupBy(*keys).agg(
        (F.avg(F.when(C(y) != 0, C("_ae") / F.abs(y))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("_ae").alias("mae"),
        F.avg(e * e).alias("mse"), safe_div(F.avg("_ae"), F.avg(F.abs("_dy")), None).alias("mase"),
        (F.avg(safe_div(2 * C("_ae"), F.abs(y) + F.abs(yhat))) * 100).alias("smape"), safe_div(F.sum(e * e), F.var_pop(y) * F.count(y), None).alias("_u"),
        F.avg(-e).alias("bias"), F.max("_ae").alias("max_error"), inside.alias("coverage"),
        (F.avg(F.when(C("_dy").isNotNull(), F.when(F.signum("_dy") == F.signum("_dp"), 1.0).otherwise(0.0))) * 100).alias("direction_accuracy"),
        F.count(F.lit(1)).alias("points"))
    med = quantiles(d, keys, "_ae", {"median_ae": 0.5})
    return out.withColumn("r2", F.when(C("_u").isNotNull(), 1 - C("_u")).otherwise(0.0)).drop("_u").join(med, list(keys))


def fold_bounds(n: Column, strategy: str, splits: int = 5, test_pct: float = 0.2, gap: int = 0, embargo_pct: float = 0.01,
                purge_pct: float = 0.01, include_after: bool = False, min_train: int | None = None, test_size: int | None = None,
                step: int | None = None, test_groups: int = 2) -> Column:
    """Array of folds (fold, train ranges, test ranges) for a series of n points; ranges are half-open positions."""
    from itertools import combinations
    emb, purge = F.floor(n * embargo_pct), F.floor(n * purge_pct)
    zero = F.lit(0).cast("long")

    def rng(a, b):
        return F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"))

    def fold(i, train, test, ok=None):
        f = F.struct(F.lit(i).alias("fold"), F.array(*[rng(*t) for t in train]).alias("train"), F.array(*[rng(*t) for t in test]).alias("test"))
        good = reduce(lambda a, b: a | b, [t[1] > t[0] for t in train]) & reduce(lambda a, b: a | b, [t[1] > t[0] for t in test])
        return F.when(good if ok is None else good & ok, f)
    folds = []
    if strategy == "expanding":
        size = F.lit(test_size) if test_size else F.floor(n * test_pct)
        least = F.greatest(size * 2, F.floor(n / (splits + 1)))
        for i in range(splits):
            t0 = least + i * size
            end = F.greatest(zero, t0 - gap - emb)
            folds.append(fold(i, [(zero, end)], [(t0, F.least(t0 + size, n))], end >= F.floor(least / 2)))
    elif strategy == "sliding":
        size = F.lit(test_size) if test_size else F.floor(n * test_pct)
        width = F.floor(n * (1 - test_pct) / splits)
        hop = F.floor((n - width - size) / splits)
        for i in range(splits):
            t0 = i * hop + width + gap + emb
            folds.append(fold(i, [(i * hop, i * hop + width)], [(t0, F.least(t0 + size, n))]))
    elif strategy == "purged":
        size = F.floor(n / splits)
        for i in range(splits):
            t0, t1 = i * size, F.least((i + 1) * size, n)
            train = [(zero, F.greatest(zero, t0 - purge))] + ([(F.least(n, t1 + emb), n)] if include_after else [])
            folds.append(fold(i, train, [(t0, t1)]))
    elif strategy == "blocked":
        size = F.floor(n / (splits + 1))
        for i in range(splits):
            folds.append(fold(i, [(zero, F.greatest(zero, (i + 1) * size - emb))], [((i + 1) * size, F.least((i + 2) * size, n))]))
    elif strategy == "combinatorial":
        size = F.floor(n / splits)
        ends = [((i + 1) * size if i < splits - 1 else n) for i in range(splits)]
        for i, groups in enumerate(combinations(range(splits), test_groups)):
            test = [(g * size if g else zero, ends[g]) for g in groups]
            train = [(zero, F.greatest(zero, test[0][0] - purge - emb))] + ([(F.least(n, test[-1][1] + emb), n)] if include_after else [])
            folds.append(fold(i, train, test))
    elif strategy == "walk_forward":
        first, size, hop = min_train, test_size, step or test_size
        k = F.sequence(F.lit(0), F.greatest(F.lit(-1), F.floor((n - first - size) / hop)).cast("int"))
        walk = F.transform(k, lambda i: F.struct(
            i.alias("fold"), F.array(rng(zero, first + i * hop)).alias("train"), F.array(rng(first + i * hop, first + i * hop + size)).alias("test")))
        return F.when(n >= first + size, walk)
    else:
        raise ValueError(f"unknown fold strategy {strategy}")
    return F.filter(F.array(*folds), lambda f: f.isNotNull())


def cv_folds(df: DataFrame, keys, order, strategy: str, **params) -> DataFrame:
    """Rows with their position, each repeated for the folds it belongs to, with role train or test."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    d = running(one, plan_series(one, keys, order), {"_i": ("sum", "_one")}).withColumn("pos", C("_i") - 1).drop("_one", "_i")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bounds = n.select(*keys, fold_bounds(C("_n"), strategy, **params).alias("_folds"))
    pos = C("pos")

    def inside(ranges):
        return F.exists(ranges, lambda r: (pos >= r["start"]) & (pos < r["stop"]))
    marks = F.transform("_folds", lambda f: F.struct(f["fold"].alias("fold"), F.when(inside(f["test"]), "test").when(inside(f["train"]), "train").alias("role")))
    return (attach(d, bounds, keys).withColumn("_m", F.explode(F.filter(marks, lambda m: m["role"].isNotNull())))
            .select(*[c for c in d.columns], "_m.fold", "_m.role"))


# ---- distribution drift ----

def _both(ref: DataFrame, cur: DataFrame, keys, col: str) -> DataFrame:
    return (ref.select(*keys, C(col).cast("double").alias("_x"), F.lit(1).alias("_r"), F.lit(0).alias("_c"))
            .unionByName(cur.select(*keys, C(col).cast("double").alias("_x"), F.lit(0).alias("_r"), F.lit(1).alias("_c"))).where(C("_x").isNotNull()))


def drift_ks(ref: DataFrame, cur: DataFrame, keys, col: str, significance: float = 0.05) -> DataFrame:
    """Largest distance of the two empirical distributions, with the asymptotic p-value."""
    v = _both(ref, cur, keys, col).groupBy(*keys, "_x").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    d = running(v, plan_series(v, keys, ["_x"]), {"_cr": ("sum", "_r"), "_cc": ("sum", "_c")})
    n = v.groupBy(*keys).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    out = attach(d, n, keys).groupBy(*keys).agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(F.abs(C("_cr") / C("n_ref") - C("_cc") / C("n_cur"))).alias("statistic"))
    en = F.sqrt(C("n_ref") * C("n_cur") / (C("n_ref") + C("n_cur")))
    lam = (en + 0.12 + 0.11 / en) * C("statistic")
    p = reduce(lambda a, b: a + b, [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)])
    p = F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return out.withColumn("p_value", p).withColumn("drift", C("p_value") < significance)


def _bin(lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    i = F.floor((C("_x") - lo) / width)
    return (F.when((C("_x") < lo) | (C("_x") > hi), None).when(hi == lo, 0).otherwise(F.least(i, F.lit(bins - 1)))).cast("int")


def _binned(both: DataFrame, ends: DataFrame, keys, bins: int) -> DataFrame:
    """Counts per key and bin of both samples, all bins present."""
    count = (attach(both, ends, keys).withColumn("_b", _bin(C("_lo"), C("_hi"), bins)).where(C("_b").isNotNull())
             .groupBy(*keys, "_b").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c")))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_b"))
    return grid.join(count, [*keys, "_b"], "left").na.fill(0, ["_r", "_c"])


EPS = 1e-10


def drift_psi(ref: DataFrame, cur: DataFrame, keys, col: str, bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """Population stability index over equal bins of the reference range."""
    both = _both(ref, cur, keys, col)
    ends = both.groupBy(*keys).agg(F.min(F.when(C("_r") == 1, C("_x"))).alias("_lo"), F.max(F.when(C("_r") == 1, C("_x"))).alias("_hi"))
    n = both.groupBy(*keys).agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"))
    d = _binned(both, ends, keys, bins).join(n, list(keys))
    r, c = (C("_r") + EPS) / (C("_nr") + EPS * bins), (C("_c") + EPS) / (C("_nc") + EPS * bins)
    return d.groupBy(*keys).agg(F.sum((c - r) * F.log(c / r)).alias("psi")).withColumn("drift", C("psi") > threshold)


def drift_js(ref: DataFrame, cur: DataFrame, keys, col: str, bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """Jensen-Shannon divergence over equal bins of the common range."""
    both = _both(ref, cur, keys, col)
    ends = both.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    n = both.groupBy(*keys).agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"))
    d = _binned(both, ends, keys, bins).join(n, list(keys)).join(ends, list(keys))
    width = F.when(C("_hi") > C("_lo"), (C("_hi") - C("_lo")) / bins).otherwise(1.0 / bins)
    d = d.withColumns({"_p": C("_r") / C("_nr") / width + EPS, "_q": C("_c") / C("_nc") / width + EPS})
    tot = d.groupBy(*keys).agg(F.sum("_p").alias("_sp"), F.sum("_q").alias("_sq"))
    d = d.join(tot, list(keys)).withColumns({"_p": C("_p") / C("_sp"), "_q": C("_q") / C("_sq")})
    m = (C("_p") + C("_q")) / 2
    return d.groupBy(*keys).agg(F.sum((C("_p") * F.log(C("_p") / m) + C("_q") * F.log(C("_q") / m)) / 2).alias("js")).withColumn("drift", C("js") > threshold)


def drift_report(ref: DataFrame, cur: DataFrame, keys, pred: str = "predicted", actual: str = "actual", performance: float = 0.2) -> DataFrame:
    """Drift of predictions and errors, loss of accuracy, their severity and kind; both inputs hold matched forecasts."""
    k = list(keys)

    def scored(df):
        return df.where(C(actual).isNotNull() & C(pred).isNotNull()).withColumn("_err", F.abs(C(pred) - C(actual)))

    def mape(df, name):
        return df.groupBy(*k).agg((F.avg(F.when(C(actual) != 0, C("_err") / F.abs(actual))) * 100).alias(name))
    r, c = scored(ref), scored(cur)
    d = (drift_psi(r, c, k, pred).select(*k, C("psi").alias("prediction_psi"))
         .join(drift_psi(r, c, k, "_err").select(*k, C("psi").alias("error_psi")), k)
         .join(drift_ks(r, c, k, "_err").select(*k, C("statistic").alias("ks_statistic"), C("drift").alias("_ks")), k)
         .join(mape(r, "reference_mape"), k).join(mape(c, "current_mape"), k))
    d = d.withColumn("degradation", safe_div(C("current_mape") - C("reference_mape"), C("reference_mape")))
    hits = {"prediction_drift": (C("prediction_psi") > 0.25, C("prediction_psi")), "error_drift": (C("error_psi") > 0.25, C("error_psi")),
            "performance_degradation": (C("degradation") > performance, C("degradation")), "ks_test": (C("_ks"), C("ks_statistic"))}
    n = reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t, _ in hits.values()])
    top = F.greatest(*[F.when(t, v).otherwise(0.0) for t, v in hits.values()])
    d = d.withColumns({"signals": n, "max_signal": top})
    s, m = C("signals"), C("max_signal")
    return d.withColumns({
        "severity": F.when(s == 0, "none").when((s >= 3) | (m > 0.5), "critical").when((s >= 2) | (m > 0.35), "high").when(m > 0.25, "medium").otherwise("low"),
        "drift_type": F.when(s == 0, "none").when(C("degradation") > performance, "performance_drift").when(C("error_psi") > 0.25, "concept_drift")
                       .otherwise("data_drift"),
        "error_vs_baseline": F.when(C("current_mape") > C("reference_mape") * 1.5, "DRIFT_DETECTED").otherwise("STABLE")}).drop("_ks")
