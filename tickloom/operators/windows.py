"""Window features of ordered series, rankings and top-k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import safe_div
from tickloom.operators.series import (SeriesPlan, attach, bounded, islands, order_value, plan_series, position, quantiles,
                                       running)

C = F.col


def rows(p: SeriesPlan, n: int, end: int = 0):
    """The last n rows up to the current one."""
    return p.window().rowsBetween(end - n + 1, end)


def lag_change(df: DataFrame, keys, order, col: str) -> DataFrame:
    plan = plan_series(df, keys, order, depth=1)

    def body(d, p):
        prev = F.lag(col).over(p.window())
        return d.withColumns({"prev": prev, "change": C(col) - prev,
                              "change_pct": F.when(prev != 0, (C(col) - prev) / prev * 100)})
    return bounded(df, plan, 1, body)


def running_sum(df: DataFrame, keys, order, col: str, out: str) -> DataFrame:
    return running(df, plan_series(df, keys, order), {out: ("sum", col)})


def rolling_mean_std(df: DataFrame, keys, order, col: str, n: int) -> DataFrame:
    """Mean and sample deviation over n rows, NULL until n rows are there."""
    plan = plan_series(df, keys, order, depth=n)

    def body(d, p):
        w = rows(p, n)
        full = F.count(col).over(w) >= n
        return d.withColumns({"rolling_mean": F.when(full, F.avg(col).over(w)),
                              "rolling_std": F.when(full, F.stddev_samp(col).over(w))})
    return bounded(df, plan, n, body)


def z_in(x: Column, w) -> Column:
    """z-score of the current value in its frame with the population deviation (0 without spread)."""
    sd = F.stddev_pop(x).over(w)
    return F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise((x - F.avg(x).over(w)) / sd)


def velocity(name: str, p: SeriesPlan, periods: int) -> Column:
    """(x_t - x_{t-periods+1}) / periods; 0 while the buffer is shorter."""
    past = F.lag(name, periods - 1).over(p.window())
    return F.when(past.isNull(), 0.0).otherwise((C(name) - past) / periods)


def pct_rank_in(name: str, w) -> Column:
    """Share (0-100) of the frame strictly below the current value."""
    arr = F.collect_list(name).over(w)
    here = C(name)
    return F.size(F.filter(arr, lambda v: v < here)) / F.size(arr) * 100


def buffer_stats(df: DataFrame, keys, order, col: str, n: int = 100, periods: int = 5) -> DataFrame:
    plan = plan_series(df, keys, order, depth=n)

    def body(d, p):
        w = rows(p, n)
        return d.withColumns({
            "mean": F.avg(col).over(w), "std": F.coalesce(F.stddev_pop(col).over(w), F.lit(0.0)),
            "zscore": z_in(C(col), w), "velocity": velocity(col, p, periods), "percentile": pct_rank_in(col, w)})
    return bounded(df, plan, n, body)


def ewma_depth(spans, digits: int = 16) -> int:
    """Rows after which an earlier value weighs less than 10^-digits."""
    return max(math.ceil(digits * math.log(10) / -math.log1p(-2 / (s + 1))) for s in spans)


def ewma(df: DataFrame, keys, order, cols: dict[str, tuple[str, int]], digits: int = 16, plan: SeriesPlan | None = None) -> DataFrame:
    """Exponential averages ``{out: (column, span)}`` seeded with the first value of the series.

    Each group of rows is handled by Arrow batches. A hot series is cut, and every piece starts from
    as many earlier rows as still weigh more than 10^-digits.
    """
    alpha = {o: 2 / (span + 1) for o, (_, span) in cols.items()}
    depth = ewma_depth([span for _, span in cols.values()], digits)
    plan = plan or plan_series(df, keys, order, depth=depth)

    def body(d, p):
        schema = T.StructType([*d.schema.fields, *[T.StructField(o, T.DoubleType()) for o in cols]])

        def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(list(order))
            for o, (c, _) in cols.items():
                pdf[o] = pdf[c].ewm(alpha=alpha[o], adjust=False).mean()
            return pdf
        return d.groupBy(*p.parts).applyInPandas(smooth, schema)
    return bounded(df, plan, depth, body)


def _over_time(df: DataFrame, keys, ts: str, tie: str, values: dict[str, Column], longest: float, frame, out: list[str]) -> DataFrame:
    """Add columns computed from each row's time window by ``frame(position, {name: (values, known)})`` -> {out: (values, known)}.

    Rows are dealt to fixed stretches of time as long as the longest window, and a stretch also sees the one before it: no pass
    over the data to count rows, a hot series is cut like any other, and a task holds two windows of one key. What only looks
    on carries no payload.
    """
    width = int(longest * 1_000_000)
    cell = F.floor(position(df, ts) / F.lit(width)).cast("long")
    kept = [c for c in df.columns if c not in (*keys, tie)]
    d = df.select(*keys, tie, position(df, ts).alias("_pos"), F.explode(F.array(cell, cell + 1)).alias("_cell"), cell.alias("_home"),
                  *[v.cast("double").alias(f"_x_{n}") for n, v in values.items()], F.struct(*kept).alias("_row"))
    d = d.withColumn("_row", F.when(C("_cell") == C("_home"), C("_row")))
    schema = T.StructType([*[df.schema[c] for c in (*keys, tie)], T.StructField("_row", d.schema["_row"].dataType), *[T.StructField(o, T.DoubleType()) for o in out]])

    names = list(values)

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by([("_pos", "ascending"), (tie, "ascending")]).combine_chunks()
        arrays = {n: (g[f"_x_{n}"].fill_null(0.0).to_numpy(), g[f"_x_{n}"].is_valid().to_numpy()) for n in names}
        got = frame(g["_pos"].to_numpy(), arrays)
        cols = [g[c] for c in (*keys, tie, "_row")] + [pa.array(x, pa.float64(), mask=~known) for x, known in (got[o] for o in out)]
        return pa.table(cols, [*keys, tie, "_row", *out]).filter(pc.equal(g["_cell"], g["_home"]))
    done = d.groupBy(*keys, "_cell").applyInArrow(run, schema)
    return done.select(*keys, tie, *[C("_row")[c].alias(c) for c in kept], *out)


def _fold_frames(length: np.ndarray, last: np.ndarray, parts: tuple, empty: tuple, add) -> tuple:
    """Fold ``length`` rows up to row ``last`` for all rows at once, out of folds over 1, 2, 4, ... rows: nothing outside a frame
    ever enters it, so there is nothing to take off again."""
    total, at, size = tuple(np.full(len(length), e) for e in empty), last.copy(), 1
    while len(length) and size <= int(length.max()):
        use = np.flatnonzero(length & size)
        joined = add(tuple(x[at[use]] for x in parts), tuple(t[use] for t in total))
        for t, j in zip(total, joined):
            t[use] = j
        at[use] -= size
        longer = tuple(x.copy() for x in parts)
        for x, j in zip(longer, add(tuple(x[:-size] for x in parts), tuple(x[size:] for x in parts))):
            x[size:] = j
        parts, size = longer, size * 2
    return total


def time_sums(df: DataFrame, keys, ts: str, tie: str, sums: dict[str, Column | str], windows: dict[str, float]) -> DataFrame:
    """Sums over the last ``seconds`` of time at every row, equal times in the order of ``tie``: columns ``{out}_{window}``.

    An infinite or huge value touches only the windows that hold it. NULL values count as 0.
    """
    values = {o: (C(c) if isinstance(c, str) else c) for o, c in sums.items()}

    def frame(pos, arrays):
        here, out = np.arange(len(pos)), {}
        for w, seconds in windows.items():
            length = here - np.searchsorted(pos, pos - int(seconds * 1_000_000)) + 1
            for n, (x, _) in arrays.items():
                with np.errstate(invalid="ignore", over="ignore"):
                    out[f"{n}_{w}"] = _fold_frames(length, here, (x,), (0.0,), lambda a, b: (a[0] + b[0],))[0], np.ones(len(pos), bool)
        return out
    return _over_time(df, keys, ts, tie, values, max(windows.values()), frame, [f"{o}_{w}" for w in windows for o in sums])


def _merge_moments(a, b):
    """(n, mean, sum of squared deviations) of two lots of rows together."""
    n = a[0] + b[0]
    d, share = b[1] - a[1], np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    return n, np.where(a[0] > 0, a[1] + d * share, b[1]), a[2] + b[2] + np.where((a[0] > 0) & (b[0] > 0), d * d * a[0] * share, 0.0)


def time_moments(df: DataFrame, keys, ts: str, tie: str, col: str, seconds: float) -> DataFrame:
    """``samples``, ``mean`` and ``std`` (sample) of the values in the last ``seconds`` before each row, itself excluded."""
    def frame(pos, arrays):
        x, known = arrays["x"]
        here = np.arange(len(pos))
        length = here - np.searchsorted(pos, pos - int(seconds * 1_000_000))
        one = known.astype(float)
        with np.errstate(invalid="ignore", over="ignore"):
            n, mean, square = _fold_frames(length, np.maximum(here - 1, 0), (one, x, np.zeros(len(x))), (0.0, 0.0, 0.0), _merge_moments)
            std = np.sqrt(square / np.maximum(n - 1, 1))
        return {"samples": (n, n >= 0), "mean": (mean, n >= 1), "std": (std, n >= 2)}
    return _over_time(df, keys, ts, tie, {"x": C(col)}, seconds, frame, ["samples", "mean", "std"])


def latest_per(df: DataFrame, keys, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Newest row per key as an aggregate, so a hot key costs one row per task; of rows at the same time the one with the largest ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie) if tie else C(ts)).alias("_r"))
            .select(*keys, *[C("_r")[c].alias(c) for c in rest]))


def detect_gaps(df: DataFrame, keys, ts: str = "ts", expected_s: float = 60) -> DataFrame:
    """Steps longer than twice the expected interval."""
    slim = df.select(*keys, ts)
    plan = plan_series(slim, keys, [ts], depth=1)
    got = bounded(slim, plan, 1, lambda d, p: d.withColumn("gap_start", F.lag(ts).over(p.window())))
    secs = F.expr(f"timestampdiff(MICROSECOND, gap_start, {ts})") / 1e6
    return (got.withColumn("duration_seconds", secs).where(C("duration_seconds") > 2 * expected_s)
            .select(*keys, "gap_start", C(ts).alias("gap_end"), "duration_seconds"))


def cascades(liq: DataFrame, keys, ts: str = "ts", minutes: float = 5, least: int = 3, value: str = "value_usd",
             side: str = "side", price: str = "price") -> DataFrame:
    """Clusters of liquidations at most ``minutes`` apart, with at least ``least`` events."""
    gap = lambda prev: F.timestamp_diff("MICROSECOND", prev(ts), C(ts)) > int(minutes * 60_000_000)
    runs = islands(liq, keys, [ts], gap)
    dur = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6
    out = runs.groupBy(*keys, "island").agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), dur.alias("duration_seconds"),
        F.count(F.lit(1)).alias("liquidation_count"), F.sum(value).alias("total_value"),
        F.sum(F.when(C(side) == "long", C(value)).otherwise(0.0)).alias("long_value"),
        F.sum(F.when(C(side) == "short", C(value)).otherwise(0.0)).alias("short_value"),
        F.min_by(price, ts).alias("price_start"), F.max_by(price, ts).alias("price_end"),
        F.min(price).alias("price_low"), F.max(price).alias("price_high")).where(C("liquidation_count") >= least)
    return out.withColumns({
        "dominant_side": F.when(C("long_value") > C("short_value"), "LONG").otherwise("SHORT"),
        "intensity": C("total_value") / F.greatest("duration_seconds", F.lit(1.0))}).drop("island")


def streak_stats(trades: DataFrame, keys, order, side: str = "side", n: int = 20) -> DataFrame:
    """Mean run length of one side among the last n trades and the flow toxicity min(1, mean / 5)."""
    plan = plan_series(trades, keys, order, depth=n + 1)

    def body(d, p):
        flipped = d.withColumn("_flip", F.when(F.lag(side).over(p.window()) != C(side), 1).otherwise(0))
        w, full = rows(p, n - 1), rows(p, n)
        avg = F.when(F.count(side).over(full) >= n, n / (F.sum("_flip").over(w) + 1))
        return flipped.withColumns({"avg_streak": avg,
                                    "flow_toxicity": F.coalesce(F.least(F.lit(1.0), avg / 5), F.lit(0.0))}).drop("_flip")
    return bounded(trades, plan, n + 1, body)


def runs(df: DataFrame, keys, order, label: str) -> DataFrame:
    """Maximal runs of an equal label: number of rows, first and last position."""
    changed = lambda prev: ~prev(label).eqNullSafe(C(label)) & prev(order[0]).isNotNull()
    return (islands(df, keys, order, changed).groupBy(*keys, "island", label)
            .agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end")))


def regime_runs(df: DataFrame, keys, order, label: str) -> DataFrame:
    """Per label: share of rows, number of runs and mean run length."""
    per = runs(df, keys, order, label).groupBy(*keys, label).agg(
        F.sum("length").alias("rows"), F.count(F.lit(1)).alias("run_count"), F.avg("length").alias("avg_duration"))
    total = Window.partitionBy(*keys)
    return per.withColumn("distribution_pct", C("rows") / F.sum("rows").over(total) * 100)


def transitions(df: DataFrame, keys, order, label: str) -> DataFrame:
    """How often each label gave way to another."""
    plan = plan_series(df, keys, order, depth=1)
    got = bounded(df, plan, 1, lambda d, p: d.withColumn("from_label", F.lag(label).over(p.window())))
    return (got.where(C("from_label").isNotNull() & (C("from_label") != C(label)))
            .groupBy(*keys, "from_label", C(label).alias("to_label")).agg(F.count(F.lit(1)).alias("n")))


def arb_windows(spreads: DataFrame, keys, order, spread: str = "max_spread", threshold: float = 0.05) -> DataFrame:
    """Finished runs with a spread above the threshold."""
    flagged = spreads.withColumn("_on", C(spread) > threshold)
    last = islands(flagged, keys, order, lambda prev: prev("_on") != C("_on"))
    out = last.groupBy(*keys, "island", "_on").agg(
        F.count(F.lit(1)).alias("duration_samples"), F.avg(spread).alias("avg_spread_pct"),
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))
    final = last.groupBy(*keys).agg(F.max("island").alias("_last"))
    return out.join(final, list(keys)).where(C("_on") & (C("island") < C("_last"))).drop("island", "_on", "_last")


def final_pct_rank(df: DataFrame, keys, ts: str, col: str) -> DataFrame:
    """Percentile rank (strictly below) of the newest value in the whole history of its key."""
    newest = df.groupBy(*keys).agg(F.max_by(col, ts).alias("current"))
    return (attach(df, newest, keys).groupBy(*keys)
            .agg(F.max("current").alias("current"),
                 (F.count(F.when(C(col) < C("current"), 1)) / F.count(col) * 100).alias("pct_rank")))


def expanding_pct_rank(df: DataFrame, keys, order, col: str, out: str = "pct_rank") -> DataFrame:
    """Percentile rank (strictly below) of every value in the history of its key up to and including it; null values have none."""
    from tickloom.operators.dominance import earlier_below
    counted = running(earlier_below(df, keys, order, col, col, "_below"), plan_series(df, keys, order), {"_seen": ("count", col)})
    return counted.withColumn(out, F.when(C(col).isNotNull(), C("_below") / C("_seen") * 100)).drop("_below", "_seen")


MINUTES_PER_YEAR = 365 * 24 * 60


def rolling_vol(p_df: DataFrame, keys, order, price: str, n: int, out: str = "volatility",
                annualize: bool = True) -> DataFrame:
    """Deviation of the last n returns, annualized for one-minute data; NULL before n returns."""
    plan = plan_series(p_df, keys, order, depth=n + 1)
    scale = math.sqrt(MINUTES_PER_YEAR) if annualize else 1.0

    def body(d, p):
        prev = F.lag(price).over(p.window())
        w = rows(p, n)
        return (d.withColumn("_ret", F.when(prev != 0, (C(price) - prev) / prev))
                .withColumn(out, F.when(F.count("_ret").over(w) >= n, F.stddev_samp("_ret").over(w) * scale))
                .drop("_ret"))
    return bounded(p_df, plan, n + 1, body)


def rsi(candles: DataFrame, keys, order, close: str = "close", n: int = 14) -> DataFrame:
    """Relative strength from the simple means of gains and losses over the newest n + 1 candles."""
    plan = plan_series(candles, keys, order, depth=n + 2)

    def body(d, p):
        w = rows(p, n + 1)
        ch = d.withColumn("_ch", C(close) - F.lag(close).over(p.window()))
        gain = F.avg(F.when(C("_ch") > 0, C("_ch")).when(C("_ch").isNotNull(), 0.0)).over(w)
        loss = F.avg(F.when(C("_ch") < 0, -C("_ch")).when(C("_ch").isNotNull(), 0.0)).over(w)
        return ch.withColumn("rsi", F.when(loss > 0, 100 - 100 / (1 + gain / loss))).drop("_ch")
    return bounded(candles, plan, n + 2, body)


def rank_exchanges(scores: DataFrame, by="symbol", score: str = "score", exchange: str = "exchange") -> DataFrame:
    """Rank of venues (a handful per symbol) by score."""
    w = Window.partitionBy(by).orderBy(C(score).desc(), exchange)
    return scores.withColumn("rank", F.row_number().over(w))


# ---- sort, limit, top-k ----

def latest_n(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    return df.orderBy(C(ts).desc()).limit(n)


def latest_n_per(df: DataFrame, keys, n: int, order) -> DataFrame:
    """The limit is applied inside every task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*[C(c).desc() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(C("rn") <= n)


def top_arbitrage(opps: DataFrame, least: float = 0.1, n: int = 20) -> DataFrame:
    return opps.where(C("spread_pct") >= least).orderBy(C("spread_pct").desc(), *[c for c in opps.columns if c != "spread_pct"]).limit(n)


def top_movers(ticker: DataFrame, n: int = 10, symbol: str = "symbol", change: str = "change_pct",
               volume: str = "volume") -> DataFrame:
    """Gainers, losers and most traded, n each."""
    def top(name, *order):
        return ticker.orderBy(*order, symbol).limit(n).withColumn("list", F.lit(name))
    return (top("gainers", C(change).desc()).unionByName(top("losers", C(change).asc()))
            .unionByName(top("volume", C(volume).desc())))


def top_walls(levels: Column, n: int = 3) -> Column:
    """The n largest levels by size, largest first."""
    return F.slice(F.array_sort(levels, lambda a, b: F.when(a["qty"] > b["qty"], -1).when(a["qty"] < b["qty"], 1)
                                .otherwise(0)), 1, n)


def large_trades(trades: DataFrame, keys, value: str = "value", percentile: float | None = 95,
                 times_mean: float | None = None) -> DataFrame:
    """Trades at or above the p-th ordered value, or at ``times_mean`` times the mean."""
    if times_mean is not None:
        cut = trades.groupBy(*keys).agg((F.avg(value) * times_mean).alias("threshold"))
    else:
        cut = order_value(trades, keys, value, "threshold", lambda n: F.floor(n * percentile / 100))
    return attach(trades, cut, keys).where(C(value) >= C("threshold"))


def arbitrage_summary(opps: DataFrame, prices: DataFrame, by="symbol", buy: str = "buy_exchange",
                      sell: str = "sell_exchange", profit: str = "profit_pct", price: str = "price") -> DataFrame:
    """Most frequent route and venues, profit statistics, price range and efficiency grade."""
    def most(col, out):
        n = opps.groupBy(by, col).agg(F.count(F.lit(1)).alias("_n"))
        # ties go to the alphabetically first
        return n.groupBy(by).agg(F.min_by(col, F.struct(-C("_n"), C(col))).alias(out))
    routed = opps.withColumn("_route", F.concat_ws(" → ", buy, sell))
    n = routed.groupBy(by, "_route").agg(F.count(F.lit(1)).alias("_n"))
    route = n.groupBy(by).agg(F.min_by("_route", F.struct(-C("_n"), C("_route"))).alias("top_route"))
    stats = opps.groupBy(by).agg(F.count(F.lit(1)).alias("opportunities"), F.avg(profit).alias("avg_profit_pct"),
                                 F.max(profit).alias("best_profit_pct"))
    span = prices.where(C(price) > 0).groupBy(by).agg(F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    pct = (C("max_price") - C("min_price")) / C("min_price") * 100
    return (span.join(stats, by, "left").join(route, by, "left").join(most(buy, "cheapest_exchange"), by, "left")
            .join(most(sell, "dearest_exchange"), by, "left")
            .withColumns({"spread_pct": pct, "market_status": F.when(pct < 0.01, "HIGHLY_EFFICIENT")
                          .when(pct < 0.05, "EFFICIENT").when(pct < 0.15, "MODERATE_INEFFICIENCY").otherwise("INEFFICIENT")}))
