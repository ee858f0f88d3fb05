"""Grouped summaries of market streams.

Everything here is algebraic (partial aggregation before the shuffle), so a hot key costs one small
row per map task. Quantiles go through ``series.quantiles``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import bucket, safe_corr, safe_div
from tickloom.operators.joins import oi_price_join
from tickloom.operators.series import attach, bounded, bucket_plan, order_value, plan_series, quantiles, running

C = F.col


def sum_if(test: Column, value: Column | str) -> Column:
    return F.sum(F.when(test, C(value) if isinstance(value, str) else value).otherwise(0.0))


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def trade_summary(trades: DataFrame, by, value: str = "quote_value", price: str = "price", side: str = "side") -> DataFrame:
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), sum_if(C(side) == "buy", value).alias("buy_volume"),
        sum_if(C(side) == "sell", value).alias("sell_volume"), F.sum(value).alias("total_volume"),
        F.avg(price).alias("avg_price"), F.max(price).alias("high_price"), F.min(price).alias("low_price"))


def liquidation_summary(liq: DataFrame, by, value: str = "value_usd", side: str = "side", least: float = 0.0) -> DataFrame:
    return liq.where(C(value) >= least).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_count"), sum_if(C(side) == "long", value).alias("long_liquidations"),
        sum_if(C(side) == "short", value).alias("short_liquidations"), F.sum(value).alias("total_value"),
        F.max(value).alias("largest_liquidation"))


def funding_stats(fr: DataFrame, by, rate: str = "funding_rate") -> DataFrame:
    return fr.groupBy(*by).agg(
        F.avg(rate).alias("avg_rate"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"),
        F.stddev(rate).alias("volatility"), F.sum(rate).alias("cumulative"), F.count(rate).alias("samples"),
        (F.avg(rate) * 3 * 365 * 100).alias("avg_annualized"))


def in_time(ts: str, tie: str | None) -> Column:
    """What rows are ordered by: the time and, if given, a column that tells rows of one time apart."""
    return F.struct(ts, tie) if tie else C(ts)


def price_window_stats(p: DataFrame, by, price: str = "mid_price", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """``tie`` decides which of several rows at the first or last time opens or closes; without it any of them may."""
    when = in_time(ts, tie)
    out = p.groupBy(*by).agg(
        F.min_by(price, when).alias("open"), F.max_by(price, when).alias("close"), F.min(price).alias("low"),
        F.max(price).alias("high"), F.avg(price).alias("average"), F.stddev(price).alias("volatility"),
        F.count(F.lit(1)).alias("ticks"))
    return out.withColumns({"change": C("close") - C("open"),
                            "change_pct": safe_div(C("close") - C("open"), C("open")) * 100})


def quartiles(df: DataFrame, by, col: str) -> DataFrame:
    return quantiles(df, by, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


# Comparison horizons in minutes.
HORIZONS = {"5m": 5, "15m": 15, "1h": 60, "4h": 240, "24h": 1440}


def compare_vs_history(p: DataFrame, by, price: str = "mid_price", ts: str = "ts",
                       horizons: dict[str, int] | None = None, as_of=None) -> DataFrame:
    """Latest price against the mean and deviation of each look-back: one scan, then one row per horizon."""
    horizons = horizons or HORIZONS
    now = F.lit(as_of) if as_of is not None else p.select(F.max(ts)).scalar()
    seen = p.where(C(ts) >= now - F.expr(f"INTERVAL {max(horizons.values())} MINUTES")).withColumn("_now", now)
    aggs = [F.max_by(price, ts).alias("live_price")]
    for name, minutes in horizons.items():
        x = F.when(C(ts) >= C("_now") - F.expr(f"INTERVAL {minutes} MINUTES"), C(price))
        aggs += [F.avg(x).alias(f"avg_{name}"), F.stddev(x).alias(f"sd_{name}"), F.min(x).alias(f"min_{name}"),
                 F.max(x).alias(f"max_{name}")]
    wide = seen.groupBy(*by).agg(*aggs)
    parts = ", ".join(f"'{n}', {m}, avg_{n}, sd_{n}, min_{n}, max_{n}" for n, m in horizons.items())
    long = wide.selectExpr(*by, "live_price", f"stack({len(horizons)}, {parts}) AS (window, minutes, avg_price, stddev, "
                                              "min, max)").where("avg_price IS NOT NULL")
    z = safe_div(C("live_price") - C("avg_price"), C("stddev"))
    return long.withColumns({
        "deviation": C("live_price") - C("avg_price"),
        "deviation_pct": safe_div(C("live_price") - C("avg_price"), C("avg_price")) * 100, "z_score": z,
        "signal": F.when(z > 2, "SIGNIFICANTLY_HIGH").when(z > 1, "MODERATELY_HIGH")
                   .when(z < -2, "SIGNIFICANTLY_LOW").when(z < -1, "MODERATELY_LOW").otherwise("NORMAL")})


def ohlc(p: DataFrame, every: str, by=("exchange",), price: str = "mid_price", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """``tie`` decides which of several rows at the first or last time of a bar opens or closes it."""
    when = in_time(ts, tie)
    return p.groupBy(*by, bucket(ts, every).alias("bucket")).agg(
        F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, when).alias("close"), F.count(F.lit(1)).alias("ticks"))


def trade_candles(trades: DataFrame, every: str, by=("symbol", "exchange"), ts: str = "ts", price: str = "price",
                  qty: str = "quantity", side: str = "side", order: Column | str | None = None) -> DataFrame:
    order = order if order is not None else ts
    value, buy = C(price) * C(qty), C(side) == "buy"
    out = trades.groupBy(*by, bucket(ts, every).alias("open_time")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(qty).alias("volume"), F.sum(value).alias("quote_volume"),
        F.count(F.lit(1)).alias("trade_count"), sum_if(buy, qty).alias("taker_buy_volume"),
        sum_if(buy, value).alias("taker_buy_quote"))
    return out.withColumn("taker_buy_pct", F.when((C("volume") > 0) & (C("taker_buy_volume") != 0),
                                                  C("taker_buy_volume") / C("volume") * 100))


# Candle steps in minutes, smallest first; a candle may only be made from a smaller one.
STEP_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}


def check_conversion(src: str, dst: str) -> int:
    a, b = STEP_MINUTES.get(src), STEP_MINUTES.get(dst)
    if a is None or b is None or b <= a or b % a:
        raise ValueError(f"cannot aggregate {src} candles to {dst}")
    return b


def reaggregate(candles: DataFrame, src: str, dst: str, by=("symbol",), ts: str = "open_time") -> DataFrame:
    minutes = check_conversion(src, dst)
    return _merge_candles(candles, f"{minutes} minutes", by, ts)


def _merge_candles(candles: DataFrame, every: str, by, ts: str) -> DataFrame:
    sums = [c for c in ("volume", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote")
            if c in candles.columns]
    return (candles.groupBy(*by, bucket(ts, every).alias("_b"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", ts).alias("close"), *[F.sum(c).alias(c) for c in sums])
            .withColumnRenamed("_b", ts))


def volume_profile(trades: DataFrame, digits: int = -2, n: int = 20, price: str = "price",
                   value: str = "quote_value", side: str = "side") -> DataFrame:
    """Top price levels by traded value."""
    return (trades.groupBy(F.round(price, digits).alias("price_level"))
            .agg(F.sum(value).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
                 sum_if(C(side) == "buy", value).alias("buy_volume"),
                 sum_if(C(side) == "sell", value).alias("sell_volume"))
            .orderBy(C("volume").desc(), "price_level").limit(n))


def volatility_buckets(p: DataFrame, every: str, by=("exchange",), price: str = "mid_price", ts: str = "ts",
                       spread: str = "spread_bps") -> DataFrame:
    return p.groupBy(*by, bucket(ts, every).alias("bucket")).agg(
        F.stddev(price).alias("price_stddev"), (F.max(price) - F.min(price)).alias("price_range"),
        F.avg(spread).alias("avg_spread_bps"), F.count(F.lit(1)).alias("samples"))


def funding_cumulative(fr: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id"),
                       rate: str = "funding_rate") -> DataFrame:
    return running(fr, plan_series(fr, by, order), {"cumulative_rate": ("sum", rate)})


def liquidation_buckets(liq: DataFrame, every: str = "5 minutes", by=("exchange",), ts: str = "ts",
                        value: str = "value_usd", least_count: int = 3, n: int | None = None) -> DataFrame:
    out = liq.groupBy(*by, bucket(ts, every).alias("bucket")).agg(
        F.count(F.lit(1)).alias("liq_count"), F.sum(value).alias("total_value"),
        sum_if(C("side") == "long", value).alias("long_value"),
        sum_if(C("side") == "short", value).alias("short_value"), F.avg("price").alias("avg_price")
    ).where(C("liq_count") >= least_count)
    return out if n is None else out.orderBy(C("total_value").desc(), "bucket").limit(n)


def liquidation_cascades(liq: DataFrame, ts: str = "ts", value: str = "value_usd", least_count: int = 3,
                         least_value: float = 50_000) -> DataFrame:
    return (liq.groupBy(F.date_trunc("minute", ts).cast(liq.schema[ts].dataType).alias("minute"), "symbol", "side")
            .agg(F.count(F.lit(1)).alias("liq_count"), F.sum(value).alias("total_value"), F.avg("price").alias("avg_price"))
            .where((C("liq_count") > least_count) | (C("total_value") > least_value)))


def liquidation_heatmap(liq: DataFrame, by=("symbol",), n: int = 20, price: str = "price", value: str = "value_usd",
                        side: str = "side") -> DataFrame:
    """n equal price zones between the lowest and highest liquidation of each key, empty zones included."""
    by = list(by)
    ends = liq.groupBy(*by).agg(F.min(price).alias("_lo"), F.max(price).alias("_hi")).withColumn(
        "_step", F.when(C("_hi") > C("_lo"), (C("_hi") - C("_lo")) / n).otherwise(1.0))
    zone = F.least(F.floor((C(price) - C("_lo")) / C("_step")), F.lit(n - 1)).cast("int")
    is_long = C(side) == "long"
    hit = (attach(liq, ends, by).groupBy(*by, zone.alias("zone"))
           .agg(sum_if(is_long, value).alias("long_liquidations"), sum_if(~is_long, value).alias("short_liquidations"),
                F.sum(value).alias("total_value"), F.count(F.lit(1)).alias("count")))
    grid = ends.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = grid.join(hit, [*by, "zone"], "left").na.fill(0)
    top = hit.groupBy(*by).agg(F.max_by("zone", F.struct("total_value", -C("zone"))).alias("_top"))
    return (out.join(top, by).select(
        *by, "zone", (C("_lo") + C("zone") * C("_step")).alias("price_start"),
        (C("_lo") + (C("zone") + 1) * C("_step")).alias("price_end"), "long_liquidations", "short_liquidations",
        "total_value", "count", (C("zone") == C("_top")).alias("hottest")))


def liquidation_pressure(liq: DataFrame, latest: DataFrame, by=("symbol",), price: str = "price",
                         value: str = "value_usd", side: str = "side", n: int = 10) -> DataFrame:
    """Top price zones one percent of the current price wide, with dominance and risk of the key."""
    by = list(by)
    width = C("current_price") * 0.01
    low = F.lower(side)
    is_long, is_short = low.isin("buy", "long"), low.isin("sell", "short")
    zones = (attach(liq, latest.select(*by, "current_price"), by)
             .groupBy(*by, "current_price", F.bround(C(price) / width).alias("_z"))
             .agg(sum_if(is_long, value).alias("long_value"), sum_if(~is_long, value).alias("short_value"),
                  sum_if(is_short, value).alias("_s"), F.count(F.lit(1)).alias("count")))
    zones = zones.withColumns({"price": C("_z") * width, "zone_value": C("long_value") + C("short_value")})
    total = zones.groupBy(*by).agg(F.sum("long_value").alias("long_total"), F.sum("_s").alias("short_total"),
                                   F.sum("count").alias("total_liquidations"))
    from pyspark.sql import Window
    ranked = zones.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(C("zone_value").desc(), C("_z")))).where(C("rank") <= n)
    both = C("long_total") + C("short_total")
    return ranked.join(total, by).select(
        *by, "rank", "price", ((C("price") - C("current_price")) / C("current_price") * 100).alias("pct_from_current"),
        "long_value", "short_value", "zone_value", "count", "total_liquidations", both.alias("total_value"),
        F.when(C("long_total") / both > 0.7, "LONG_LIQUIDATION_DOMINANT")
         .when(C("short_total") / both > 0.7, "SHORT_LIQUIDATION_DOMINANT").otherwise("BALANCED").alias("dominance"),
        F.when(both > 10_000_000, "EXTREME").when(both > 1_000_000, "HIGH").when(both > 100_000, "MODERATE")
         .otherwise("LOW").alias("cascade_risk"), (both * 2.5).alias("estimated_remaining_at_risk"))


def ofi(books: DataFrame, by=("symbol",), order=("ts",), bid: str = "total_bid_depth",
        ask: str = "total_ask_depth") -> DataFrame:
    """Order flow imbalance: change of bid depth minus change of ask depth, raw and per unit of depth."""
    plan = plan_series(books, by, order, depth=1)

    def change(d, p):
        w = p.window()
        return d.withColumns({"_db": C(bid) - F.coalesce(F.lag(bid).over(w), C(bid)),
                              "_da": C(ask) - F.coalesce(F.lag(ask).over(w), C(ask))})
    raw = F.sum("_db") - F.sum("_da")
    depth = F.sum(bid) + F.sum(ask)
    return bounded(books, plan, 1, change).groupBy(*by).agg(
        raw.alias("ofi"), F.when(depth != 0, raw / depth).alias("ofi_normalized"))


def buy_sell_ratio(trades: DataFrame, by=("exchange",), value: str = "quote_value", side: str = "side") -> DataFrame:
    buy, sell, total = sum_if(C(side) == "buy", value), sum_if(C(side) == "sell", value), F.sum(value)
    return trades.groupBy(*by).agg(buy.alias("buy_volume"), sell.alias("sell_volume"),
                                   F.when(total != 0, buy / total).alias("buy_ratio"), (buy - sell).alias("net_flow"))


def flow_buckets(trades: DataFrame, minutes: int = 15, by=("exchange",), ts: str = "ts", value: str = "quote_value",
                 price: str = "price", side: str = "side") -> DataFrame:
    out = trades.groupBy(*by, bucket(ts, f"{minutes} minutes").alias("bucket")).agg(
        sum_if(C(side) == "buy", value).alias("buy_volume"), sum_if(C(side) == "sell", value).alias("sell_volume"),
        F.count(F.lit(1)).alias("trade_count"), F.avg(price).alias("avg_price"))
    return out.withColumns({
        "net_flow": C("buy_volume") - C("sell_volume"),
        "ratio": F.when(C("sell_volume") > 0, F.least(C("buy_volume") / C("sell_volume"), F.lit(100.0))).otherwise(100.0)})


def vwap(trades: DataFrame, by, price: str = "price", qty: str = "quantity") -> DataFrame:
    return trades.groupBy(*by).agg(safe_div(F.sum(C(price) * C(qty)), F.sum(qty)).alias("vwap"))


def oi_price_divergence(oi: DataFrame, prices: DataFrame, by=("symbol", "exchange")) -> DataFrame:
    """Hourly open-interest and price change with the quadrant they fall in."""
    minute = oi_price_join(oi, prices, by)
    hour = (minute.groupBy(*by, F.date_trunc("hour", "minute").cast(minute.schema["minute"].dataType).alias("hour"))
            .agg((F.sum(C("avg_oi") * C("pairs")) / F.sum("pairs")).alias("avg_oi"),
                 (F.sum(C("avg_price") * C("pairs")) / F.sum("pairs")).alias("avg_price")))
    plan = bucket_plan(hour, by, ["hour"], "1 hour", depth=1)

    def change(d, p):
        def pct(c):
            prev = F.lag(c).over(p.window())
            return F.when(prev != 0, (C(c) - prev) / prev * 100)
        return d.withColumns({"oi_change_pct": pct("avg_oi"), "price_change_pct": pct("avg_price")})
    o, p = C("oi_change_pct"), C("price_change_pct")
    return (bounded(hour, plan, 1, change).where((F.abs(o) > 1) | (F.abs(p) > 0.3))
            .withColumn("signal", F.when((o > 2) & (p > 0.5), "NEW_LONGS").when((o > 2) & (p < -0.5), "NEW_SHORTS")
                        .when((o < -2) & (p > 0.5), "SHORT_SQUEEZE").when((o < -2) & (p < -0.5), "LONG_LIQUIDATION")
                        .otherwise("NORMAL")))


def table_stats(streams: dict[str, DataFrame], by=("symbol", "exchange"), ts: str = "ts") -> DataFrame:
    """Row count, first and last time and status per stream and key."""
    from functools import reduce
    parts = [df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_record"),
                                 F.max(ts).alias("last_record"))
             .withColumns({"stream": F.lit(name), "status": F.when(C("row_count") > 0, "healthy").otherwise("empty")})
             for name, df in streams.items()]
    return reduce(DataFrame.unionByName, parts)


def source_summary(dim: DataFrame, market: str, symbol: str, exchange: str, flags: list[str]) -> DataFrame:
    return dim.groupBy(market).agg(
        F.countDistinct(symbol).alias("symbols"), F.countDistinct(exchange).alias("exchanges"),
        F.count(F.lit(1)).alias("total_sources"), *[F.sum(C(f).cast("long")).alias(f"{f}_feeds") for f in flags])


def coverage_matrix(df: DataFrame, coin: str, exchange: str, exchanges: list[str]) -> DataFrame:
    """Rows per coin and venue; the venue list is fixed so the pivot needs no extra pass."""
    return df.groupBy(coin).pivot(exchange, exchanges).count().na.fill(0)


def profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per numeric column: counts of bad values and basic statistics, in a single pass."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        x = C(c).cast("double")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.avg(x).alias(f"{c}__avg"),
                 F.stddev(x).alias(f"{c}__sd"), distinct(c).alias(f"{c}__distinct"),
                 count_if(x.isNull()).alias(f"{c}__null"), count_if(x == 0).alias(f"{c}__zero"),
                 count_if(odd).alias(f"{c}__odd"), count_if(x < 0).alias(f"{c}__neg")]
    wide = df.agg(*aggs)
    cells = ", ".join(
        f"'{c}', _n, {c}__min, {c}__max, {c}__avg, {c}__sd, {c}__distinct, 100.0D * {c}__null / _n, "
        f"100.0D * {c}__zero / _n, {c}__odd, {c}__neg, coalesce({c}__avg > 0 and {c}__max > {c}__avg * 1000, false)"
        for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {cells}) AS (column, row_count, min, max, avg, stddev, distinct_count, "
                           "null_pct, zero_pct, nan_inf_count, negative_count, extreme_outlier)")


def feature_statistics(df: DataFrame, columns: list[str], by=()) -> DataFrame:
    """Statistics per feature in long form, with the distribution remark."""
    cells = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    long = df.selectExpr(*by, f"stack({len(columns)}, {cells}) AS (feature, value)").where("value IS NOT NULL")
    key = [*by, "feature"]
    base = long.groupBy(*key).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("std"),
                                  F.min("value").alias("min"), F.max("value").alias("max"))
    out = base.join(quantiles(long, key, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}), key)
    skew = F.abs(C("mean") - C("median")) > F.abs("mean") * 0.3
    return out.withColumns({
        "high_variability": C("std") > F.abs("mean") * 2,
        "skew": F.when(skew & (C("mean") != 0), F.when(C("mean") > C("median"), "right").otherwise("left")).otherwise("none"),
        "high_outliers": C("max") > C("p75") * 3,
        "low_outliers": (C("p25") < 0) & (C("min") < C("p25") * 3)})


def feature_correlation(df: DataFrame, columns: dict[str, str], least: int = 10) -> DataFrame:
    """Pearson correlation of every column pair (``columns`` maps column to its stream), one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[x for a, b in pairs for x in (
        safe_corr(C(a), C(b)).alias(f"{a}__{b}__c"), count_if(C(a).isNotNull() & C(b).isNotNull()).alias(f"{a}__{b}__n"))])
    cells = ", ".join(f"'{a}', '{columns[a]}', '{b}', '{columns[b]}', {a}__{b}__c, {a}__{b}__n" for a, b in pairs)
    long = wide.selectExpr(f"stack({len(pairs)}, {cells}) AS (feature_a, type_a, feature_b, type_b, value, n)")
    return long.where(C("n") >= least).withColumn("value", F.coalesce("value", F.lit(0.0)))


def top_correlations(corr: DataFrame, n: int = 15) -> DataFrame:
    pos = corr.where("value > 0").orderBy(C("value").desc(), "feature_a", "feature_b").limit(n).withColumn("list", F.lit("positive"))
    neg = corr.where("value < 0").orderBy("value", "feature_a", "feature_b").limit(n).withColumn("list", F.lit("negative"))
    return pos.unionByName(neg)


def cross_stream_correlation(corr: DataFrame) -> DataFrame:
    out = (corr.where("type_a <> type_b")
           .groupBy(F.least("type_a", "type_b").alias("from_stream"), F.greatest("type_a", "type_b").alias("to_stream"))
           .agg(F.avg("value").alias("avg_correlation")))
    a = F.abs("avg_correlation")
    return out.withColumn("significance", F.when(a > 0.5, "high").when(a > 0.3, "moderate").otherwise("low"))


def aggregate_features(df: DataFrame, every: str, columns: list[str], by=("symbol", "exchange"), ts: str = "ts",
                       kinds=("avg", "min", "max", "last")) -> DataFrame:
    fn = {"avg": F.avg, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, ts)}
    return df.groupBy(*by, bucket(ts, every).alias("bucket")).agg(
        *[fn[k](c).alias(f"{c}_{k}") for c in columns for k in kinds], F.count(F.lit(1)).alias("samples"))


def resample(series: DataFrame, every: str, how: str = "mean", by=("series",), ts: str = "ts",
             value: str = "value") -> DataFrame:
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, ts),
          "last": lambda c: F.max_by(c, ts)}[how]
    return (series.groupBy(*by, bucket(ts, every).alias("_b")).agg(fn(value).alias(value))
            .withColumnRenamed("_b", ts))


def options_summary(book: DataFrame, by=("currency",), name: str = "instrument_name", oi: str = "open_interest",
                    volume: str = "volume", index_price: str = "index_price") -> DataFrame:
    call, put = C(name).endswith("-C"), C(name).endswith("-P")
    out = book.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_options"), count_if(call).alias("calls_count"), count_if(put).alias("puts_count"),
        F.sum(oi).alias("total_open_interest"), F.max(index_price).alias("index_price"),
        sum_if(call, oi).alias("calls_open_interest"), sum_if(put, oi).alias("puts_open_interest"),
        F.sum(volume).alias("total_volume"))
    return out.withColumns({"total_open_interest_usd": C("total_open_interest") * C("index_price"),
                            "put_call_ratio": F.when(C("calls_open_interest") > 0,
                                                     C("puts_open_interest") / C("calls_open_interest")).otherwise(0.0)})


def options_chain(instruments: DataFrame, name: str = "instrument_name", expiry: str | None = None) -> DataFrame:
    """Call and put instrument of every expiry and strike."""
    p = F.split(name, "-")
    out = instruments.withColumns({"expiry": F.get(p, 1), "strike": F.get(p, 2).cast("double"),
                                   "kind": F.when(C(name).endswith("-C"), "call").otherwise("put")})
    if expiry:
        out = out.where(C("expiry") == expiry)
    return out.groupBy("expiry", "strike").pivot("kind", ["call", "put"]).agg(F.max(name))


def exchange_share(df: DataFrame, value: str, by="symbol", exchange: str = "exchange") -> DataFrame:
    """Share of each venue in the symbol's total (window over venue totals, a few rows per symbol)."""
    from pyspark.sql import Window
    per = df.groupBy(by, exchange).agg(F.sum(value).alias("total"))
    return per.withColumn("share", safe_div(C("total"), F.sum("total").over(Window.partitionBy(by))))


def volume_analysis(trades: DataFrame, by=("symbol",), price: str = "price", qty: str = "quantity",
                    side: str = "side") -> DataFrame:
    """Sizes, sides and the top tenth of trades by size."""
    by = list(by)
    sized = trades.withColumn("_q", F.abs(qty))
    cut = order_value(sized, by, "_q", "threshold", lambda n: n - 1 - F.floor(n / 10))
    buy, sell = F.lower(side) == "buy", F.lower(side) == "sell"
    out = attach(sized, cut, by).groupBy(*by).agg(
        F.sum("_q").alias("total_volume"), F.sum(C("_q") * C(price)).alias("total_value"),
        F.count(F.lit(1)).alias("total_trades"), sum_if(buy, "_q").alias("buy_volume"),
        sum_if(sell, "_q").alias("sell_volume"), count_if(buy).alias("buy_count"), count_if(sell).alias("sell_count"),
        count_if(C("_q") >= C("threshold")).alias("large_trade_count"),
        sum_if(C("_q") >= C("threshold"), "_q").alias("large_trade_volume"))
    return out.withColumns({
        "buy_sell_ratio": F.when(C("sell_volume") > 0, C("buy_volume") / C("sell_volume")),
        "avg_trade_size": C("total_volume") / C("total_trades"),
        "volume_imbalance": safe_div(C("buy_volume") - C("sell_volume"), C("total_volume")) * 100})


def oi_totals(oi: DataFrame, every: str, by=("symbol",), exchange: str = "exchange", ts: str = "ts",
              value: str = "open_interest") -> DataFrame:
    """Open interest summed over venues: the last value of each venue in each bucket."""
    last = (oi.groupBy(*by, exchange, bucket(ts, every).alias("bucket"))
            .agg(F.max_by(value, ts).alias("_v"), F.max_by("price", ts).alias("_p")))
    return last.groupBy(*by, "bucket").agg(F.sum("_v").alias("total_oi"), F.avg("_p").alias("avg_price"),
                                           F.count(F.lit(1)).alias("venues"))
