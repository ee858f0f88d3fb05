"""Market analytics in layers: order flow, leverage, cross-exchange, regime, alpha, and venue reports.

Layers 1-3 reduce raw streams to one row per (symbol, bucket); regime and alpha are column
expressions over the join of those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import bucket, clip, ieee_div, label_by, qty_sum, safe_div
from tickloom.operators.aggregates import count_if, oi_totals, sum_if
from tickloom.operators.joins import lag_pairs, spread_matrix
from tickloom.operators.series import attach, bounded, bucket_plan, plan_series, running
from tickloom.operators.windows import rows

C = F.col


def prev(df: DataFrame, keys, order, every: str | None = None, **cols: str) -> DataFrame:
    """Add the previous row's value of columns."""
    plan = bucket_plan(df, keys, order, every, depth=1)
    return bounded(df, plan, 1, lambda d, p: d.withColumns({o: F.lag(c).over(p.window()) for o, c in cols.items()}))


# ---- layer 1: order flow ----

def liquidity_imbalance(books: DataFrame, bands=(10, 25, 50), by="symbol", order=("ts",), every: str | None = None) -> DataFrame:
    """Depth within tick bands of the mid, total imbalance, its change and the pressure label."""
    bids, asks = C("bids"), C("asks")
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    cols = {}
    for n in bands:
        low, high = mid * (1 - n * 0.0001), mid * (1 + n * 0.0001)
        b = qty_sum(F.filter("bids", _above(low)))
        a = qty_sum(F.filter("asks", _below(high)))
        cols[f"imbalance_{n}_ticks"] = safe_div(b - a, b + a)
    tb, ta = qty_sum(bids), qty_sum(asks)
    df = books.withColumns({**cols, "bid_depth": tb, "ask_depth": ta, "imbalance_ratio": safe_div(tb - ta, tb + ta)})
    df = prev(df, [by], order, every, _p="imbalance_ratio").withColumn("velocity", C("imbalance_ratio") - C("_p")).drop("_p")
    r = C("imbalance_ratio")
    strong, mild = F.least(F.abs(r) * 100, F.lit(100.0)), F.least(F.abs(r) * 100, F.lit(80.0))
    return df.withColumns({
        "signal": F.when(r > 0.3, "STRONG_BUY_PRESSURE").when(r > 0.15, "BUY_PRESSURE").when(r < -0.3, "STRONG_SELL_PRESSURE")
                   .when(r < -0.15, "SELL_PRESSURE").otherwise("NEUTRAL"),
        "confidence": F.when(F.abs(r) > 0.3, strong).when(F.abs(r) > 0.15, mild).otherwise(50.0)})


def _above(limit: Column):
    return lambda x: x["price"] >= limit


def _below(limit: Column):
    return lambda x: x["price"] <= limit


def liquidity_vacuum(books: DataFrame, typical_depth: float = 1000.0) -> DataFrame:
    """Depth within 10/25/50 bps, gaps between levels, vacuum score and slippage risk of each snapshot."""
    bids, asks = C("bids"), C("asks")
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    bps = (asks[0]["price"] - bids[0]["price"]) / mid * 10000

    def within(n):
        return qty_sum(F.filter("bids", _above(mid - mid * n / 10000))) + qty_sum(F.filter("asks", _below(mid + mid * n / 10000)))

    def gaps(side):
        pairs = F.zip_with(F.slice(side, F.lit(2), F.greatest(F.size(side) - 1, F.lit(0))),
                           F.slice(side, F.lit(1), F.greatest(F.size(side) - 1, F.lit(0))),
                           lambda a, b: F.abs(a["price"] - b["price"]) / mid * 100)
        return F.least(F.size(F.filter(pairs, lambda g: g > 0.1)), F.lit(5))
    df = books.withColumns({"depth_10bps": within(10), "depth_25bps": within(25), "depth_50bps": within(50), "spread_bps": bps,
                            "thin_zones": gaps("bids") + gaps("asks")})
    score = (0.7 * (1 - F.least(C("depth_10bps") / typical_depth, F.lit(1.0))) + 0.3 * F.least(C("spread_bps") / 10, F.lit(1.0))) * 100
    df = df.withColumn("vacuum_score", score)
    v = C("vacuum_score")
    return df.withColumns({"slippage_risk": label_by(v, [(70, "EXTREME"), (50, "HIGH"), (30, "MODERATE")], "LOW"),
                           "breakout_probability": F.when(v > 70, 85).when(v > 50, 65).when(v > 30, 40).otherwise(20)})


def orderbook_persistence(books: DataFrame, by=("symbol",), venue: str = "exchange", ts: str = "ts", tie: str | None = None, n: int = 60, levels: int = 20,
                          per_venue: int = 5, top: int = 10) -> DataFrame:
    """Prices standing in at least half of the last n snapshots of a venue: support and resistance with reliability.

    A venue gives its ``per_venue`` best levels of a side; of all venues' levels the ``top`` best of a side stay. ``overall_score``
    is the mean reliability of what stays for a symbol.
    """
    own = [*by, venue]
    newest = Window.partitionBy(*own).orderBy(C(ts).desc(), *([C(tie).desc()] if tie else []))
    last = books.withColumn("_r", F.row_number().over(newest)).where(C("_r") <= n)
    total = last.groupBy(*own).agg(F.count(F.lit(1)).alias("_total")).where(C("_total") >= 5)
    both = F.concat(*[F.transform(F.slice(s, 1, levels), _tag(k)) for s, k in (("bids", "support"), ("asks", "resistance"))])
    lv = last.select(*own, F.explode(both).alias("l")).groupBy(*own, "l.zone", "l.price").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("l.qty").alias("avg_size"), F.var_pop("l.qty").alias("size_variance"))
    pct = C("_n") / C("_total") * 100
    d = lv.join(total, own).withColumn("persistence_pct", pct).where(C("persistence_pct") >= 50)
    d = d.withColumn("reliability", F.when(C("avg_size") > 0, C("persistence_pct") * (
        1 - F.least(C("size_variance") / C("avg_size"), F.lit(1.0)))).otherwise(0.0))
    mine = F.row_number().over(Window.partitionBy(*own, "zone").orderBy(C("reliability").desc(), "price"))
    d = d.withColumn("_v", mine).where(C("_v") <= per_venue)
    rank = F.row_number().over(Window.partitionBy(*by, "zone").orderBy(C("reliability").desc(), venue, "price"))
    d = d.withColumn("rank", rank).where(C("rank") <= top)
    return d.withColumn("overall_score", F.avg("reliability").over(Window.partitionBy(*by))).drop("_n", "_total", "_v")


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("zone"), F.round(x["price"], 8).alias("price"), x["qty"].alias("qty"))


def trade_aggression(trades: DataFrame, every: str, by=("symbol",), ts: str = "ts", qty: str = "quantity",
                     side: str = "side") -> DataFrame:
    """Delta, running CVD, acceleration, count of trades five times the bucket mean, aggressor."""
    t = trades.withColumn("bucket", bucket(ts, every))
    key = [*by, "bucket"]
    base = t.groupBy(*key).agg(sum_if(C(side) == "buy", qty).alias("buy_volume"), sum_if(C(side) == "sell", qty).alias("sell_volume"),
                               F.count(F.lit(1)).alias("trade_count"), F.avg(qty).alias("_avg"))
    sizes = t.groupBy(*key, qty).agg(F.count(F.lit(1)).alias("_k"))
    large = (sizes.join(base.select(*key, "_avg"), key).where(C(qty) >= C("_avg") * 5).groupBy(*key)
             .agg(F.sum("_k").alias("large_trades")))
    d = base.join(large, key, "left").na.fill(0, ["large_trades"]).drop("_avg").withColumn("delta", C("buy_volume") - C("sell_volume"))
    d = d.withColumn("delta_pct", safe_div(C("delta"), C("buy_volume") + C("sell_volume")) * 100)
    plan = bucket_plan(d, by, ["bucket"], every, depth=1)
    d = running(d, plan, {"cvd": ("sum", "delta")})
    d = bounded(d, plan, 1, lambda x, p: x.withColumn("delta_acceleration", C("delta") - F.lag("delta").over(p.window())))
    p = C("delta_pct")
    return d.withColumn("aggressor", F.when(p > 20, "STRONG_BUYERS").when(p > 10, "BUYERS").when(p < -20, "STRONG_SELLERS")
                        .when(p < -10, "SELLERS").otherwise("BALANCED"))


def microstructure(trades: DataFrame, every: str, by=("symbol",), order=("ts", "trade_id"), ts: str = "ts") -> DataFrame:
    """Price impact, deviation of tick moves, slippage per million and market grade of each bucket."""
    t = trades.where(C("price") > 0).withColumn("bucket", bucket(ts, every))
    plan = plan_series(t, by, order, depth=1)

    def body(d, p):
        w = p.window()
        same = F.lag("bucket").over(w) == C("bucket")
        return d.withColumn("_move", F.when(same, F.abs(C("price") - F.lag("price").over(w))))
    at = F.struct(*order)
    g = bounded(t, plan, 1, body).groupBy(*by, "bucket").agg(
        F.min_by("price", at).alias("_p0"), F.max_by("price", at).alias("_p1"), F.sum("quantity").alias("total_volume"),
        F.sum(C("price") * C("quantity")).alias("total_value"), F.stddev_pop("_move").alias("micro_volatility"),
        F.count(F.lit(1)).alias("trade_count")).where(C("trade_count") >= 2)
    move = F.abs(C("_p1") - C("_p0"))
    g = g.withColumns({"price_impact": safe_div(move, C("total_volume")),
                       "slippage_per_million": safe_div(move / C("_p0") * 100, C("total_value") / 1e6)})
    score = (F.greatest(F.lit(0.0), 100 - C("price_impact") * 10000) + F.greatest(F.lit(0.0), 100 - C("micro_volatility") * 100)) / 2
    return g.withColumn("efficiency_score", score).withColumn("market_quality", label_by(
        C("efficiency_score"), [(80, "EXCELLENT"), (60, "GOOD"), (40, "NORMAL"), (20, "POOR")], "FRAGILE")).drop("_p0", "_p1")


# ---- layer 2: leverage ----

def oi_flow(oi: DataFrame, every: str, by=("symbol",), ts: str = "ts") -> DataFrame:
    """Who opens or closes positions, from the change of total open interest and price."""
    d = prev(oi_totals(oi, every, by, ts=ts), by, ["bucket"], every, _o="total_oi", _p="avg_price").where(C("_o").isNotNull())
    d = d.withColumns({"oi_change_pct": safe_div(C("total_oi") - C("_o"), C("_o")) * 100,
                       "price_change_pct": safe_div(C("avg_price") - C("_p"), C("_p")) * 100}).drop("_o", "_p")
    o, p = C("oi_change_pct"), C("price_change_pct")
    intent = (F.when((p > 0.05) & (o > 0.1), "LONGS_OPENING").when((p < -0.05) & (o > 0.1), "SHORTS_OPENING")
              .when((p > 0.05) & (o < -0.1), "SHORTS_CLOSING").when((p < -0.05) & (o < -0.1), "LONGS_CLOSING").otherwise("CONSOLIDATION"))
    i = C("position_intent")
    return d.withColumn("position_intent", intent).withColumn(
        "position_intent_score", F.when(i == "LONGS_OPENING", F.least(F.abs(o + p) * 10, F.lit(100.0)))
        .when(i == "SHORTS_OPENING", -F.least(F.abs(o + F.abs(p)) * 10, F.lit(100.0)))
        .when(i == "SHORTS_CLOSING", F.least(F.abs(p) * 10, F.lit(80.0)))
        .when(i == "LONGS_CLOSING", -F.least(F.abs(p) * 10, F.lit(80.0))).otherwise(0.0))


def leverage_index(oi: DataFrame, ticker: DataFrame, every: str, by=("symbol",), exchange: str = "exchange", ts: str = "ts") -> DataFrame:
    """Open interest over 24-hour volume, averaged over venues, against a norm of 1 +- 0.5."""
    b = bucket(ts, every).alias("bucket")
    o = oi.groupBy(*by, exchange, b).agg(F.max_by("open_interest", ts).alias("_o"))
    v = ticker.groupBy(*by, exchange, b).agg(F.max_by("volume_24h", ts).alias("_v")).where(C("_v") > 0)
    d = o.join(v, [*by, exchange, "bucket"]).groupBy(*by, "bucket").agg(F.avg(C("_o") / C("_v")).alias("leverage_index"))
    z = C("leverage_zscore")
    return d.withColumn("leverage_zscore", (C("leverage_index") - 1.0) / 0.5).withColumns({
        "risk_level": label_by(z, [(2, "EXTREME"), (1, "HIGH"), (0, "ELEVATED"), (-1, "NORMAL")], "LOW"),
        "cascade_probability": F.when(z > 2, 90).when(z > 1, 70).when(z > 0, 45).when(z > -1, 20).otherwise(10)})


def funding_stress(fr: DataFrame, every: str, by=("symbol",), exchange: str = "exchange", ts: str = "ts", rate: str = "funding_rate") -> DataFrame:
    """Mean rate of the venues in percent against a norm of 0.01 +- 0.03, stress level and crowding."""
    per = fr.groupBy(*by, exchange, bucket(ts, every).alias("bucket")).agg((F.max_by(rate, ts) * 100).alias("_r"))
    d = per.groupBy(*by, "bucket").agg(F.avg("_r").alias("avg_funding_rate"))
    d = prev(d, by, ["bucket"], every, _p="avg_funding_rate")
    d = d.withColumns({"funding_zscore": (C("avg_funding_rate") - 0.01) / 0.03, "funding_momentum": C("avg_funding_rate") - C("_p"),
                       "carry_crowding": F.abs(C("avg_funding_rate") * 3 * 365)}).drop("_p")
    z = C("funding_zscore")
    return d.withColumns({
        "stress_level": label_by(F.abs(z), [(3, "EXTREME"), (2, "HIGH"), (1, "ELEVATED")], "NORMAL"),
        "sentiment": F.when(z > 2, "EXTREME_BULLISH_CROWDING").when(z > 1, "BULLISH_CROWDING").when(z < -2, "EXTREME_BEARISH_CROWDING")
                      .when(z < -1, "BEARISH_CROWDING").otherwise("NEUTRAL")})


def basis_regime(mark: DataFrame, every: str, by=("symbol",), exchange: str = "exchange", ts: str = "ts") -> DataFrame:
    """Mean basis of the venues, its spread and trend, and the curve regime."""
    pct = (C("mark_price") - C("index_price")) / C("index_price") * 100
    per = mark.where(C("index_price") > 0).groupBy(*by, exchange, bucket(ts, every).alias("bucket")).agg(F.max_by(pct, ts).alias("_b"))
    d = per.groupBy(*by, "bucket").agg(
        F.avg("_b").alias("avg_basis_pct"), F.coalesce(F.stddev_pop("_b"), F.lit(0.0)).alias("basis_volatility"),
        ((F.count("_b") > 1) & (F.max("_b") - F.min("_b") > 0.1)).alias("arbitrage_opportunity"))
    plan = bucket_plan(d, by, ["bucket"], every, depth=8)

    def body(x, p):
        w = p.window()
        step = F.signum(C("avg_basis_pct") - F.lag("avg_basis_pct").over(w))
        return x.withColumn("_s", step).withColumns({"_n": F.count(F.lit(1)).over(rows(p, 5, end=-1)),
                                                     "_t": F.sum("_s").over(rows(p, 4, end=-1))})
    a = C("avg_basis_pct")
    return bounded(d, plan, 8, body).withColumns({
        "basis_trend": F.when((C("_n") >= 5) & (C("_t") == 4), "EXPANDING").when((C("_n") >= 5) & (C("_t") == -4), "CONTRACTING").otherwise("STABLE"),
        "regime": F.when(a > 0.1, "OVERHEATED_CONTANGO").when(a > 0.02, "HEALTHY_CONTANGO").when(a < -0.1, "BACKWARDATION_STRESS")
                   .when(a < -0.02, "MILD_BACKWARDATION").otherwise("NEUTRAL_BASIS"),
        "regime_strength": F.when(F.abs(a) > 0.1, F.least(F.abs(a) * 100, F.lit(100.0))).when(F.abs(a) > 0.02, F.abs(a) * 200).otherwise(50.0)
    }).drop("_s", "_n", "_t")


# ---- layer 3: cross-exchange ----

def price_leadership(returns: DataFrame, symbol: str = "symbol", exchange: str = "exchange", index: str = "idx", value: str = "ret",
                     move: float = 0.0001) -> DataFrame:
    """Variance, first-mover ratio, score and rank of each venue, with the best lag of its follower links.

    ``returns`` is a bucketed grid: one row per (symbol, venue, bucket index).
    """
    moved = F.abs(value) > move
    w = Window.partitionBy(symbol, index)          # one row per venue
    alone = returns.withColumn("_first", F.when(moved & (F.sum(F.when(moved, 1).otherwise(0)).over(w) == 1), 1).otherwise(0))
    per = alone.groupBy(symbol, exchange).agg(F.var_pop(value).alias("variance"), F.avg("_first").alias("first_mover_ratio"))
    per = per.withColumn("score", C("variance") * 1000 + C("first_mover_ratio") * 100)
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(symbol).orderBy(C("score").desc(), exchange)))
    links = lag_pairs(returns, symbol, exchange, index, value)
    best = links.groupBy(symbol, "leader", "follower").agg(F.max_by("lag", F.struct(F.abs("corr"), -C("lag"))).alias("best_lag"))
    lead = per.where(C("rank") == 1).select(symbol, C(exchange).alias("leader"))
    best = best.join(lead, [symbol, "leader"]).select(symbol, C("follower").alias(exchange), "leader", "best_lag")
    return per.join(best, [symbol, exchange], "left")


def spread_arbitrage(latest: DataFrame, depth: DataFrame | None = None, by="symbol", price: str = "price", n: int = 10) -> DataFrame:
    """Top venue pairs by spread times fill probability; ``depth`` gives spread_pct, bid_depth, ask_depth per venue."""
    opp = spread_matrix(latest, by, price).where(C("spread_pct") > 0.01)
    if depth is not None:
        for side, mine in (("a", "ask_depth"), ("b", "bid_depth")):
            opp = opp.join(depth.select(by, C("exchange").alias(f"exchange_{side}"), C("spread_pct").alias(f"_s{side}"),
                                        C(mine).alias(f"_d{side}")), [by, f"exchange_{side}"], "left")
        known = C("_sa").isNotNull() & C("_sb").isNotNull()
        fill = F.when(known, F.greatest(F.lit(0.5), 1 - (C("_sa") + C("_sb")) / 2 / 10)).otherwise(0.8)
        low = F.least("_da", "_db")
        risk = F.when(known & (low < 1), "HIGH").when(known & (low < 5), "MODERATE").otherwise("LOW")
    else:
        fill, risk = F.lit(0.8), F.lit("LOW")
    opp = opp.withColumns({"fill_probability": fill, "slippage_risk": risk})
    opp = opp.withColumn("net_expected_profit_pct", C("spread_pct") * C("fill_probability"))
    w = Window.partitionBy(by).orderBy(C("net_expected_profit_pct").desc(), "exchange_a", "exchange_b")
    return opp.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n).drop("_sa", "_sb", "_da", "_db")


def flow_sync(trades: DataFrame, every: str, by=("symbol",), exchange: str = "exchange", ts: str = "ts", qty: str = "quantity") -> DataFrame:
    """Agreement of the venues' flow direction and evenness of their volumes."""
    per = trades.groupBy(*by, bucket(ts, every).alias("bucket"), exchange).agg(
        sum_if(C("side") == "buy", qty).alias("_b"), sum_if(C("side") == "sell", qty).alias("_s"))
    per = per.withColumns({"_v": C("_b") + C("_s"), "_d": safe_div(C("_b") - C("_s"), C("_b") + C("_s")) * 100})
    g = per.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("venues"), count_if(C("_d") > 5).alias("_p"), count_if(C("_d") < -5).alias("_n"),
        safe_div(F.stddev_pop("_v"), F.avg("_v")).alias("_cv"), F.avg("_d").alias("avg_delta_pct")).where(C("venues") >= 2)
    g = g.withColumns({"flow_correlation": F.greatest("_p", "_n") / C("venues"),
                       "volume_sync_score": F.greatest(F.lit(0.0), (1 - C("_cv")) * 100)})
    g = g.withColumn("synchronization_score", C("flow_correlation") * 60 + C("volume_sync_score") * 0.4)
    a = C("avg_delta_pct")
    return g.withColumns({
        "coordinated_flow": (C("flow_correlation") > 0.8) & (C("synchronization_score") > 70),
        "dominant_direction": F.when(a > 15, "STRONG_BUYING").when(a > 5, "BUYING").when(a < -15, "STRONG_SELLING")
                               .when(a < -5, "SELLING").otherwise("NEUTRAL")}).drop("_p", "_n", "_cv")


def price_divergence(prices: DataFrame, every: str, z: float = 2.0, by=("symbol",), exchange: str = "exchange", price: str = "mid_price",
                     ts: str = "ts") -> DataFrame:
    """Venues whose last price of a bucket lies more than z sample deviations from the venues' mean."""
    per = prices.groupBy(*by, bucket(ts, every).alias("bucket"), exchange).agg(F.max_by(price, ts).alias("price"))
    w = Window.partitionBy(*by, "bucket")
    d = per.withColumns({"mean": F.avg("price").over(w), "_sd": F.stddev_samp("price").over(w)})
    d = d.withColumn("zscore", F.when(C("_sd") > 0, (C("price") - C("mean")) / C("_sd"))).where(F.abs("zscore") > z)
    return d.withColumn("direction", F.when(C("zscore") > 0, "HIGH").otherwise("LOW")).drop("_sd")


# ---- layer 4: regime ----

def _in(col: str, *values: str) -> Column:
    return F.coalesce(C(col).isin(*values), F.lit(False))


def market_regime(layers: DataFrame, by=("symbol",), order=("bucket",), every: str | None = None) -> DataFrame:
    """Seven regimes from layer scores, with confidence, strength and the length of the current run."""
    v, d, imb = F.coalesce("vacuum_score", F.lit(0.0)), F.coalesce("delta_pct", F.lit(0.0)), F.coalesce("imbalance_ratio", F.lit(0.0))
    df = layers.withColumns({
        "score_volatility": F.when((v > 70) | _in("market_quality", "FRAGILE", "POOR"), 80).when(v > 40, 50).otherwise(20),
        "score_liquidity": F.when((v < 30) & _in("market_quality", "EXCELLENT", "GOOD"), 80).when(v < 50, 50).otherwise(20),
        "score_leverage": F.when(_in("risk_level", "EXTREME", "HIGH") | _in("cascade_risk", "EXTREME", "HIGH"), 90)
                           .when(_in("risk_level", "ELEVATED"), 60).otherwise(30),
        "score_funding": F.when(_in("stress_level", "EXTREME", "HIGH"), 85).when(_in("stress_level", "ELEVATED"), 55).otherwise(25)})
    sv, sl, sg = C("score_volatility"), C("score_liquidity"), C("score_leverage")
    df = df.withColumns({
        "score_accumulation": F.when((d > 10) & (imb > 0.1) & _in("position_intent", "LONGS_OPENING") & (sv < 50), 80)
                               .when((d > 5) & (imb > 0.05), 50).otherwise(0),
        "score_distribution": F.when((d < -10) & (imb < -0.1) & _in("position_intent", "SHORTS_OPENING") & (sv < 50), 80)
                               .when((d < -5) & (imb < -0.05), 50).otherwise(0)})
    sa, sd = C("score_accumulation"), C("score_distribution")
    squeezed = _in("cascade_risk", "EXTREME", "HIGH") & ~F.coalesce(C("dominance") == "NEUTRAL", F.lit(True)) & (sv > 60)
    regime = (F.when(squeezed, "SQUEEZE").when((sv > 70) & (sg > 70) & _in("market_quality", "FRAGILE"), "CHAOS")
              .when((sv > 60) & (F.abs(d) > 20) & (v > 50), "BREAKOUT").when(sa > 60, "ACCUMULATION").when(sd > 60, "DISTRIBUTION")
              .when((sv < 40) & (sl > 60) & (F.abs(d) < 10), "MEAN_REVERSION").otherwise("CONSOLIDATION"))
    df = df.withColumn("current_regime", regime)
    r = C("current_regime")
    df = df.withColumns({
        "regime_confidence": F.when(r == "SQUEEZE", F.least(F.lit(90), sg)).when(r == "CHAOS", F.least(F.lit(85.0), (sv + sg) / 2))
                              .when(r == "BREAKOUT", F.least(F.lit(80), sv)).when(r == "ACCUMULATION", sa).when(r == "DISTRIBUTION", sd)
                              .when(r == "MEAN_REVERSION", sl).otherwise(60).cast("double"),
        "regime_strength": F.when(r == "SQUEEZE", sg).when(r == "CHAOS", sv).when(r == "BREAKOUT", F.abs(d)).when(r == "ACCUMULATION", sa)
                            .when(r == "DISTRIBUTION", sd).when(r == "MEAN_REVERSION", 100 - sv).otherwise(50).cast("double")})
    from tickloom.operators.series import islands
    seen = islands(df, by, order, lambda p: p("current_regime") != r, every=every).withColumn("_one", F.lit(1))
    plan = bucket_plan(seen, [*by, "island"], order, every)
    return running(seen, plan, {"regime_duration": ("sum", "_one")}).drop("island", "_one").withColumn(
        "transition_probability", transition_probabilities())


# Per regime the targets as (regime, score it grows with, offset, cap); no score = constant cap.
REGIME_EXITS = {
    "CONSOLIDATION": [("BREAKOUT", "volatility", 0, 40), ("ACCUMULATION", "accumulation", 0, 30),
                      ("DISTRIBUTION", "distribution", 0, 30), ("SQUEEZE", "leverage", 0, 20)],
    "ACCUMULATION": [("BREAKOUT", "volatility", 20, 50), ("DISTRIBUTION", "distribution", 0, 20), ("CONSOLIDATION", None, 0, 30)],
    "DISTRIBUTION": [("BREAKOUT", "volatility", 20, 50), ("ACCUMULATION", "accumulation", 0, 20), ("CONSOLIDATION", None, 0, 30)],
    "BREAKOUT": [("SQUEEZE", "leverage", 0, 40), ("CONSOLIDATION", None, 0, 40), ("CHAOS", "volatility", -50, 20)],
    "SQUEEZE": [("CHAOS", "volatility", 0, 40), ("MEAN_REVERSION", None, 0, 30), ("CONSOLIDATION", None, 0, 30)],
    "CHAOS": [("SQUEEZE", "leverage", 0, 30), ("MEAN_REVERSION", None, 0, 40), ("CONSOLIDATION", None, 0, 30)],
    "MEAN_REVERSION": [("CONSOLIDATION", None, 0, 40), ("BREAKOUT", "volatility", 0, 30), ("ACCUMULATION", "accumulation", 0, 20),
                       ("DISTRIBUTION", "distribution", 0, 20)]}


def transition_probabilities() -> Column:
    """Map of next regime to percent (adds up to 100)."""
    out = None
    for regime, exits in REGIME_EXITS.items():
        raw = [F.lit(float(cap)) if s is None else F.least(F.lit(float(cap)), (C(f"score_{s}") + off).cast("double")) for _, s, off, cap in exits]
        total = reduce(lambda a, b: a + b, raw)
        m = F.create_map(*[x for (name, *_), p in zip(exits, raw) for x in (F.lit(name), F.when(total > 0, F.round(p / total * 100, 1)).otherwise(p))])
        test = C("current_regime") == regime
        out = F.when(test, m) if out is None else out.when(test, m)
    return out


# Base score of each cascade risk.
CASCADE_SCORE = {"LOW": 10.0, "MODERATE": 40.0, "HIGH": 70.0, "EXTREME": 95.0}
EVENT_WEIGHTS = [2.0, 1.5, 1.2, 1.0, 1.0, 1.0]


def event_risk(layers: DataFrame) -> DataFrame:
    """Six indicators, the worst weighing most, and the risk level."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = reduce(lambda a, kv: a.when(C("cascade_risk") == kv[0], kv[1]), list(CASCADE_SCORE.items())[1:],
                  F.when(C("cascade_risk") == "LOW", 10.0)).otherwise(10.0)
    ind = {"spread_expansion": zero(C("vacuum_score")),
           "depth_collapse": F.least(zero(C("thin_zones")) * 15.0, F.lit(100.0)),
           "trade_burst": F.least(F.abs(zero(C("delta_acceleration"))) * 10 + zero(C("large_trades")) * 10, F.lit(100.0)),
           "liquidation_spike": base + F.least(F.abs(zero(C("liquidation_momentum"))) / 10000, F.lit(20.0)),
           "leverage_stress": F.least(F.abs(zero(C("leverage_zscore"))) * 30, F.lit(100.0)),
           "funding_stress": F.least(F.abs(zero(C("funding_zscore"))) * 25, F.lit(100.0))}
    df = layers.withColumns({f"risk_{k}": v.cast("double") for k, v in ind.items()})
    desc = F.sort_array(F.array(*[C(f"risk_{k}") for k in ind]), asc=False)
    w = F.array(*[F.lit(x) for x in EVENT_WEIGHTS])
    score = F.aggregate(F.zip_with(desc, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / sum(EVENT_WEIGHTS)
    limits = {"spread_expansion": 70, "depth_collapse": 60, "trade_burst": 70, "liquidation_spike": 60, "leverage_stress": 60, "funding_stress": 70}
    warn = F.filter(F.array(*[F.when(C(f"risk_{k}") > t, F.lit(k)) for k, t in limits.items()]), lambda x: x.isNotNull())
    return df.withColumns({"event_risk_score": score, "active_warnings": warn}).withColumn(
        "event_risk_level", label_by(C("event_risk_score"), [(80, "EXTREME"), (60, "HIGH"), (40, "ELEVATED"), (20, "MODERATE")], "LOW"))


def volatility_state(df: DataFrame, by=("symbol",), order=("bucket",), value: str = "micro_volatility", n: int = 100,
                     every: str | None = None) -> DataFrame:
    """Place of the current value among the last n, regime, clustering, and expansion odds."""
    plan = bucket_plan(df, by, order, every, depth=n)

    def body(d, p):
        w, ten = rows(p, n), rows(p, 10)
        xs = F.collect_list(value).over(w)
        return d.withColumns({"_xs": xs, "_cv": safe_div(F.stddev_pop(value).over(ten), F.avg(value).over(ten))})
    here = C(value)
    enough = F.size("_xs") >= 10
    pct = F.size(F.filter("_xs", lambda x: x < here)) / F.size("_xs") * 100
    d = bounded(df, plan, n, body).withColumn("volatility_percentile", F.when(enough, pct).otherwise(50.0))
    p = C("volatility_percentile")
    d = d.withColumns({
        "volatility_regime": F.when(~enough, "NORMAL").otherwise(label_by(p, [(90, "EXTREME"), (75, "HIGH"), (50, "ELEVATED"), (25, "NORMAL")], "LOW")),
        "clustering_detected": enough & (C("_cv") < 0.3)})
    r = C("volatility_regime")
    return d.withColumns({"expansion_probability": F.when(~enough, 0).when(r == "LOW", 70).when(r.isin("HIGH", "EXTREME"), 30).otherwise(50),
                          "contraction_probability": F.when(~enough, 0).when(r == "LOW", 30).when(r.isin("HIGH", "EXTREME"), 70).otherwise(50)}
                         ).drop("_xs", "_cv")


# ---- layer 5: alpha ----

# Component weights of institutional pressure.
PRESSURE = {"orderbook_imbalance": 0.20, "trade_delta": 0.25, "oi_flow": 0.20, "funding_skew": 0.15, "basis_trend": 0.10, "flow_sync": 0.10}


def institutional_pressure(layers: DataFrame, by=("symbol",), order=("bucket",), every: str | None = None) -> DataFrame:
    """Weighted pressure in [-100, 100], agreement of its parts and the trend of the last five values."""
    zero = lambda n: F.coalesce(C(n), F.lit(0.0))
    sync, dom = zero("synchronization_score"), C("dominant_direction")
    parts = {"orderbook_imbalance": zero("imbalance_ratio") * 100, "trade_delta": clip(zero("delta_pct"), -100.0, 100.0),
             "oi_flow": zero("position_intent_score"), "funding_skew": -zero("funding_zscore") * 20, "basis_trend": zero("avg_basis_pct") * 50,
             "flow_sync": F.when(dom == "STRONG_BUYING", sync).when(dom == "BUYING", sync * 0.6).when(dom == "STRONG_SELLING", -sync)
                           .when(dom == "SELLING", -sync * 0.6).otherwise(0.0)}
    df = layers.withColumns({f"part_{k}": v for k, v in parts.items()})
    score = reduce(lambda a, b: a + b, [C(f"part_{k}") * w for k, w in PRESSURE.items()])
    count = lambda test: reduce(lambda a, b: a + b, [F.when(test(C(f"part_{k}")), 1).otherwise(0) for k in parts])
    df = df.withColumns({"pressure_score": score,
                         "pressure_confidence": F.greatest(count(lambda x: x > 10), count(lambda x: x < -10)) / 6 * 100}).drop(*[f"part_{k}" for k in parts])
    plan = bucket_plan(df, by, order, every, depth=6)

    def body(d, p):
        w = p.window()
        d = d.withColumn("_s", F.signum(C("pressure_score") - F.lag("pressure_score").over(w)))
        return d.withColumns({"_t": F.sum("_s").over(rows(p, 4)), "_old": F.lag("pressure_score", 4).over(w)})
    s, five, change = C("pressure_score"), C("_old").isNotNull(), (C("pressure_score") - C("_old")) / 5
    d = bounded(df, plan, 6, body).withColumns({
        "pressure_direction": F.when(s > 50, "STRONG_BULLISH").when(s > 25, "BULLISH").when(s > 10, "SLIGHTLY_BULLISH").when(s < -50, "STRONG_BEARISH")
                               .when(s < -25, "BEARISH").when(s < -10, "SLIGHTLY_BEARISH").otherwise("NEUTRAL"),
        "pressure_strength": F.when(F.abs(s) > 50, "STRONG").when(F.abs(s) > 25, "MODERATE").when(F.abs(s) > 10, "WEAK").otherwise("NONE"),
        "pressure_trend": F.when(five & (C("_t") == 4), "STRENGTHENING_BULLISH").when(five & (C("_t") == -4), "STRENGTHENING_BEARISH")
                           .when(five & (change > 2), "TURNING_BULLISH").when(five & (change < -2), "TURNING_BEARISH").otherwise("STABLE")})
    sure = C("pressure_confidence") > 60
    return d.withColumn("recommendation", F.when((s > 25) & sure, "FAVORABLE_FOR_LONGS").when((s < -25) & sure, "FAVORABLE_FOR_SHORTS")
                        .otherwise("NEUTRAL_WAIT")).drop("_s", "_t", "_old")


def alpha_squeeze(layers: DataFrame) -> DataFrame:
    """Squeeze probability from leverage, funding crowding and vacuum, larger when the regime agrees."""
    zero = lambda n: F.coalesce(C(n).cast("double"), F.lit(0.0))
    z, lev, vac = zero("funding_zscore"), zero("cascade_probability"), zero("vacuum_score")
    crowd = F.when(F.abs(z) > 2, 80).when(F.abs(z) > 1, 50).otherwise(20)
    side = F.when(z > 1, "LONGS").when(z < -1, "SHORTS").otherwise("NEUTRAL")
    ll, sl = zero("long_liquidation_value"), zero("short_liquidation_value")
    dom = F.when(ll + sl <= 0, "NONE").when(ll > sl * 2, "LONG_LIQUIDATIONS").when(sl > ll * 2, "SHORT_LIQUIDATIONS").otherwise("BALANCED")
    base = lev * 0.4 + crowd * 0.3 + vac * 0.3
    prob = F.when(_in("current_regime", "SQUEEZE"), F.least(base * 1.3, F.lit(100.0))).otherwise(base)
    df = layers.withColumns({"squeeze_probability": prob, "squeeze_intensity": (lev + vac) / 2,
                             "squeeze_type": F.when((side == "LONGS") | (dom == "LONG_LIQUIDATIONS"), "LONG_SQUEEZE")
                             .when((side == "SHORTS") | (dom == "SHORT_LIQUIDATIONS"), "SHORT_SQUEEZE").otherwise("NONE")})
    return df.withColumn("time_to_squeeze", label_by(C("squeeze_probability"), [(80, "IMMINENT"), (60, "LIKELY_SOON"), (40, "POSSIBLE")], "UNLIKELY"))


def absorption(layers: DataFrame, zones: DataFrame | None = None, by=("symbol",)) -> DataFrame:
    """Volume taken without price impact; ``zones`` (persistent levels) adds the defended prices."""
    v = F.least(F.coalesce("total_volume", F.lit(0.0)) / 100, F.lit(2.0))
    impact, d = F.coalesce("price_impact", F.lit(0.0)), F.coalesce("delta_pct", F.lit(0.0))
    df = layers.withColumn("absorption_strength", F.least(F.lit(100.0), F.when(impact > 0, v / impact).otherwise(v * 100)))
    s = C("absorption_strength")
    df = df.withColumn("absorption_type", F.when((d > 15) & (s > 50), "BUY_ABSORPTION").when((d < -15) & (s > 50), "SELL_ABSORPTION")
                       .when((F.abs(d) < 5) & (s > 60), "BALANCED_ABSORPTION").otherwise("NONE"))
    if zones is not None:
        kept = zones.where((C("rank") <= 3) & (C("reliability") > 60)).groupBy(*by).agg(
            F.slice(F.sort_array(F.collect_list(F.struct("reliability", "zone", "price", "avg_size")), asc=False), 1, 5).alias("defended_levels"))
        df = df.join(kept, list(by), "left")
    return df


def alpha_signal(layers: DataFrame) -> DataFrame:
    """Weighted votes of pressure, squeeze and absorption, scaled by the regime."""
    zero = F.lit(0.0)
    pd_, sp, st, ab = C("pressure_direction"), C("squeeze_probability"), C("squeeze_type"), C("absorption_type")
    strength = C("absorption_strength") * 0.8
    squeeze = F.when(sp > 70, sp).when(sp > 50, sp * 0.8).otherwise(0.0)
    buy = (F.when(pd_.contains("BULLISH"), C("pressure_confidence")).otherwise(zero) + F.when(st == "SHORT_SQUEEZE", squeeze).otherwise(zero)
           + F.when(ab == "BUY_ABSORPTION", strength).otherwise(zero))
    sell = (F.when(pd_.contains("BEARISH"), C("pressure_confidence")).otherwise(zero) + F.when(st == "LONG_SQUEEZE", squeeze).otherwise(zero)
            + F.when(ab == "SELL_ABSORPTION", strength).otherwise(zero))
    r = C("current_regime")
    k = F.when(r.isin("CHAOS", "SQUEEZE"), 1.2).when(r == "BREAKOUT", 1.1).when(r == "CONSOLIDATION", 0.8).otherwise(1.0)
    df = layers.withColumns({"buy_weight": buy * k, "sell_weight": sell * k})
    b, s = C("buy_weight"), C("sell_weight")
    strong = sp > 70
    return df.withColumns({
        "alpha_signal": F.when(b > s, F.when((b - s > 100) | (strong & (st == "SHORT_SQUEEZE")), "STRONG_BUY").when(b - s > 50, "BUY").otherwise("WEAK_BUY"))
                         .when(s > b, F.when((s - b > 100) | (strong & (st == "LONG_SQUEEZE")), "STRONG_SELL").when(s - b > 50, "SELL").otherwise("WEAK_SELL"))
                         .otherwise("NEUTRAL"),
        "alpha_confidence": F.when(b > s, F.least(b, F.lit(100.0))).when(s > b, F.least(s, F.lit(100.0))).when(b + s > 0, 50.0).otherwise(0.0),
        "urgency": F.when(r.isin("CHAOS", "SQUEEZE"), "HIGH").when(r == "BREAKOUT", "MEDIUM").otherwise("LOW"),
        "risk_reward": F.when(_in("event_risk_level", "EXTREME", "HIGH"), "UNFAVORABLE").when(_in("event_risk_level", "ELEVATED"), "MODERATE")
                        .otherwise("FAVORABLE")})


def layer_rows(trades: DataFrame, books: DataFrame, oi: DataFrame, ticker: DataFrame, funding: DataFrame, marks: DataFrame,
               liquidations: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    """Layers 1-3 as one wide row per (symbol, bucket)."""
    key = ["symbol", "bucket"]
    b = bucket(ts, every).alias("bucket")
    book = books.groupBy("symbol", b).agg(F.max_by(F.struct("bids", "asks"), ts).alias("x")).select(*key, "x.*")
    vac = liquidity_vacuum(liquidity_imbalance(book, order=("bucket",), every=every)).select(*key, "imbalance_ratio", "vacuum_score", "thin_zones")
    liq = liquidations.groupBy("symbol", b).agg(
        sum_if(C("side") == "long", "value_usd").alias("long_liquidation_value"), sum_if(C("side") == "short", "value_usd").alias("short_liquidation_value"))
    tot = C("long_liquidation_value") + C("short_liquidation_value")
    liq = liq.withColumns({
        "_liq": tot, "cascade_risk": label_by(tot, [(10_000_000, "EXTREME"), (1_000_000, "HIGH"), (100_000, "MODERATE")], "LOW"),
        "dominance": F.when(C("long_liquidation_value") / tot > 0.7, "LONG_LIQUIDATION_DOMINANT")
                      .when(C("short_liquidation_value") / tot > 0.7, "SHORT_LIQUIDATION_DOMINANT").otherwise("BALANCED")})
    liq = prev(liq, ["symbol"], ["bucket"], every, _pl="_liq").withColumn("liquidation_momentum", C("_liq") - C("_pl")).drop("_liq", "_pl")
    parts = [
        trade_aggression(trades, every).drop("trade_count"),
        microstructure(trades, every).select(*key, "price_impact", "micro_volatility", "market_quality", "total_volume"),
        oi_flow(oi, every).select(*key, "oi_change_pct", "position_intent", "position_intent_score"),
        leverage_index(oi, ticker, every), funding_stress(funding, every).drop("sentiment", "carry_crowding"),
        basis_regime(marks, every).select(*key, "avg_basis_pct", C("regime").alias("basis_regime")),
        flow_sync(trades, every).select(*key, "synchronization_score", "dominant_direction"), vac, liq]
    return reduce(lambda x, y: x.join(y, key, "left"), parts)


def market_intelligence(trades, books, oi, ticker, funding, marks, liquidations, every: str) -> DataFrame:
    """All five layers for every symbol and bucket in one plan."""
    base = layer_rows(trades, books, oi, ticker, funding, marks, liquidations, every)
    base = volatility_state(event_risk(market_regime(base, every=every)), every=every)
    return alpha_signal(absorption(alpha_squeeze(institutional_pressure(base, every=every))))


def period_report(prices: DataFrame, trades: DataFrame, funding: DataFrame, liquidations: DataFrame, start, end, by=("symbol",), ts: str = "ts") -> DataFrame:
    """Price, flow, funding and liquidation summary of a bounded period with its regime and signals."""
    inside = C(ts).between(F.lit(start), F.lit(end))
    p = prices.where(inside).groupBy(*by).agg(
        F.min_by("mid_price", ts).alias("open"), F.max_by("mid_price", ts).alias("close"), F.max("mid_price").alias("high"),
        F.min("mid_price").alias("low"), F.stddev("mid_price").alias("deviation"), F.avg("mid_price").alias("average"))
    t = trades.where(inside).groupBy(*by).agg(
        sum_if(C("side") == "buy", "quantity").alias("buy_volume"), sum_if(C("side") == "sell", "quantity").alias("sell_volume"),
        F.count(F.lit(1)).alias("trades"))
    f = funding.where(inside).groupBy(*by).agg(F.avg("funding_rate").alias("avg_funding"))
    q = liquidations.where(inside).groupBy(*by).agg(F.count(F.lit(1)).alias("liquidations"), F.sum("value_usd").alias("liquidation_value"),
                                                    sum_if(C("side") == "long", "value_usd").alias("long_liquidations"))
    d = p.join(t, list(by), "left").join(f, list(by), "left").join(q, list(by), "left")
    d = d.withColumns({"change_pct": safe_div(C("close") - C("open"), C("open")) * 100, "cvd": C("buy_volume") - C("sell_volume"),
                       "flow_imbalance_pct": safe_div(C("buy_volume") - C("sell_volume"), C("buy_volume") + C("sell_volume")) * 100,
                       "volatility_pct": safe_div(C("deviation"), C("average")) * 100})
    return d.withColumns({
        "regime": F.when(C("volatility_pct") > 50, "HIGH_VOL").when(C("change_pct") > 1, "TRENDING_UP").when(C("change_pct") < -1, "TRENDING_DOWN").otherwise("RANGING"),
        "flow_signal": F.when(C("flow_imbalance_pct") > 10, "BULLISH").when(C("flow_imbalance_pct") < -10, "BEARISH").otherwise("NEUTRAL")})


# ---- funding, cascades, volatility ----

def funding_patterns(fr: DataFrame, by=("exchange",), rate: str = "funding_rate") -> DataFrame:
    d = fr.groupBy(*by).agg(F.avg(rate).alias("avg_rate"), F.coalesce(F.stddev(rate), F.lit(0.0)).alias("rate_volatility"))
    return d.withColumns({"sign_pattern": F.when(C("avg_rate") > 0.0001, "persistently_positive").when(C("avg_rate") < -0.0001, "persistently_negative")
                          .otherwise("mixed"), "stability": F.when(C("rate_volatility") > 0.0002, "volatile").otherwise("stable")})


def cascade_probability(liq: DataFrame, by=("symbol",), ts: str = "ts", minutes: float = 5, hours: float = 24, recent_s: int = 1800, as_of=None) -> DataFrame:
    """Chance of a cascade from recent clusters (0.4), frequency (0.3) and one-sidedness (0.3)."""
    from tickloom.operators.windows import cascades
    now = F.lit(as_of) if as_of is not None else liq.select(F.max(ts)).scalar()
    c = cascades(liq, by, ts, minutes).groupBy(*by).agg(F.count(F.lit(1)).alias("cascades"), F.max("end_time").alias("_last"))
    n = liq.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), count_if(C("side") == "long").alias("_l"))
    d = n.join(c, list(by), "left").withColumn("_now", now)
    fresh = F.timestamp_diff("SECOND", C("_last"), C("_now")) < recent_s
    past = F.when(C("cascades") > 0, 0.1 * F.least(C("cascades") / 5, F.lit(1.0))).otherwise(0.0)
    prob = (F.when(F.coalesce(fresh, F.lit(False)), 0.4).otherwise(past) + 0.3 * F.least(C("_n") / hours / 20, F.lit(1.0))
            + 0.3 * F.abs(2 * C("_l") - C("_n")) / C("_n"))
    return d.select(*by, F.coalesce("cascades", F.lit(0)).alias("cascades"), F.least(prob, F.lit(1.0)).alias("probability")).withColumn(
        "risk_level", label_by(C("probability"), [(0.8, "EXTREME"), (0.6, "HIGH"), (0.4, "ELEVATED"), (0.2, "MODERATE")], "LOW", strict=False))


def volatility_regime(p: DataFrame, by=("symbol",), order=("ts",), price: str = "mid_price", short: int = 60, long: int = 1440) -> DataFrame:
    """Short and long rolling volatility, their ratio, and the regime of each value within its key's history."""
    from tickloom.operators.series import quantiles
    from tickloom.operators.windows import rolling_vol
    d = rolling_vol(rolling_vol(p, by, order, price, short, "short_vol"), by, order, price, long, "long_vol")
    d = d.where(C("short_vol").isNotNull())
    cut = quantiles(d, by, "short_vol", {"_p25": 0.25, "_p75": 0.75, "_p95": 0.95})
    v = C("short_vol")
    return attach(d, cut, by).withColumns({
        "vol_ratio": safe_div(v, C("long_vol"), None),
        "regime": F.when(v >= C("_p95"), "EXTREME").when(v >= C("_p75"), "HIGH").when(v >= C("_p25"), "NORMAL").otherwise("LOW")}).drop("_p25", "_p75", "_p95")


# ---- venue reports ----

def candle_summary(candles: DataFrame, by=("symbol",), ts: str = "open_time") -> DataFrame:
    """Newest candle against SMA-20, SMA-50, the whole range and the mean volume."""
    w = Window.partitionBy(*by).orderBy(C(ts).desc())
    last = candles.withColumn("_r", F.row_number().over(w)).where(C("_r") <= 50)
    near = last.groupBy(*by).agg(
        F.max_by("close", ts).alias("current_price"), F.count(F.lit(1)).alias("_n"), F.avg(F.when(C("_r") <= 20, C("close"))).alias("_s20"),
        F.avg("close").alias("_s50"), F.sum(F.when(C("_r") <= 5, C("volume"))).alias("_v5"))
    full = candles.groupBy(*by).agg(F.max("high").alias("period_high"), F.min("low").alias("period_low"), F.avg("volume").alias("avg_volume"),
                                    F.count(F.lit(1)).alias("candle_count"))
    p = C("current_price")
    d = near.join(full, list(by)).withColumns({"sma_20": F.when(C("_n") >= 20, C("_s20")).otherwise(p), "sma_50": F.when(C("_n") >= 50, C("_s50")).otherwise(p)})
    span = C("period_high") - C("period_low")
    return d.withColumns({
        "price_vs_sma20_pct": (p - C("sma_20")) / C("sma_20") * 100,
        "range_position_pct": F.when(span > 0, (p - C("period_low")) / span * 100).otherwise(50.0),
        "volume_ratio": F.when(C("avg_volume") != 0, C("_v5") / 5 / C("avg_volume")).otherwise(1.0),
        "trend": F.when((p > C("sma_20")) & (C("sma_20") > C("sma_50")), "BULLISH").when((p < C("sma_20")) & (C("sma_20") < C("sma_50")), "BEARISH").otherwise("NEUTRAL")
    }).drop("_n", "_s20", "_s50", "_v5")


def oi_trend(oi: DataFrame, by=("symbol",), ts: str = "ts", value: str = "open_interest") -> DataFrame:
    d = oi.groupBy(*by).agg(F.min_by(value, ts).alias("start_oi"), F.max_by(value, ts).alias("end_oi"), F.max(value).alias("period_high"),
                            F.min(value).alias("period_low"), F.count(F.lit(1)).alias("data_points"))
    d = d.withColumn("change_pct", safe_div(C("end_oi") - C("start_oi"), C("start_oi")) * 100)
    return d.withColumn("trend", F.when(C("change_pct") > 5, "INCREASING").when(C("change_pct") < -5, "DECREASING").otherwise("STABLE"))


def funding_history(fr: DataFrame, by=("symbol",), rate: str = "funding_rate", ts: str = "ts") -> DataFrame:
    return fr.groupBy(*by).agg(
        F.max_by(rate, ts).alias("current_rate"), F.avg(rate).alias("avg_rate"), (F.avg(rate) * 3 * 365 * 100).alias("annualized_pct"),
        F.max(rate).alias("max_rate"), F.min(rate).alias("min_rate"), count_if(C(rate) > 0).alias("positive_count"),
        count_if(C(rate) < 0).alias("negative_count"), F.count(rate).alias("data_points"))


def taker_trend(df: DataFrame, by=("symbol",), order=("ts",), ratio: str = "ratio", buy: str = "buy_vol", sell: str = "sell_vol") -> DataFrame:
    """Mean taker ratio of the last ten rows against the first ten, totals and current aggressor."""
    def edge(desc, out):
        w = Window.partitionBy(*by).orderBy(*[C(c).desc() if desc else C(c).asc() for c in order])
        return (df.withColumn("_r", F.row_number().over(w)).where(C("_r") <= 10).groupBy(*by)
                .agg(F.avg(ratio).alias(out), F.count(F.lit(1)).alias(f"_n{out}"), F.max_by(ratio, -C("_r")).alias(f"{out}_edge")))
    tot = df.groupBy(*by).agg(F.avg(ratio).alias("avg_ratio"), F.sum(buy).alias("total_buy_volume"), F.sum(sell).alias("total_sell_volume"),
                              F.count(F.lit(1)).alias("data_points"))
    d = tot.join(edge(True, "_new"), list(by)).join(edge(False, "_old"), list(by))
    d = d.withColumn("current_ratio", C("_new_edge"))
    new = F.when(C("data_points") >= 10, C("_new")).otherwise(C("_new_edge"))
    old = F.when(C("data_points") >= 10, C("_old")).otherwise(C("_old_edge"))
    r = C("current_ratio")
    return d.select(*by, "current_ratio", "avg_ratio", "total_buy_volume", "total_sell_volume", (C("total_buy_volume") - C("total_sell_volume")).alias("net_flow"),
                    F.when(new > old * 1.1, "INCREASING_BUYS").when(new < old * 0.9, "INCREASING_SELLS").otherwise("STABLE").alias("flow_trend"),
                    F.when(r > 1.05, "BUYERS").when(r < 0.95, "SELLERS").otherwise("BALANCED").alias("aggressor"), "data_points")


def long_short_sentiment(df: DataFrame, by=("symbol",), ts: str = "ts", top: str = "top_ratio", crowd: str = "global_ratio", taker: str = "taker_ratio") -> DataFrame:
    """Sentiment of the newest long/short ratios."""
    d = df.groupBy(*by).agg(F.max_by(F.struct(top, crowd, taker), ts).alias("x")).select(*by, "x.*")
    mood = lambda c: F.when(C(c) > 1.2, "BULLISH").when(C(c) < 0.8, "BEARISH").otherwise("NEUTRAL")
    return d.withColumns({"top_trader_sentiment": mood(top), "global_sentiment": mood(crowd),
                          "taker_pressure": F.when(C(taker) > 1.1, "BUY_PRESSURE").when(C(taker) < 0.9, "SELL_PRESSURE").otherwise("NEUTRAL")})


def basis_history(marks: DataFrame, by=("symbol",), ts: str = "ts", n: int | None = None) -> DataFrame:
    """Current and mean basis with range, annualized rate, label; ``n`` keeps the largest premiums."""
    basis = C("mark_price") - C("index_price")
    rate = ieee_div(basis, C("index_price"))
    d = marks.groupBy(*by).agg(
        F.max_by(basis, ts).alias("current_basis"), (F.max_by(rate, ts) * 100).alias("current_basis_rate_pct"), F.avg(basis).alias("avg_basis"),
        (F.avg(rate) * 100).alias("avg_basis_rate_pct"), F.max(basis).alias("max_basis"), F.min(basis).alias("min_basis"), F.count(F.lit(1)).alias("data_points"))
    d = d.withColumns({"annualized_rate_pct": C("current_basis_rate_pct") * 3 * 365,
                       "premium_discount": F.when(C("current_basis") > 0, "PREMIUM").when(C("current_basis") < 0, "DISCOUNT").otherwise("AT_PAR")})
    return d if n is None else d.orderBy(F.abs("current_basis_rate_pct").desc(), *by).limit(n)


def vol_index_summary(df: DataFrame, by=("symbol",), ts: str = "ts", close: str = "close", high: float = 80, low: float = 40) -> DataFrame:
    d = df.groupBy(*by).agg(F.max_by(close, ts).alias("current"), F.max(close).alias("period_high"), F.min(close).alias("period_low"),
                            F.avg(close).alias("average"), F.count(F.lit(1)).alias("data_points"))
    return d.withColumn("flag", F.when(C("current") > high, "HIGH_VOL").when(C("current") < low, "LOW_VOL").otherwise("NORMAL"))


def venue_signals(funding: DataFrame, sentiment: DataFrame, oi: DataFrame, options: DataFrame | None = None, vol: DataFrame | None = None,
                  by="symbol") -> DataFrame:
    """Rule hits of the venue reports as rows (symbol, type, signal, strength), with the overall sentiment."""
    d = funding.select(by, "current_rate").join(sentiment.select(by, "top_ratio"), by, "full").join(oi.select(by, "change_pct"), by, "full")
    for extra, col in ((options, "put_call_ratio"), (vol, "current")):
        d = d.join(extra.select(by, col), by, "left") if extra is not None else d.withColumn(col, F.lit(None).cast("double"))
    f, r, o, pc, dv = C("current_rate"), C("top_ratio"), C("change_pct"), C("put_call_ratio"), C("current")

    def hit(test, kind, name, strength):
        return F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(name).alias("signal"), F.lit(strength).alias("strength")))
    rules = F.array(hit(f > 0.001, "funding", "SHORT_BIAS", "STRONG"), hit(f < -0.001, "funding", "LONG_BIAS", "STRONG"),
                    hit(r > 2, "positioning", "CROWDED_LONG", "MODERATE"), hit(r < 0.5, "positioning", "CROWDED_SHORT", "MODERATE"),
                    hit(o > 10, "open_interest", "OI_INCREASING", "MODERATE"), hit(o < -10, "open_interest", "OI_DECREASING", "MODERATE"),
                    hit(pc > 1.2, "options", "BEARISH", "MODERATE"), hit((pc > 0) & (pc < 0.7), "options", "BULLISH", "MODERATE"),
                    hit(dv > 80, "volatility", "HIGH_VOL", "MODERATE"), hit(dv < 40, "volatility", "LOW_VOL", "MODERATE"))
    d = d.select(by, F.filter(rules, lambda x: x.isNotNull()).alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    longish = F.size(F.filter("s", lambda x: x["signal"].contains("LONG") | ~x["signal"].contains("SHORT_BIAS")))
    short = F.size(F.filter("s", lambda x: x["signal"].contains("SHORT")))
    mood = F.when(longish > n / 2, "BULLISH").when(short > n / 2, "BEARISH").otherwise("NEUTRAL")
    return d.select(by, mood.alias("overall_sentiment"), F.explode("s").alias("x")).select(by, "overall_sentiment", "x.*")


def market_snapshot(prices: DataFrame, trades: DataFrame, liquidations: DataFrame, hours: int, by=("symbol", "exchange"), ts: str = "ts", as_of=None) -> DataFrame:
    """Newest price of every venue next to the price, flow and liquidation summary of the last hours."""
    now = F.lit(as_of) if as_of is not None else prices.select(F.max(ts)).scalar()
    near = C(ts) >= now - F.expr(f"INTERVAL {hours} HOURS")
    last = prices.groupBy(*by).agg(F.max_by("mid_price", ts).alias("price"), F.max(ts).alias("last_update"))
    p = prices.where(near).groupBy(*by).agg(F.min("mid_price").alias("low"), F.max("mid_price").alias("high"), F.avg("mid_price").alias("average"))
    buy, sell = sum_if(C("side") == "buy", "quote_value"), sum_if(C("side") == "sell", "quote_value")
    t = trades.where(near).groupBy(*by).agg(buy.alias("buy_value"), sell.alias("sell_value"), safe_div(buy, sell, None).alias("buy_sell_ratio"))
    q = liquidations.where(near).groupBy(*by).agg(sum_if(C("side") == "long", "value_usd").alias("long_liquidated"),
                                                  sum_if(C("side") == "short", "value_usd").alias("short_liquidated"))
    k = list(by)
    d = last.join(p, k, "left").join(t, k, "left").join(q, k, "left")
    l, s = F.coalesce("long_liquidated", F.lit(0.0)), F.coalesce("short_liquidated", F.lit(0.0))
    return d.withColumns({
        "flow_signal": F.when(C("buy_sell_ratio") > 1.5, "STRONG_BUYING").when(C("buy_sell_ratio") < 0.67, "STRONG_SELLING").otherwise("BALANCED"),
        "market_state": F.when(l > s * 2, "BEARISH_CAPITULATION").when(s > l * 2, "BULLISH_SQUEEZE").otherwise("UNKNOWN")})
