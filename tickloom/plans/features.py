"""Stored feature jobs: raw streams to wide feature rows, all series in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import bucket, clip, depth_n, fold, imbalance, safe_corr, safe_div
from tickloom.operators.aggregates import count_if, sum_if
from tickloom.operators.joins import asof_many, exchange_pairs
from tickloom.operators.series import attach, bounded, plan_series
from tickloom.operators.windows import ewma, ewma_depth, latest_per, pct_rank_in, rows, time_sums, velocity, z_in

C = F.col
KEYS = ("symbol", "exchange")


def weighted_side(levels: Column, n: int = 5) -> tuple[Column, Column]:
    """(value, quantity) sums over the first n levels with weights 1, 1/2, 1/3, ..."""
    first = F.slice(levels, 1, n)
    w = F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: 1.0 / i)
    val = fold(F.zip_with(first, w, lambda x, k: x["price"] * x["qty"] * k), lambda a, x: a + x)
    qty = fold(F.zip_with(first, w, lambda x, k: x["qty"] * k), lambda a, x: a + x)
    return val, qty


def book_columns(bids: Column, asks: Column) -> dict[str, Column]:
    """Depth, imbalance and fair prices of one book (NULL prices where a side is empty)."""
    b5, a5, b10, a10 = depth_n(bids, 5), depth_n(asks, 5), depth_n(bids, 10), depth_n(asks, 10)
    (bv, bq), (av, aq) = weighted_side(bids), weighted_side(asks)
    b, a = F.get(bids, F.lit(0)), F.get(asks, F.lit(0))
    top = b["qty"] + a["qty"]
    return {
        "microprice": F.when(top > 0, (b["price"] * a["qty"] + a["price"] * b["qty"]) / top),
        "weighted_mid_price": F.when((bq > 0) & (aq > 0), (bv / bq + av / aq) / 2),
        "bid_depth_5": b5, "bid_depth_10": b10, "ask_depth_5": a5, "ask_depth_10": a10, "total_depth_10": b10 + a10,
        "depth_imbalance_5": imbalance(b5, a5), "depth_imbalance_10": imbalance(b10, a10),
        "weighted_imbalance": imbalance(bq, aq)}


def price_features(prices: DataFrame, books: DataFrame, by=("symbol",), ts: str = "ts", tie: str = "event_id",
                   steps=(60.0, 300.0)) -> DataFrame:
    """Per price update: quote, latest book depth and imbalance, and the change over two look-backs.

    Each book is reduced to its columns before the join; book and both earlier prices then come from
    one as-of pass.
    """
    mids = prices.select(*by, ts, tie, "mid_price")
    made = book_columns(C("bids"), C("asks"))
    slim = books.select(*by, ts, *[c for c in (tie,) if c in books.columns], *[v.alias(k) for k, v in made.items()])
    seen = asof_many(prices, {"book": (slim, 0.0), "p1": (mids, steps[0]), "p5": (mids, steps[1])}, by, ts, tie)
    mid = F.coalesce("mid_price", F.lit(0.0))
    bid, ask = F.coalesce("bid_price", F.lit(0.0)), F.coalesce("ask_price", F.lit(0.0))

    def change(name):
        old = C(f"{name}.mid_price")
        return F.coalesce(F.when(old > 0, (mid - old) / old * 100), F.lit(0.0))
    own = {"microprice": mid, "weighted_mid_price": mid}       # stand-ins for a book without sizes
    cols = {k: F.when(C("book.at").isNull(), 0.0).otherwise(F.coalesce(C(f"book.{k}"), own.get(k, F.lit(0.0)))) for k in made}
    return seen.withColumns({
        "last_price": mid, "spread": ask - bid, "spread_bps": F.when(mid > 0, (ask - bid) / mid * 10000).otherwise(0.0),
        **cols, "price_change_1m": change("p1"), "price_change_5m": change("p5")}).drop("book", "p1", "p5")


def _flow_sums(side: str = "side", qty: str = "quantity", value: str = "quote_value") -> dict[str, Column]:
    buy, sell = F.lower(side) == "buy", F.lower(side) == "sell"
    q = C(qty)
    return {"trade_count": F.lit(1), "volume": q, "quote_volume": C(value),
            "buy_volume": F.when(buy, q).otherwise(0.0), "sell_volume": F.when(sell, q).otherwise(0.0)}


def trade_features(trades: DataFrame, by=KEYS, ts: str = "ts", minutes=(1, 5, 15), as_of=None) -> DataFrame:
    """Twenty trade features of each key at ``as_of``: one scan of the longest window, two aggregations."""
    now = F.lit(as_of) if as_of is not None else trades.select(F.max(ts)).scalar()
    seen = trades.where(C(ts) >= now - F.expr(f"INTERVAL {minutes[2]} MINUTES")).withColumn("_now", now)
    within = [C(ts) >= C("_now") - F.expr(f"INTERVAL {m} MINUTES") for m in minutes]
    parts = _flow_sums()
    aggs = []
    for label, test in zip(("1m", "5m", "15m"), within):
        for name, x in parts.items():
            if label == "15m" and name not in ("buy_volume", "sell_volume"):
                continue
            aggs.append(F.coalesce(F.sum(F.when(test, x.cast("double"))), F.lit(0.0)).alias(f"{name}_{label}"))
        if label != "15m":
            aggs.append(F.coalesce(F.sum(F.when(test, C("price") * C("quantity"))), F.lit(0.0)).alias(f"_pq_{label}"))
    base = seen.groupBy(*by).agg(*aggs)
    for label in ("1m", "5m", "15m"):
        base = base.withColumn(f"cvd_{label}", C(f"buy_volume_{label}") - C(f"sell_volume_{label}"))
    for label in ("1m", "5m"):
        base = base.withColumns({f"volume_delta_{label}": C(f"cvd_{label}"),
                                 f"vwap_{label}": safe_div(C(f"_pq_{label}"), C(f"volume_{label}"))})
    base = base.withColumn("avg_trade_size", safe_div(C("volume_5m"), C("trade_count_5m"))).drop(
        "_pq_1m", "_pq_5m", "buy_volume_15m", "sell_volume_15m")
    big = (C("avg_trade_size") > 0) & (C("quantity") > 2 * C("avg_trade_size"))
    large = attach(seen, base.select(*by, "avg_trade_size"), by).groupBy(*by).agg(
        count_if(big).alias("large_trade_count"), sum_if(big, "quantity").alias("large_trade_volume"))
    return base.join(large, list(by))


def trade_features_rolling(trades: DataFrame, by=KEYS, ts: str = "ts", tie: str = "trade_id",
                           minutes=(1, 5, 15)) -> DataFrame:
    """The windowed sums of ``trade_features`` at every trade."""
    sums = {**_flow_sums(), "pq": C("price") * C("quantity")}
    out = time_sums(trades, by, ts, tie, sums, {l: m * 60.0 for l, m in zip(("1m", "5m", "15m"), minutes)})
    cols = {f"cvd_{l}": C(f"buy_volume_{l}") - C(f"sell_volume_{l}") for l in ("1m", "5m", "15m")}
    cols |= {f"vwap_{l}": safe_div(C(f"pq_{l}"), C(f"volume_{l}")) for l in ("1m", "5m")}
    cols["avg_trade_size"] = safe_div(C("volume_5m"), C("trade_count_5m"))
    return out.withColumns(cols).drop("pq_1m", "pq_5m", "pq_15m", "trade_count_15m", "volume_15m", "quote_volume_15m")


def sweep_flags(trades: DataFrame, by, order, side: str = "side", price: str = "price", qty: str = "quantity") -> DataFrame:
    """Last ten trades of a group: at least three prices on a side and more than 70 % one-sided volume."""
    w = Window.partitionBy(*by).orderBy(*[C(c).desc() for c in order])
    last = trades.withColumn("_r", F.row_number().over(w)).where(C("_r") <= 10)
    buy, sell = F.lower(side) == "buy", F.lower(side) == "sell"
    got = last.groupBy(*by).agg(
        F.countDistinct(F.when(buy, C(price))).alias("_bp"), F.countDistinct(F.when(sell, C(price))).alias("_sp"),
        sum_if(buy, qty).alias("_b"), sum_if(sell, qty).alias("_s"), F.count(F.lit(1)).alias("_n"))
    lop = safe_div(F.abs(C("_b") - C("_s")), C("_b") + C("_s"))
    return got.select(*by, ((C("_n") >= 5) & ((C("_bp") >= 3) | (C("_sp") >= 3)) & (lop > 0.7)).alias("sweep_detected"))


def iceberg_flags(trades: DataFrame, by, price: str = "price", qty: str = "quantity") -> DataFrame:
    """Some price with five or more trades of which 80 % lie within 20 % of their mean size."""
    sizes = trades.groupBy(*by, price, qty).agg(F.count(F.lit(1)).alias("_n"))     # equal sizes count once
    mean = (sizes.groupBy(*by, price).agg(F.sum("_n").alias("_all"), (F.sum(C(qty) * C("_n")) / F.sum("_n")).alias("_avg"))
            .where(C("_all") >= 5))
    near = C(qty).between(0.8 * C("_avg"), 1.2 * C("_avg"))
    per = attach(sizes, mean, [*by, price]).groupBy(*by, price).agg(
        (F.sum(F.when(near, C("_n")).otherwise(0)) / F.max("_all") >= 0.8).alias("_hit"))
    return per.groupBy(*by).agg(F.max("_hit").alias("iceberg_detected"))


def flow_features(trades: DataFrame, books: DataFrame, every: str = "5 minutes", by=("symbol",), ts: str = "ts",
                  tie: str = "trade_id", side: str = "side", qty: str = "quantity", price: str = "price",
                  maker: str = "is_buyer_maker") -> DataFrame:
    """Flow ratios, aggression, toxicity, absorption, sweep and iceberg flags per key and time bucket."""
    t = trades.withColumn("bucket", bucket(ts, every))
    key = [*by, "bucket"]
    buy, sell = F.lower(side) == "buy", F.lower(side) == "sell"
    taker_buy = F.when(C(maker).isNotNull(), ~C(maker)).otherwise(buy)
    order = F.struct(ts, tie)
    base = t.groupBy(*key).agg(
        sum_if(buy, qty).alias("_b"), sum_if(sell, qty).alias("_s"), F.avg(qty).alias("_avg"),
        sum_if(taker_buy, qty).alias("aggressive_buy_volume"), sum_if(~taker_buy, qty).alias("aggressive_sell_volume"),
        F.min_by(price, order).alias("_p0"), F.max_by(price, order).alias("_p1"), F.count(F.lit(1)).alias("_n"),
        F.max(ts).alias(ts), F.max(tie).alias("event_id"))
    # sizes are counted per (bucket, size) before the mean is joined back
    sized = t.groupBy(*key, qty).agg(F.count(F.lit(1)).alias("_k"))
    big = sized.join(base.select(*key, "_avg"), key).groupBy(*key).agg(
        F.sum(F.when(C(qty) > 2 * C("_avg"), C(qty) * C("_k")).otherwise(0.0)).alias("_large"))
    flags = sweep_flags(t, key, [ts, tie]).join(iceberg_flags(t, key), key, "left")
    wide = base.join(big, key).join(flags, key)
    depth5 = books.select(*by, ts, *[c for c in ("event_id",) if c in books.columns],
                          (depth_n(C("bids"), 5) + depth_n(C("asks"), 5)).alias("depth"))
    seen = asof_many(wide, {"book": (depth5, 0.0)}, by, ts)
    depth = C("book.depth")
    b, s = C("_b"), C("_s")
    net = safe_div(b - s, b + s)
    return seen.select(
        *key, F.when(s > 0, F.least(b / s, F.lit(10.0))).when(b > 0, 10.0).otherwise(0.0).alias("buy_sell_ratio"),
        safe_div(b, b + s).alias("taker_buy_ratio"), safe_div(s, b + s).alias("taker_sell_ratio"),
        "aggressive_buy_volume", "aggressive_sell_volume",
        (C("aggressive_buy_volume") - C("aggressive_sell_volume")).alias("net_aggressive_flow"),
        net.alias("flow_imbalance"), F.abs(net).alias("flow_toxicity"),
        F.coalesce(F.least(F.lit(1.0), safe_div(C("_large"), depth)), F.lit(0.0)).alias("absorption_ratio"),
        "sweep_detected", F.coalesce("iceberg_detected", F.lit(False)).alias("iceberg_detected"),
        F.when((C("_n") >= 2) & (C("_p0") != 0), (C("_p1") - C("_p0")) / C("_p0") * 100 * net).otherwise(0.0)
        .alias("momentum_flow"))


def next_funding(ts: str, hours: int = 8) -> Column:
    """The next multiple of ``hours`` after ts within its day."""
    day = F.date_trunc("day", ts)
    step = F.floor(F.hour(ts) / hours) + 1
    return F.timestamp_add("HOUR", (step * hours).cast("int"), day).cast("timestamp_ntz")


def funding_features(fr: DataFrame, by=KEYS, ts: str = "ts", tie: str = "event_id", rate: str = "funding_rate") -> DataFrame:
    """Averages over 8 h, 24 h and 7 d, change, z-score over the last 100 updates, premium over the week."""
    hours = {"8h": 8, "24h": 24, "7d": 168}
    s = time_sums(fr.select(*by, ts, tie, rate), by, ts, tie, {"s": C(rate), "n": F.lit(1)},
                  {k: h * 3600.0 for k, h in hours.items()})
    s = s.withColumns({f"funding_rate_{k}_avg": C(f"s_{k}") / C(f"n_{k}") for k in hours}).drop(
        *[f"{x}_{k}" for x in "sn" for k in hours])
    plan = plan_series(s, by, [ts, tie], depth=100)

    def body(d, p):
        return d.withColumns({"funding_rate_change": C(rate) - F.lag(rate).over(p.window()),
                              "funding_rate_zscore": z_in(C(rate), rows(p, 100))})
    return bounded(s, plan, 100, body).withColumns({
        "funding_rate_pct": C(rate) * 100, "annualized_rate": C(rate) * 3 * 365,
        "funding_premium": C(rate) - C("funding_rate_7d_avg"), "next_funding_time": next_funding(ts)})


def neg_corr(x: str, y: str, w, least: int) -> Column:
    """Minus the correlation over a frame; 0 without spread or with too few rows."""
    return F.when(F.count(F.lit(1)).over(w) >= least, F.coalesce(-safe_corr(C(x), C(y), w), F.lit(0.0))).otherwise(0.0)


def oi_features(oi: DataFrame, ticker: DataFrame, by=KEYS, ts: str = "ts", tie: str = "event_id",
                value: str = "open_interest", price: str = "price") -> DataFrame:
    """Changes against 1 h, 4 h and 24 h ago, step change, momentum, divergence from price, leverage."""
    own = oi.select(*by, ts, tie, value)
    vol = ticker.select(*by, ts, tie, "volume_24h")
    seen = asof_many(oi, {"h1": (own, 3600.0), "h4": (own, 14400.0), "h24": (own, 86400.0), "tick": (vol, 0.0)}, by, ts, tie)
    cols = {"open_interest_usd": C(value) * C(price)}
    for h in ("1h", "4h", "24h"):
        old = C(f"h{h[:-1]}.{value}")
        cols[f"oi_change_{h}"] = C(value) - old
        if h != "4h":
            cols[f"oi_change_pct_{h}"] = F.when(old != 0, (C(value) - old) / old * 100)
    cols["leverage_ratio"] = F.when(C("tick.volume_24h") > 0, C(value) / C("tick.volume_24h"))
    flat = seen.withColumns(cols).drop("h1", "h4", "h24", "tick")
    plan = plan_series(flat, by, [ts, tie], depth=12)

    def body(d, p):
        return d.withColumns({"oi_delta": C(value) - F.lag(value).over(p.window()),
                              "oi_momentum": velocity(value, p, 10),
                              "oi_price_divergence": neg_corr(value, price, rows(p, 10), 10)})
    return bounded(flat, plan, 12, body)


def volatility_features(candles: DataFrame, by=("symbol",), ts: str = "open_time",
                        bars={"1m": 2, "5m": 5, "15m": 15, "1h": 60, "24h": 100}, history: int = 100) -> DataFrame:
    """Rolling deviations of returns and range estimators on OHLC bars (``bars`` = bars per horizon)."""
    longest = max(bars.values())
    plan = plan_series(candles, by, [ts], depth=longest + history + 2)

    def body(d, p):
        prev = F.lag("close").over(p.window())
        d = d.withColumns({
            "_r": F.when(prev > 0, C("close") / prev - 1),
            "_hl": F.log(C("high") / C("low")), "_co": F.log(C("close") / C("open")),
            "_tr": F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev))})
        d = d.withColumns({f"volatility_{k}": F.coalesce(F.stddev_samp("_r").over(rows(p, n)), F.lit(0.0))
                           for k, n in bars.items()})
        w, base = rows(p, bars["1h"]), rows(p, history)
        d = d.withColumns({
            "realized_volatility": F.sqrt(F.coalesce(F.sum(C("_r") * C("_r")).over(w), F.lit(0.0))),
            "garman_klass_vol": F.sqrt(F.greatest(F.lit(0.0), F.avg(
                0.5 * C("_hl") * C("_hl") - (2 * math.log(2) - 1) * C("_co") * C("_co")).over(w))),
            "parkinson_vol": F.sqrt(F.avg(C("_hl") * C("_hl")).over(w) / (4 * math.log(2))),
            "atr_14": F.avg("_tr").over(rows(p, 14)),
            "volatility_percentile": pct_rank_in("volatility_15m", base),
            "volatility_zscore": z_in(C("volatility_15m"), base)})
        return d.drop("_r", "_hl", "_co", "_tr")
    pct = C("volatility_percentile")
    return bounded(candles, plan, longest + history + 2, body).withColumn(
        "volatility_regime", F.when(pct >= 67, "HIGH").when(pct >= 33, "MEDIUM").otherwise("LOW"))


def momentum_features(candles: DataFrame, by=("symbol",), ts: str = "open_time",
                      bars={"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "24h": 1440}) -> DataFrame:
    """Returns over several horizons, RSI, MACD(12, 26, 9), stochastic, Williams %R, CCI(20) and ROC(12)."""
    depth = max(max(bars.values()), 40) + 1
    plan = plan_series(candles, by, [ts], depth=max(depth, ewma_depth([12, 26, 9])))     # one plan for all passes

    def body(d, p):
        w = p.window()

        def back(n):
            old = F.lag("close", n).over(w)
            return F.when(old > 0, (C("close") / old - 1) * 100)
        f14, f15, f20 = rows(p, 14), rows(p, 15), rows(p, 20)
        ch = C("close") - F.lag("close").over(w)
        d = d.withColumns({"_g": F.when(ch > 0, ch).when(ch.isNotNull(), 0.0),
                           "_l": F.when(ch < 0, -ch).when(ch.isNotNull(), 0.0),
                           "_tp": (C("high") + C("low") + C("close")) / 3,
                           "_ll": F.min("low").over(f14), "_hh": F.max("high").over(f14)})
        gain, loss = F.avg("_g").over(f15), F.avg("_l").over(f15)
        span = C("_hh") - C("_ll")
        d = d.withColumns({**{f"momentum_{k}": back(n) for k, n in bars.items()},
                           "rsi_14": F.when(loss > 0, 100 - 100 / (1 + gain / loss)),
                           "stoch_k": F.when(span > 0, (C("close") - C("_ll")) / span * 100).otherwise(50.0),
                           "williams_r": F.when(span > 0, (C("_hh") - C("close")) / span * -100).otherwise(-50.0),
                           "roc": back(12), "_tps": F.collect_list("_tp").over(f20)})
        mean = fold(C("_tps"), lambda a, x: a + x) / F.size("_tps")
        dev = fold(C("_tps"), lambda a, x: a + F.abs(x - mean)) / F.size("_tps")
        d = d.withColumns({"stoch_d": F.avg("stoch_k").over(rows(p, 3)),
                           "cci": F.when(dev > 1e-12, (C("_tp") - mean) / (0.015 * dev)).otherwise(0.0),
                           "rsi_divergence": neg_corr("rsi_14", "close", f14, 14)})
        return d.drop("_g", "_l", "_tp", "_ll", "_hh", "_tps")
    out = bounded(candles, plan, depth, body)
    out = ewma(out, by, [ts], {"_fast": ("close", 12), "_slow": ("close", 26)}, plan=plan)
    out = ewma(out.withColumn("macd_line", C("_fast") - C("_slow")), by, [ts], {"macd_signal": ("macd_line", 9)}, plan=plan)
    return out.withColumn("macd_histogram", C("macd_line") - C("macd_signal")).drop("_fast", "_slow")


# Weights of the six partial signals.
SIGNAL_WEIGHTS = {"trend_signal": 0.25, "momentum_signal": 0.20, "flow_signal": 0.20, "funding_signal": 0.15,
                  "oi_signal": 0.10, "volatility_signal": 0.10}


def signals(features: DataFrame) -> DataFrame:
    """Six signals in [-1, 1], their weighted mean, agreement, regime and bias.

    Reads price_change_5m, rsi_14, flow_imbalance, funding_zscore, oi_change_pct and volatility_zscore;
    missing inputs drop out and the weights are re-normalized.
    """
    parts = {
        "trend_signal": clip(C("price_change_5m") / 5, -1.0, 1.0),
        "momentum_signal": clip((C("rsi_14") - 50) / 50, -1.0, 1.0),
        "flow_signal": clip(C("flow_imbalance"), -1.0, 1.0),
        "funding_signal": clip(-C("funding_zscore") / 3, -1.0, 1.0),
        "oi_signal": clip(C("oi_change_pct") / 10, -1.0, 1.0) * F.signum("price_change_5m"),
        "volatility_signal": clip(-C("volatility_zscore") / 3, -1.0, 1.0)}
    # greatest/least skip NULL, so a missing input must be masked by hand
    need = {"trend_signal": "price_change_5m", "momentum_signal": "rsi_14", "flow_signal": "flow_imbalance",
            "funding_signal": "funding_zscore", "oi_signal": "oi_change_pct", "volatility_signal": "volatility_zscore"}
    df = features.withColumns({k: F.when(C(need[k]).isNotNull(), v) for k, v in parts.items()})
    total = sum((F.coalesce(C(k), F.lit(0.0)) * w for k, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(C(k).isNotNull(), w).otherwise(0.0) for k, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    signs = sum((F.coalesce(F.signum(k), F.lit(0.0)) for k in SIGNAL_WEIGHTS), F.lit(0.0))
    used = sum((F.when(C(k) != 0, 1.0).otherwise(0.0) for k in SIGNAL_WEIGHTS), F.lit(0.0))
    df = df.withColumns({"composite_score": safe_div(total, weight), "signal_confidence": safe_div(F.abs(signs), used)})
    return df.withColumns({
        "market_regime": F.when(C("volatility_zscore") > 2, "VOLATILE").when(C("trend_signal") > 0.3, "TRENDING_UP")
                          .when(C("trend_signal") < -0.3, "TRENDING_DOWN").otherwise("RANGING"),
        "bias": F.when(C("composite_score") > 0.2, "LONG").when(C("composite_score") < -0.2, "SHORT").otherwise("NEUTRAL")})


def cross_exchange_features(prices: DataFrame, funding: DataFrame, trades: DataFrame, oi: DataFrame,
                            venues: list[str], every: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Spreads, shares and flow disagreement of the venues of one symbol per bucket.

    Each stream is first reduced to one row per (symbol, bucket, venue); the venue list is fixed, so
    the pivots are plain conditional aggregations.
    """
    b = bucket(ts, every).alias("bucket")
    key = ["symbol", "bucket"]
    first, rest = venues[0], venues[1:]

    def per(df, *aggs):
        return df.groupBy("symbol", b, "exchange").agg(*aggs)
    p = per(prices, F.max_by("mid_price", ts).alias("price"))
    at = {v: F.max(F.when(C("exchange") == v, C("price"))) for v in venues}
    lo, hi = F.min("price"), F.max("price")
    price = p.groupBy(*key).agg(
        *[((at[v] - at[first]) / at[first] * 100).alias(f"{first}_{v}_spread") for v in rest],
        ((hi - lo) / lo * 100).alias("max_price_spread"), F.count(F.lit(1)).alias("venues"),
        ((hi - lo) / lo * 100 > 0.1).alias("arbitrage_opportunity"))
    pairs = (exchange_pairs(p, key, ordered=False).groupBy(*key)
             .agg(F.avg(F.abs(C("price_b") - C("price_a")) / F.least("price_a", "price_b") * 100).alias("avg_price_spread")))
    f = per(funding, F.max_by("funding_rate", ts).alias("rate"))
    fund = f.groupBy(*key).agg((F.max("rate") - F.min("rate")).alias("funding_spread_max"),
                               (F.max("rate") - F.avg("rate")).alias("funding_spread_avg"))
    signed = F.when(C("side") == "buy", C("quote_value")).otherwise(-C("quote_value"))
    t = per(trades, F.sum("quote_value").alias("v"), F.sum(signed).alias("net"))
    vol = F.sum("v")
    flow = t.groupBy(*key).agg(
        *[safe_div(sum_if(C("exchange") == v, "v"), vol).alias(f"{v}_volume_share") for v in venues],
        (1 - F.abs(F.sum(F.signum("net"))) / F.count(F.lit(1))).alias("exchange_flow_divergence"))
    o = per(oi, F.max_by("open_interest", ts).alias("v"))
    share = o.groupBy(*key).agg(*[safe_div(sum_if(C("exchange") == v, "v"), F.sum("v")).alias(f"{v}_oi_share")
                                  for v in venues])
    return (price.join(pairs, key, "left").join(fund, key, "left").join(flow, key, "left").join(share, key, "left"))


def lead_lag_score(pairs: DataFrame) -> DataFrame:
    """Per symbol, the leader with the largest mean gain of lagged over simultaneous correlation (input: J10)."""
    zero = F.max(F.when(C("lag") == 0, F.abs("corr")))
    later = F.max(F.when(C("lag") > 0, F.abs("corr")))
    gain = pairs.groupBy("symbol", "leader", "follower").agg((later - zero).alias("gain"))
    per = gain.groupBy("symbol", "leader").agg(F.avg("gain").alias("lead_lag_score"))
    return per.groupBy("symbol").agg(F.max_by("leader", F.struct("lead_lag_score", "leader")).alias("leader"),
                                     F.max("lead_lag_score").alias("lead_lag_score"))


def feature_history(features: DataFrame, columns: list[str], hours: int, ts: str = "ts", as_of=None) -> DataFrame:
    from tickloom.functions.columns import lookback
    return lookback(features, ts, f"{hours} HOURS", as_of).select("symbol", "exchange", ts, *columns)


def latest_features(features: DataFrame, symbols: list[str], ts: str = "ts") -> DataFrame:
    return latest_per(features.where(C("symbol").isin(*symbols)), ["symbol", "exchange"], ts)


def feature_status(tables: dict[str, DataFrame], fresh_s: float = 300, ts: str = "ts", as_of=None) -> DataFrame:
    """Rows, newest time and freshness of each feature category."""
    from functools import reduce
    parts = []
    for name, df in tables.items():
        agg = df.agg(F.count(F.lit(1)).alias("row_count"), F.max(ts).alias("last_record"))
        parts.append(agg.withColumn("category", F.lit(name)))
    out = reduce(DataFrame.unionByName, parts)
    now = F.lit(as_of) if as_of is not None else out.select(F.max("last_record")).scalar()
    age = F.timestamp_diff("SECOND", C("last_record"), now)
    return out.withColumn("age_seconds", age).withColumn(
        "status", F.when(C("row_count") == 0, "empty").when(C("age_seconds") > fresh_s, "stale").otherwise("fresh"))
