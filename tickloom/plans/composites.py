"""Composite trading signals over the newest features of every stream, and their aggregation.

Input rows hold one struct column per stream (``joins.feature_cache``): prices, orderbook, trades,
funding, oi, liquidations, mark_prices, ticker. A stream or field may be missing; each signal is a
struct ``(value, confidence, components, <labels>)``, NULL when too few components are known.
"""

from __future__ import annotations

from collections.abc import Generator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import clip, safe_div
from tickloom.operators.series import bounded, plan_series, running
from tickloom.operators.windows import rows

C = F.col
Signal = Generator[dict[str, Column], dict[str, Column], Column]


# The fields that signals read, by stream. ``market_features`` produces all of them.
FIELDS = {
    "prices": "hurst_exponent mid_zscore price_efficiency price_vs_vwap spread_bps spread_compression_velocity spread_zscore",
    "orderbook": "absorption_ratio add_cancel_ratio ask_depth_10 ask_wall_detected bid_depth_10 bid_wall_detected depth_imbalance_10 depth_imbalance_5 "
                 "liquidity_gradient liquidity_persistence_score pull_wall_detected push_wall_detected spread",
    "trades": "aggressive_delta aggressive_ratio buy_pressure cvd_price_divergence cvd_slope flow_toxicity iceberg_detected sell_pressure sweep_detected "
              "trade_clustering_index whale_trade_detected whale_volume_ratio",
    "funding": "funding_carry_yield funding_momentum funding_percentile funding_regime funding_regime_score funding_zscore",
    "oi": "leverage_index leverage_zscore liquidation_cascade_risk long_short_ratio oi_delta_pct oi_price_correlation position_crowding_score position_intent "
          "position_intent_score",
    "liquidations": "cascade_acceleration cascade_probability exhaustion_signal liquidation_cluster_detected liquidation_imbalance",
    "mark_prices": "annualized_basis basis_zscore dislocation_detected mark_price",
    "ticker": "institutional_interest_idx market_strength price_change_pct range_vs_atr relative_volume_percentile volatility_compression_idx "
              "volatility_expansion_idx volume"}
FIELDS = {k: v.split() for k, v in FIELDS.items()}


def market_features(streams: dict[str, DataFrame], by=("symbol",), every: str = "1 minute", venues: list[str] = (), cluster_ms: int = 500,
                    ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The calculators of all given raw streams, and at every update the newest features of each: what ``all_signals`` reads.

    ``streams`` may hold prices, orderbook, trades, funding, oi, liquidations, mark_prices and ticker. Batches of trades and
    liquidations are known when their bucket ends.
    """
    from tickloom.operators.joins import feature_cache
    from tickloom.plans import institutional as I
    order, keys = (ts, tie), list(by)

    def batched(df: DataFrame) -> DataFrame:
        n, unit = every.split()
        return df.withColumns({ts: C("bucket") + F.expr(f"INTERVAL {n} {unit}"), tie: F.lit(0).cast("long")})

    makers = {"prices": lambda d: I.inst_prices(d, keys, order), "orderbook": lambda d: I.inst_orderbook(d, keys, order),
              "trades": lambda d: batched(I.inst_trades(d, every, keys, ts)), "funding": lambda d: I.inst_funding(d, list(venues), keys, order),
              "oi": lambda d: I.inst_oi(d, keys, order), "liquidations": lambda d: batched(I.inst_liquidations(d, every, keys, ts, tie, cluster_ms)),
              "mark_prices": lambda d: I.inst_mark(d, keys, order), "ticker": lambda d: I.inst_ticker(d, keys, order)}
    made = {name: makers[name](df).select(*keys, ts, F.col(tie).cast("long").alias(tie), *FIELDS[name]) for name, df in streams.items()}
    seen = feature_cache(made, keys, ts, tie)
    # streams that update at one time and tie are one update: the row that has seen them all
    rank = F.array_position(F.array(*map(F.lit, made)), C("updated"))
    newest = F.row_number().over(Window.partitionBy(*keys, ts, tie).orderBy(rank.desc()))
    return seen.withColumn("_k", newest).where("_k = 1").drop("_k")


class Feed:
    """Access to stream fields, with a default where stream, field or value is missing; a field that no schema declares is an error.

    A signal is a generator: it yields expressions it uses several times, gets them back as columns,
    and returns its struct. ``finish`` runs the signals side by side, one projection per step for all
    of them, so every expression is computed once and the plan stays shallow.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.fields = {f.name: set(f.dataType.fieldNames()) for f in df.schema.fields
                       if isinstance(f.dataType, T.StructType)}

    def __call__(self, name: str, default=None) -> Column:
        stream, field = name.split(".")
        if field not in FIELDS[stream]:
            raise KeyError(f"no calculator produces {name}")
        has = field in self.fields.get(stream, ())
        if default is None:
            return C(name) if has else F.lit(None).cast("double")
        return F.coalesce(C(name), F.lit(default)) if has else F.lit(default)

    def finish(self, **signals) -> DataFrame:
        df, made, done = self.df, [], {}
        replies = dict.fromkeys(signals)
        while replies:
            layer, answers = {}, {}
            for name, reply in replies.items():
                try:
                    asked = signals[name].send(reply)
                except StopIteration as end:
                    done[name] = end.value
                    continue
                names = {k: f"_{name}_{len(made)}_{k}" for k in asked}
                layer |= {names[k]: c for k, c in asked.items()}
                answers[name] = {k: C(n) for k, n in names.items()}
            df = df.withColumns(layer) if layer else df
            made += layer
            replies = answers
        return df.withColumns(done).drop(*made)


def up_to_one(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), x))


def at_least_zero(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def flag(test: Column, points: float) -> Column:
    return F.when(test, points).otherwise(0.0)


def known(parts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(p.isNotNull(), 1).otherwise(0) for p in parts.values()])


def blend(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the known parts (equal weights by default)."""
    w = {k: (weights or {}).get(k, 1.0) for k in parts}
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) * w[k] for k, p in parts.items()])
    weight = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), w[k]).otherwise(0.0) for k, p in parts.items()])
    return safe_div(total, weight)


def signal(value: Column, parts: dict[str, Column], least: int, of: int = 4, counted: dict | None = None,
           **labels: Column) -> Column:
    n = known(counted or parts)
    body = F.struct(value.alias("value"), (n / of).alias("confidence"),
                    F.struct(*[p.alias(k) for k, p in parts.items()]).alias("components"),
                    *[v.alias(k) for k, v in labels.items()])
    return F.when(n >= least, body)


# Component weights.
SMART_MONEY = {"orderbook_absorption": 0.25, "whale_activity": 0.30, "flow_toxicity": 0.20, "cvd_divergence": 0.25}
SQUEEZE = {"funding_extreme": 0.30, "oi_leverage": 0.25, "crowding": 0.25, "price_compression": 0.20}
MARKET_MAKER = {"wall_activity": 0.30, "spread_manipulation": 0.25, "quote_stuffing": 0.25, "inventory_signal": 0.20}
CASCADE = {"liquidation_cluster": 0.35, "leverage_stress": 0.30, "thin_liquidity": 0.20, "funding_pressure": 0.15}


def smart_money_index(f: Feed) -> Signal:
    parts = {"orderbook_absorption": up_to_one(f("orderbook.absorption_ratio")),
             "whale_activity": up_to_one(f("trades.whale_volume_ratio", 0.0) * 2 + flag(f("trades.whale_trade_detected", False), 0.3)),
             "flow_toxicity": f("trades.flow_toxicity"), "cvd_divergence": F.abs(f("trades.cvd_price_divergence"))}
    parts = yield parts
    return signal(blend(parts, SMART_MONEY), parts, 2)


def squeeze_probability(f: Feed) -> Signal:
    parts = {"funding_extreme": up_to_one(F.abs(f("funding.funding_zscore")) / 3),
             "oi_leverage": up_to_one(F.abs(f("oi.leverage_zscore")) / 2),
             "crowding": f("oi.position_crowding_score"),
             "price_compression": at_least_zero(-f("prices.spread_zscore") / 2)}
    parts = yield parts
    return signal(up_to_one(blend(parts, SQUEEZE)), parts, 2)


def stop_hunt_probability(f: Feed) -> Signal:
    wall = flag(f("orderbook.pull_wall_detected", False), 0.5) + flag(f("orderbook.push_wall_detected", False), 0.3)
    parts = {"wall_manipulation": F.when(wall > 0, wall),
             "spoofing_indicator": at_least_zero(1 - f("orderbook.add_cancel_ratio")),
             "efficiency_degradation": at_least_zero(1 - f("prices.price_efficiency")),
             "sweep_detected": F.when(f("trades.sweep_detected", False), 0.8)}
    parts = yield parts
    return signal(up_to_one(blend(parts)), parts, 1)


def momentum_quality(f: Feed) -> Signal:
    parts = {"cvd_confirmation": 0.5 + clip(f("trades.cvd_slope") * 10, -0.5, 0.5),
             "oi_confirmation": 0.5 + f("oi.position_intent_score") * 0.5,
             "funding_alignment": 0.5 + f("funding.funding_regime_score") * 0.25,
             "orderbook_support": 0.5 + f("orderbook.depth_imbalance_5") * 0.5}
    parts = yield parts
    return signal(clip(blend(parts), 0.0, 1.0), parts, 2)


def composite_risk(f: Feed, squeeze: Column, stop_hunt: Column) -> Signal:
    """``squeeze`` and ``stop_hunt`` are the newest values of those signals."""
    parts = {"cascade_risk": f("oi.liquidation_cascade_risk"), "squeeze_risk": squeeze, "stop_hunt_risk": stop_hunt,
             "volatility_regime": F.abs(f("prices.hurst_exponent") - 0.5) * 2}
    parts = yield parts
    return signal(clip(blend(parts), 0.0, 1.0), parts, 1)


def market_maker_activity(f: Feed) -> Signal:
    moved = f("orderbook.pull_wall_detected", False) | f("orderbook.push_wall_detected", False)
    stands = f("orderbook.bid_wall_detected", False) | f("orderbook.ask_wall_detected", False)
    wall = flag(moved, 0.4) + flag(stands, 0.3)
    d5, d10 = f("orderbook.depth_imbalance_5", 0.0), f("orderbook.depth_imbalance_10", 0.0)
    parts = {"wall_activity": F.when(wall > 0, up_to_one(wall)),
             "spread_manipulation": up_to_one(F.abs(f("prices.spread_zscore")) * 0.3
                                              + F.abs(f("prices.spread_compression_velocity", 0.0)) * 0.5),
             "quote_stuffing": at_least_zero(1 - f("orderbook.add_cancel_ratio")),
             "inventory_signal": F.when((d5 != 0) | (d10 != 0), up_to_one(F.abs(d5 - d10) * 2))}
    parts = yield parts
    v = (yield {"v": blend(parts, MARKET_MAKER)})["v"]
    return signal(up_to_one(v), parts, 2,
                  activity_type=F.when(v > 0.7, "aggressive").when(v > 0.3, "passive").otherwise("neutral"),
                  inventory_bias=F.when(d5 > 0.2, "long").when(d5 < -0.2, "short").otherwise("balanced"))


def cascade_risk(f: Feed) -> Signal:
    cluster, prob = f("liquidations.liquidation_cluster_detected", False), f("liquidations.cascade_probability", 0.0)
    lev, levz = f("oi.leverage_index", 1.0), f("oi.leverage_zscore", 0.0)
    keep, imb = f("orderbook.liquidity_persistence_score", 0.5), F.abs(f("orderbook.depth_imbalance_10", 0.0))
    fz, odd = F.abs(f("funding.funding_zscore", 0.0)), f("funding.funding_regime", "neutral") != "neutral"
    parts = {
        "liquidation_cluster": F.when((prob > 0) | cluster, up_to_one(
            prob * 0.6 + flag(cluster, 0.3) + F.least(F.lit(0.4), f("liquidations.cascade_acceleration", 0.0)))),
        "leverage_stress": F.when((lev > 1) | (levz != 0), up_to_one(
            (lev - 1) * 0.5 + F.abs(levz) * 0.3 + f("oi.liquidation_cascade_risk", 0.0) * 0.5)),
        "thin_liquidity": F.when((keep < 0.5) | (imb > 0.3), up_to_one((1 - keep) * 0.5 + imb)),
        "funding_pressure": F.when((fz > 1) | odd, up_to_one(fz / 3 + flag(odd, 0.3)))}
    parts = yield parts
    v = (yield {"v": blend(parts, CASCADE)})["v"]
    liq = f("liquidations.liquidation_imbalance", 0.0)
    return signal(up_to_one(v), parts, 2,
                  severity=F.when(v >= 0.8, "CRITICAL").when(v >= 0.6, "HIGH").when(v >= 0.4, "MEDIUM").otherwise("LOW"),
                  direction=F.when(liq > 0.3, "long").when(liq < -0.3, "short").otherwise("both"),
                  estimated_trigger_move_pct=v * 5)


def _two_sides(votes: list[tuple[Column, Column, Column, float]]) -> tuple[Column, Column]:
    """Sum scores on two sides; each vote is (goes left, goes right, score, weight), NULL scores count 0."""
    def side(i):
        return reduce(lambda a, b: a + b, [
            F.when(F.coalesce(v[i], F.lit(False)), F.coalesce(v[2], F.lit(0.0)) * v[3]).otherwise(0.0) for v in votes])
    return side(0), side(1)


def institutional_phase(f: Feed) -> Signal:
    whale, ratio, berg = f("trades.whale_trade_detected", False), f("trades.whale_volume_ratio", 0.0), f("trades.iceberg_detected", False)
    raw_whale = F.when(whale | (ratio > 0.1) | berg, ratio * 2 + flag(whale, 0.3) + flag(berg, 0.4))
    absorb = f("orderbook.absorption_ratio", 0.0)
    raw_absorb = F.when(absorb > 0, absorb)
    delta, intent = F.abs(f("oi.oi_delta_pct", 0.0)), f("oi.position_intent", "neutral")
    oi = F.when(delta > 0.5, up_to_one(delta / 5))
    dev = f("prices.price_vs_vwap") / 100
    vwap = up_to_one(F.abs(dev) * 10)
    parts = {"whale_activity": up_to_one(raw_whale), "absorption_pattern": up_to_one(raw_absorb), "oi_building": oi, "vwap_signal": vwap}
    parts = yield parts
    rising, imb = f("trades.cvd_slope", 0.0) > 0, f("orderbook.depth_imbalance_5", 0.0)
    acc, dist = (yield dict(zip(("left", "right"), _two_sides([
        (rising, ~rising, raw_whale, 0.5), (imb > 0.1, imb < -0.1, raw_absorb, 0.4),
        (intent.isin("long_accumulation", "short_covering", "short_liquidation"),
         intent.isin("short_accumulation", "long_liquidation"), oi, 0.4),
        (dev < 0, dev >= 0, vwap, 0.3)])))).values()
    total = acc + dist
    phase = (F.when(total == 0, "NEUTRAL").when(acc > dist * 1.5, "ACCUMULATION").when(dist > acc * 1.5, "DISTRIBUTION")
             .otherwise("NEUTRAL"))
    strength = (F.when(total == 0, 0.0).when(acc > dist * 1.5, acc / (total + 0.001))
                .when(dist > acc * 1.5, dist / (total + 0.001)).otherwise(0.3))
    target = F.when(phase == "ACCUMULATION", "higher").when(phase == "DISTRIBUTION", "lower").otherwise("neutral")
    return signal(up_to_one(F.greatest(acc, dist)), parts, 2, phase=phase, intensity=strength, price_target_direction=target)


def volatility_breakout(f: Feed) -> Signal:
    comp, ratio = f("ticker.volatility_compression_idx", 0.0), f("ticker.range_vs_atr", 1.0)
    grad, keep = f("orderbook.liquidity_gradient", 1.0), f("orderbook.liquidity_persistence_score", 0.5)
    fz, clus = f("funding.funding_zscore", 0.0), f("trades.trade_clustering_index", 0.0)
    stressed, packed = F.abs(fz) > 1, clus > 0.5
    parts = {"volatility_compression": F.when((comp > 0) | (ratio < 0.8), up_to_one(comp + F.greatest(F.lit(0.0), 1 - ratio))),
             "liquidity_thinning": F.when((grad > 1.2) | (keep < 0.4), up_to_one((grad - 1) * 0.5 + (1 - keep) * 0.5)),
             "funding_stress": F.when(stressed, up_to_one(F.abs(fz) / 3)),
             "trade_concentration": F.when(packed, up_to_one(clus))}
    parts = yield parts
    v = (yield {"v": blend(parts)})["v"]
    lean = (F.when(stressed, -fz * 0.3).otherwise(0.0)
            + F.when(packed, f("trades.cvd_slope", 0.0) * 2 + f("trades.aggressive_delta", 0.0) * 0.5).otherwise(0.0)
            + f("oi.oi_delta_pct", 0.0) * 0.3)
    return signal(up_to_one(v), parts, 2, direction=F.when(lean > 0.3, "UP").when(lean < -0.3, "DOWN").otherwise("NEUTRAL"),
                  expected_magnitude_pct=v * 3, timeframe_hours=F.when(v > 0.7, 4).when(v > 0.5, 12).otherwise(24))


def mean_reversion(f: Feed) -> Signal:
    z, hurst = f("prices.mid_zscore"), f("prices.hurst_exponent", 0.5)
    far = F.abs(z) > 1.5
    extreme = F.when(far, up_to_one(F.abs(z) / 3))
    fz, fp = f("funding.funding_zscore", 0.0), f("funding.funding_percentile", 50.0)
    hot, cold = (fz > 2) | (fp > 90), (fz < -2) | (fp < 10)
    fund = F.when(hot | cold, F.greatest(F.abs(fz) / 3, F.abs(fp - 50) / 50))
    bz, torn = f("mark_prices.basis_zscore", 0.0), f("mark_prices.dislocation_detected", False)
    basis = F.when((F.abs(bz) > 2) | torn, F.greatest(F.abs(bz) / 3, flag(torn, 0.5)))
    div = f("trades.cvd_price_divergence", 0.0)
    cvd = F.when(F.abs(div) > 0.3, F.abs(div))
    counted = {"price_extremity": extreme, "funding_extreme": up_to_one(fund), "basis_dislocation": up_to_one(basis),
               "cvd_divergence": up_to_one(cvd)}
    counted = yield counted
    parts = {**counted, "mean_reverting_tendency": F.when(far & (hurst < 0.5), 1 - hurst * 2)}
    parts = yield parts
    low, high = (yield dict(zip(("left", "right"), _two_sides([(z < -1.5, z > 1.5, extreme, 0.5), (~hot & cold, hot, fund, 0.3), (bz < -2, bz > 2, basis, 0.3),
                            (div < -0.3, div > 0.3, cvd, 0.3)])))).values()
    down, up = low > high * 1.3, high > low * 1.3
    v = (yield {"v": F.greatest(low, high)})["v"]
    return signal(up_to_one(v), parts, 2, counted=counted,
                  signal=F.when(down, "OVERSOLD").when(up, "OVERBOUGHT").otherwise("NEUTRAL"),
                  strength=F.when(down, low / (low + high + 0.001)).when(up, high / (low + high + 0.001)).otherwise(0.0),
                  expected_reversion_pct=v * 2)


def momentum_exhaustion(f: Feed, weakening: Column) -> Signal:
    """``weakening``: how far the momentum quality of the last five updates fell below the five before."""
    slope, delta = f("trades.cvd_slope", 0.0), f("trades.aggressive_delta", 0.0)
    loss = F.when((F.abs(slope) < 0.01) | (weakening > 0.1),
                  F.greatest(0.1 - F.abs(slope), F.lit(0.0)) * 10 + weakening)
    corr, intent = F.abs(f("oi.oi_price_correlation", 0.0)), f("oi.position_intent", "neutral")
    div = F.when(corr < 0.3, 1 - corr)
    spent, liq = f("liquidations.exhaustion_signal", False), f("liquidations.liquidation_imbalance", 0.0)
    fz, fm = f("funding.funding_zscore", 0.0), f("funding.funding_momentum", 0.0)
    falling, rising = (fz > 2) & (fm < 0), (fz < -2) & (fm > 0)
    turn = F.when((F.abs(fz) > 2) & (F.abs(fm) > 0), F.when(falling | rising, 0.7).otherwise(0.3))
    parts = {"cvd_momentum_loss": up_to_one(loss), "oi_divergence": up_to_one(div),
             "liquidation_exhaustion": F.when(spent, 0.8), "funding_reversal": turn}
    parts = yield parts
    bull, bear = (yield dict(zip(("left", "right"), _two_sides([
        (delta > 0, delta <= 0, loss, 0.4),
        (intent.isin("long_liquidation", "short_covering", "short_liquidation"), intent.isin("short_accumulation", "long_accumulation"), div, 0.3),
        (spent & (liq < -0.3), spent & (liq > 0.3), F.lit(1.0), 0.5), (falling, rising, turn, 0.3)])))).values()
    v = (yield {"v": F.greatest(bull, bear)})["v"]
    return signal(up_to_one(v), parts, 2, exhaustion=v > 0.5, trend_direction=F.when(bull > bear, "bullish").otherwise("bearish"),
                  reversal_probability=v * 0.8)


def smart_money_flow(f: Feed) -> Signal:
    whale, ratio = f("trades.whale_trade_detected", False), f("trades.whale_volume_ratio", 0.0)
    w = F.when(whale | (ratio > 0.05), (f("trades.buy_pressure", 0.5) - f("trades.sell_pressure", 0.5)) * ratio * 5)
    agg, slope = f("trades.aggressive_ratio", 0.5), f("trades.cvd_slope", 0.0)
    a = F.when((agg != 0.5) | (slope != 0), (agg - 0.5) * 2 + slope * 10)
    d5, d10 = f("orderbook.depth_imbalance_5", 0.0), f("orderbook.depth_imbalance_10", 0.0)
    d = F.when((d5 != 0) | (d10 != 0), (d5 + d10) / 2)
    delta, ls = f("oi.oi_delta_pct", 0.0), f("oi.long_short_ratio", 1.0)
    o = F.when((F.abs(delta) > 0.5) | (F.abs(ls - 1) > 0.1),
               F.signum(delta) * F.least(F.lit(1.0), F.abs(delta) / 5) + (ls - 1) * 0.5)
    parts = {"whale_bias": w, "flow_aggressiveness": clip(a, -1.0, 1.0), "depth_bias": d, "oi_signal": clip(o, -1.0, 1.0)}
    parts = yield parts
    flow = clip(sum((F.coalesce(x, F.lit(0.0)) * k for x, k in ((w, 0.4), (a, 0.3), (d, 0.2), (o, 0.2))), F.lit(0.0)), -1.0, 1.0)
    return signal(flow, parts, 2, direction=F.when(flow > 0.2, "BUYING").when(flow < -0.2, "SELLING").otherwise("NEUTRAL"),
                  strength=F.abs(flow),
                  volume_estimate=F.when(ratio > 0, f("ticker.volume", 0.0) * f("ticker.institutional_interest_idx", 0.5) * ratio).otherwise(0.0))


def arbitrage_opportunity(f: Feed) -> Signal:
    carry, ann, bz = F.abs(f("funding.funding_carry_yield", 0.0)), F.abs(f("mark_prices.annualized_basis", 0.0)), F.abs(f("mark_prices.basis_zscore", 0.0))
    has_f, has_b = carry > 0.1, (ann > 0.1) | (bz > 2)
    fund, basis = F.when(has_f, carry).otherwise(0.0), F.when(has_b, ann).otherwise(0.0)
    mid = f("mark_prices.mark_price", 1.0)
    bps = F.when(mid > 0, f("orderbook.spread", 0.0) / mid * 10000).otherwise(0.0)
    ex = F.greatest(F.lit(0.0), 1 - F.when(bps > 5, (bps - 5) * 0.1).otherwise(0.0) - flag(f("ticker.volume", 0.0) < 100, 0.3))
    parts = {"funding_yield": F.when(has_f, F.least(F.lit(1.0), carry / 0.5)),
             "basis_opportunity": F.when(has_b, F.least(F.lit(1.0), ann / 0.5)), "execution_feasibility": ex}
    parts = yield parts
    v = (yield {"v": F.least(F.lit(1.0), (fund + basis) * 2) * ex})["v"]
    kind = (F.when((fund > basis) & (fund > 0.1), "funding").when((basis > fund) & (basis > 0.1), "basis")
            .when((fund > 0.05) & (basis > 0.05), "combined").otherwise("none"))
    gain = F.when(kind == "funding", fund).when(kind == "basis", basis).when(kind == "combined", fund + basis).otherwise(0.0)
    return signal(v, parts, 2, of=3, opportunity=(v > 0.3) & (kind != "none"), type=kind, expected_return_pct_annual=gain * 100,
                  risk_level=F.when((ex > 0.8) & (bz < 3), "LOW").when(ex > 0.5, "MEDIUM").otherwise("HIGH"))


def regime_transition(f: Feed, baseline: Column) -> Signal:
    """``baseline``: mean smart-money index of the last ten updates (NULL before six)."""
    change, strength = f("ticker.price_change_pct", 0.0), f("ticker.market_strength", 0.5)
    now = (F.when((change > 3) & (strength > 0.6), "BULL").when((change < -3) & (strength < 0.4), "BEAR").otherwise("RANGING"))
    comp, exp = f("ticker.volatility_compression_idx", 0.0), f("ticker.volatility_expansion_idx", 0.0)
    vol = F.when((comp > 0.5) | (exp > 0.5), F.greatest(comp, exp))
    tox = f("trades.flow_toxicity", 0.0)
    spike = F.when(baseline.isNotNull(), F.greatest(F.lit(0.0), tox - baseline)).otherwise(0.0)
    flow = F.when((spike > 0.2) | (tox > 0.6), up_to_one(spike + tox * 0.5))
    fz = f("funding.funding_zscore", 0.0)
    fund = F.when(F.abs(fz) > 2, F.abs(fz) / 3)
    lev, crowd = f("oi.leverage_index", 1.0), f("oi.position_crowding_score", 0.0)
    peak = F.when((lev > 1.5) | (crowd > 0.7), (lev - 1) * 0.5 + crowd * 0.5)
    parts = {"volatility_regime_change": vol, "flow_toxicity_spike": flow, "funding_divergence": up_to_one(fund),
             "leverage_cycle_extreme": up_to_one(peak)}
    parts = yield parts
    score = sum((F.coalesce(x, F.lit(0.0)) * k for x, k in ((vol, 0.3), (flow, 0.3), (fund, 0.2), (peak, 0.2))), F.lit(0.0))
    turns = score > 0.5
    nxt = (F.when(~turns, now).when(now == "BULL", F.when(fz > 2, "BEAR").otherwise("RANGING"))
           .when(now == "BEAR", F.when(fz < -2, "BULL").otherwise("RANGING")).otherwise(F.when(strength > 0.5, "BULL").otherwise("BEAR")))
    v = (yield {"v": F.least(F.lit(1.0), score)})["v"]
    return signal(v, parts, 2, current_regime=now, predicted_regime=nxt, transition_probability=v,
                  timeframe_hours=F.when(comp > 0.7, 6).when(score > 0.7, 12).otherwise(24))


def execution_quality(f: Feed) -> Signal:
    depth = f("orderbook.bid_depth_10", 0.0) + f("orderbook.ask_depth_10", 0.0)
    bps, sz = f("prices.spread_bps", 10.0), f("prices.spread_zscore", 0.0)
    tight = F.greatest(F.lit(0.0), 1 - bps / 20)
    impact = F.greatest(F.lit(0.0), 1 - (f("trades.trade_clustering_index", 0.5) * 0.5 + F.abs(f("trades.aggressive_ratio", 0.5) - 0.5)))
    parts = {"liquidity": F.when(depth > 0, F.least(F.lit(1.0), depth / 100) * 0.6 + f("orderbook.liquidity_persistence_score", 0.5) * 0.4),
             "spread_quality": F.when(sz < 0, F.least(F.lit(1.0), tight + F.abs(sz) * 0.1)).otherwise(tight), "low_impact": impact,
             "volume_conditions": F.least(F.lit(1.0), f("ticker.relative_volume_percentile", 50.0) / 100)}
    parts = yield parts
    v = (yield {"v": blend(parts)})["v"]
    return signal(up_to_one(v), parts, 2,
                  quality=F.when(v > 0.8, "EXCELLENT").when(v > 0.6, "GOOD").when(v > 0.4, "FAIR").otherwise("POOR"),
                  slippage_estimate_bps=bps / 2 + (1 - impact) * 10,
                  max_size_no_impact=F.when(depth > 0, depth * v * 0.1).otherwise(0.5),
                  optimal_order_splits=F.when(v > 0.8, 1).when(v > 0.6, 3).when(v > 0.4, 5).otherwise(10))


# Signals that look at the newest or recent values of others.
NEEDS = {"composite_risk": ["squeeze_probability", "stop_hunt_probability"], "momentum_exhaustion": ["momentum_quality"],
         "regime_transition": ["smart_money_index"]}


#: Signals that read the newest features alone.
OWN = {"smart_money_index": smart_money_index, "squeeze_probability": squeeze_probability,
       "stop_hunt_probability": stop_hunt_probability, "momentum_quality": momentum_quality,
       "market_maker_activity": market_maker_activity, "liquidation_cascade_risk": cascade_risk,
       "institutional_phase": institutional_phase, "volatility_breakout": volatility_breakout,
       "mean_reversion": mean_reversion, "smart_money_flow": smart_money_flow,
       "arbitrage_opportunity": arbitrage_opportunity, "execution_quality": execution_quality}

#: Columns of the values that other signals look back at.
LOOK = {"_sq": "squeeze_probability", "_sh": "stop_hunt_probability", "_mq": "momentum_quality", "_sm": "smart_money_index"}


def wanted_signals(names=None) -> set[str]:
    """``names`` (all fifteen by default) and the signals they look back at."""
    wanted = set(names or [*OWN, *NEEDS])
    return wanted | {n for w in wanted for n in NEEDS.get(w, [])}


def late_signals(g: Feed, wanted) -> DataFrame:
    """The signals of ``NEEDS`` from rows with _sq, _sh (newest known values), _weak and _base."""
    late = {"composite_risk": composite_risk(g, C("_sq"), C("_sh")), "momentum_exhaustion": momentum_exhaustion(g, C("_weak")),
            "regime_transition": regime_transition(g, C("_base"))}
    return g.finish(**{n: s for n, s in late.items() if n in wanted})


def all_signals(cache: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id"), names=None) -> DataFrame:
    """The signals at every update (all fifteen, or ``names`` and what they look back at)."""
    f, wanted = Feed(cache), wanted_signals(names)
    base = f.finish(**{name: fn(f) for name, fn in OWN.items() if name in wanted})
    if not wanted & set(NEEDS):
        return base
    base = base.withColumns({k: C(f"{n}.value") if n in wanted else F.lit(None).cast("double") for k, n in LOOK.items()})
    plan = plan_series(base, by, order, depth=12)
    base = running(base, plan, {"_sq": ("last", "_sq"), "_sh": ("last", "_sh")})

    def body(d, p):
        near, far, ten = rows(p, 5), rows(p, 5, end=-5), rows(p, 10)
        n, sm = F.count("_mq").over(rows(p, 11)), F.count("_sm").over(ten)
        return d.withColumns({
            "_weak": F.when(n > 10, F.avg("_mq").over(far) - F.avg("_mq").over(near)).otherwise(0.0),
            "_base": F.when(sm >= 10, F.avg("_sm").over(ten)).when(sm > 5, 0.3)})
    return late_signals(Feed(bounded(base, plan, 12, body)), wanted).drop(*LOOK, "_weak", "_base")


# Fixed values: (category, direction threshold, weight, inverted) of each signal.
SIGNAL_META = [
    ("smart_money_index", "flow", 0.6, 1.2, False), ("squeeze_probability", "structure", 0.5, 1.1, False),
    ("stop_hunt_probability", "risk", 0.5, 0.9, False), ("momentum_quality", "momentum", 0.6, 1.3, False),
    ("composite_risk", "risk", 0.5, 1.0, True), ("market_maker_activity", "flow", 0.5, 1.1, False),
    ("liquidation_cascade_risk", "risk", 0.5, 1.4, True), ("institutional_phase", "flow", 0.5, 1.3, False),
    ("volatility_breakout", "timing", 0.5, 1.2, False), ("mean_reversion", "timing", 0.5, 1.0, False),
    ("momentum_exhaustion", "momentum", 0.7, 1.2, True), ("smart_money_flow", "flow", 0.0, 1.4, False),
    ("arbitrage_opportunity", "execution", 0.5, 0.8, False), ("regime_transition", "structure", 0.5, 1.1, False),
    ("execution_quality", "execution", 0.6, 0.9, False)]

# Groups of signals that tend to repeat each other, in the order the penalty is applied.
SIGNAL_GROUPS = {
    "flow": ["smart_money_index", "smart_money_flow", "institutional_phase", "market_maker_activity"],
    "momentum": ["momentum_quality", "momentum_exhaustion", "volatility_breakout"],
    "risk": ["composite_risk", "liquidation_cascade_risk", "stop_hunt_probability"],
    "timing": ["mean_reversion", "volatility_breakout"],
    "structure": ["squeeze_probability", "regime_transition"]}
BULL_WORDS = ["up", "long", "bullish", "buying", "accumulation"]
BEAR_WORDS = ["down", "short", "bearish", "selling", "distribution"]
CONFIDENCE_WEIGHT, PENALTY_STEP = 0.3, 0.1


def signal_rows(wide: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    """One row per update and present signal, with its own words for direction, phase and signal."""
    def word(name, key):
        t = wide.schema[name].dataType
        return C(f"{name}.{key}").cast("string") if key in t.fieldNames() else F.lit(None).cast("string")
    made = [F.struct(F.lit(n).alias("signal"), C(f"{n}.value").alias("value"), C(f"{n}.confidence").alias("confidence"),
                     word(n, "direction").alias("direction_word"), word(n, "phase").alias("phase_word"),
                     word(n, "signal").alias("signal_word"), word(n, "type").alias("type_word"))
            for n, *_ in SIGNAL_META if n in wide.columns]
    return (wide.select(*by, *order, F.explode(F.array(*made)).alias("s")).select(*by, *order, "s.*")
            .where(C("value").isNotNull()))


def _meta(field: int, kind: str) -> Column:
    pairs = [F.lit(x) for m in SIGNAL_META for x in (m[0], m[field])]
    return F.try_element_at(F.create_map(*pairs), C("signal")).cast(kind)


def signal_direction() -> Column:
    """Own words first, then the threshold with a 20 % band (mirrored for risk-like signals)."""
    d, ph, sg = F.lower("direction_word"), F.lower("phase_word"), F.lower("signal_word")
    t, v = C("threshold"), C("value")
    up = F.when(C("inverted"), v < t * 0.8).otherwise(v > t * 1.2)
    down = F.when(C("inverted"), v > t * 1.2).otherwise(v < t * 0.8)
    return (F.when(d.isin(BULL_WORDS), "bullish").when(d.isin(BEAR_WORDS), "bearish").when(d.isNotNull(), "neutral")
            .when(ph == "accumulation", "bullish").when(ph == "distribution", "bearish")
            .when(sg.isin("oversold", "bullish"), "bullish").when(sg.isin("overbought", "bearish"), "bearish")
            .when(up, "bullish").when(down, "bearish").otherwise("neutral"))


def rank_signals(long: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    """Direction and rank score of every signal row; recent spread of the signal raises it."""
    full = long.withColumns({"category": _meta(1, "string"), "threshold": _meta(2, "double"), "weight": _meta(3, "double"),
                             "inverted": _meta(4, "boolean")})
    plan = plan_series(full, [*by, "signal"], order, depth=12)

    def body(d, p):
        past = rows(p, 10, end=-1)
        return d.withColumn("_rec", F.when(F.count("value").over(past) < 2, 1.0).otherwise(
            0.8 + F.least(F.stddev_pop("value").over(past) * 0.4, F.lit(0.4))))
    score = F.abs(C("value") - 0.5) * 2 * C("weight") * (1 + (C("confidence") - 0.5) * CONFIDENCE_WEIGHT) * C("_rec")
    return bounded(full, plan, 12, body).withColumns({
        "direction": signal_direction(), "rank_score": clip(score, 0.0, 2.0)}).drop("_rec")


def correlation_penalty(ranked: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    """Inside a group the k-th best signal keeps max(0.5, 1 - 0.1 (k - 1)) of its score.

    Windows are per update (fifteen rows at most). One signal is in two groups, so the groups that
    share no signal are done together and the overlapping one after them. Rows are dealt by update once; both
    windows and a grouping by update behind them (``recommend``) stay in place.
    """
    place = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(SIGNAL_META) for x in (m[0], i)]), C("signal"))

    def apply(df, groups):
        name = reduce(lambda acc, g: acc.when(C("signal").isin(SIGNAL_GROUPS[g]), g), groups[1:],
                      F.when(C("signal").isin(SIGNAL_GROUPS[groups[0]]), groups[0]))
        df = df.withColumn("_g", name)
        w = Window.partitionBy(*by, *order, "_g").orderBy(C("rank_score").desc(), place)
        keep = F.greatest(F.lit(0.5), 1 - PENALTY_STEP * (F.row_number().over(w) - 1))
        return df.withColumn("rank_score", F.when(C("_g").isNull(), C("rank_score")).otherwise(C("rank_score") * keep)).drop("_g")
    return apply(apply(ranked.repartition(*by, *order), ["flow", "momentum", "risk", "structure"]), ["timing"])


def _sides() -> list[Column]:
    w = C("rank_score") * C("confidence")
    return [F.sum(F.when(C("direction") == d, w * k).otherwise(0.0)).alias(n)
            for d, k, n in (("bullish", 1.0, "bull"), ("bearish", 1.0, "bear"), ("neutral", 0.5, "flat"))] + [
        F.count(F.when(C("direction") == d, 1)).alias(n) for d, n in (("bullish", "n_bull"), ("bearish", "n_bear"))]


def conflict_columns() -> dict[str, Column]:
    b, s = C("bull"), C("bear")
    both = (C("n_bull") > 0) & (C("n_bear") > 0) & (b + s > 0)
    share = F.least(b, s) / F.nullif(b + s, F.lit(0.0))
    return {"conflict_severity": F.when(~both, "none").when(share < 0.15, "minor").when(share < 0.30, "moderate")
                                  .when(share < 0.45, "severe").otherwise("critical"),
            "resolution": F.when(both, F.when(b > s, "bullish").when(s > b, "bearish").otherwise("neutral")),
            "resolution_confidence": F.when(both, F.abs(b - s) / (b + s))}


def detect_conflicts(ranked: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    return ranked.groupBy(*by, *order).agg(*_sides()).withColumns(conflict_columns())


def bias_columns() -> dict[str, Column]:
    b, s, total = C("bull"), C("bear"), C("bull") + C("bear") + C("flat")
    side = F.when(b > s * 1.2, "bullish").when(s > b * 1.2, "bearish").otherwise("neutral")
    gap = F.abs(b - s) / F.nullif(total, F.lit(0.0))
    conf = F.when(side == "neutral", 1 - gap).otherwise(gap)
    conf = conf * F.when(C("conflict_severity").isin("severe", "critical"), 0.7).otherwise(1.0)
    return {"market_bias": F.when(total == 0, "neutral").otherwise(side),
            "bias_confidence": F.when(total == 0, 0.0).otherwise(clip(conf, 0.0, 1.0))}


def market_bias(ranked: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    """Weighted vote with a 20 % margin; severe conflicts cost 30 % of the confidence."""
    return detect_conflicts(ranked, by, order).withColumns(bias_columns())


def category_scores(ranked: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    return ranked.groupBy(*by, *order, "category").agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("signals"))


def recommend(ranked: DataFrame, by=("symbol", "exchange"), order=("ts", "event_id")) -> DataFrame:
    """One recommendation per update: strength, lists, risk, entry bias, urgency and alerts. Updates with an unknown key have none.

    The two sides, their conflict and the other facts come from one look at the rows of an update.
    """
    key = [*by, *order]

    def val(name):
        return F.max(F.when(C("signal") == name, C("value")))

    def cat(name):
        return F.avg(F.when(C("category") == name, C("value")))
    ordered = F.sort_array(F.collect_list(F.struct((-C("rank_score")).alias("o"), "signal", "direction")))
    facts = ranked.dropna(subset=key).groupBy(*key).agg(
        *_sides(), ordered.alias("_all"), F.coalesce(cat("risk"), F.lit(0.5)).alias("_risk"), F.coalesce(cat("timing"), F.lit(0.5)).alias("_timing"),
        val("liquidation_cascade_risk").alias("_cascade"), val("stop_hunt_probability").alias("_hunt"),
        val("momentum_exhaustion").alias("_tired"), val("volatility_breakout").alias("_breakout"),
        val("mean_reversion").alias("_revert"), val("execution_quality").alias("_exec"), val("arbitrage_opportunity").alias("_arb"))
    df = facts.withColumns(conflict_columns()).withColumns(bias_columns())
    sev, conf = C("conflict_severity"), C("bias_confidence")
    strength = (F.when(sev == "critical", "conflicted").when((conf > 0.7) & (sev == "severe"), "moderate").when(conf > 0.7, "strong")
                .when(conf > 0.4, "moderate").when(conf > 0.2, "weak").otherwise("no_action"))
    same = F.filter("_all", lambda x: x["direction"] == C("market_bias"))
    against = F.filter("_all", lambda x: (x["direction"] != C("market_bias")) & (x["direction"] != "neutral"))
    names = lambda arr: F.transform(arr, lambda x: x["signal"])
    hit = lambda test, pts: F.when(F.coalesce(test, F.lit(False)), pts).otherwise(0.0)
    risk = F.round(hit(C("_risk") > 0.7, 0.3) + hit(C("_cascade") > 0.7, 0.3) + hit(C("_hunt") > 0.6, 0.2)
                   + F.when(sev == "critical", 0.3).when(sev == "severe", 0.2).otherwise(0.0) + hit(C("_tired") > 0.7, 0.15), 6)
    df = df.withColumns({"strength": strength, "risk_score": risk})
    df = df.withColumn("risk_level", F.when(C("risk_score") > 0.7, "extreme").when(C("risk_score") > 0.5, "high")
                       .when(C("risk_score") > 0.3, "medium").otherwise("low"))
    st, rl = C("strength"), C("risk_level")
    soon, swing, quick = C("_breakout") > 0.7, F.abs(C("_revert") - 0.5) > 0.3, C("_exec") > 0.7
    df = df.withColumns({
        "primary_signals": F.slice(names(same), 1, 3), "supporting_signals": F.slice(names(same), 4, 5),
        "conflicting_signals": F.slice(names(against), 1, 3),
        "entry_bias": F.when(st.isin("conflicted", "no_action") | (rl == "extreme"), "wait")
                       .when((rl == "low") & (st == "strong"), "aggressive").otherwise("conservative"),
        "urgency": F.when(soon, "soon").when(swing, "patient").when(quick, "immediate").when(C("_timing") > 0.6, "soon").otherwise("patient"),
        "timeframe": F.when(soon, "intraday").when(swing, "swing").when(quick, "scalp").when(C("_timing") > 0.6, "intraday").otherwise("swing"),
        "alerts": F.filter(F.array(
            F.when(rl == "extreme", "extreme_risk").when(rl == "high", "high_risk"),
            F.when(sev == "critical", "critical_conflict").when(sev == "severe", "severe_conflict"),
            F.when(C("_cascade") > 0.8, "cascade"), F.when(C("_arb") > 0.7, "arbitrage")), lambda a: a.isNotNull())})
    return df.drop("_all", "_risk", "_timing", "_cascade", "_hunt", "_tired", "_breakout", "_revert", "_exec", "_arb",
                   "bull", "bear", "flat", "n_bull", "n_bear")


def signal_dashboard(ranked: DataFrame, by=("symbol",), order=("ts", "event_id")) -> DataFrame:
    """Direction counts of the newest row of every signal and the overall bias."""
    newest = ranked.groupBy(*by, "signal").agg(F.max_by(F.struct("value", "confidence", "direction"), F.struct(*order)).alias("s"))
    n, up, dn = F.count(F.lit(1)), F.count(F.when(C("s.direction") == "bullish", 1)), F.count(F.when(C("s.direction") == "bearish", 1))
    out = newest.groupBy(*by).agg(n.alias("signals"), up.alias("bullish_count"), dn.alias("bearish_count"),
                                  F.avg("s.confidence").alias("confidence"), F.count(F.when(F.abs("s.value") > 0.3, 1)).alias("active_signals"))
    gap = C("bullish_count") - C("bearish_count")
    return out.withColumns({"neutral_count": C("signals") - C("bullish_count") - C("bearish_count"),
                            "bias": F.when(gap > 2, "bullish").when(gap < -2, "bearish").otherwise("neutral"),
                            "strength": F.when(F.abs(gap) > 2, F.abs(gap) / C("signals")).otherwise(0.0)})


def feature_candles(prices: DataFrame, features: DataFrame, every: str, overlays: list[str], by=("symbol", "exchange"),
                    ts: str = "ts", price: str = "mid_price") -> DataFrame:
    """OHLC bars with the last value of each overlay in the bar."""
    from tickloom.operators.aggregates import aggregate_features, ohlc
    bars = ohlc(prices, every, by, price, ts)
    extra = aggregate_features(features, every, overlays, by, ts, kinds=("last",)).drop("samples")
    return bars.join(extra, [*by, "bucket"], "left")


def liquidity_heatmap(books: DataFrame, keys=("symbol", "ts"), levels: int = 10) -> DataFrame:
    """Book levels with strength against the largest, walls above half of it, and the imbalance label."""
    def side(name, word, wall):
        return F.transform(F.slice(name, 1, levels), lambda x, i: F.struct(
            F.lit(word).alias("side"), (i + 1).alias("level"), x["price"].alias("price"), x["qty"].alias("size"),
            F.lit(wall).alias("wall_type")))
    both = F.concat(side("bids", "bid", "support_wall"), side("asks", "ask", "resistance_wall"))
    top = F.array_max(F.transform("_l", lambda x: x["size"]))
    total = lambda w: F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.when(x["side"] == w, x["size"]).otherwise(0.0))
    d = books.withColumn("_l", both)
    d = d.withColumns({"_top": top, "imbalance_ratio": safe_div(total("bid") - total("ask"), total("bid") + total("ask"))})
    d = d.select(*keys, "imbalance_ratio", "_top", F.explode("_l").alias("l")).select(*keys, "imbalance_ratio", "_top", "l.*")
    strength = C("size") / C("_top")
    return d.withColumns({
        "strength": strength, "depth_pct": C("level") / levels, "wall_type": F.when(strength > 0.5, C("wall_type")),
        "distribution": F.when(C("imbalance_ratio") > 0.1, "bid_heavy").when(C("imbalance_ratio") < -0.1, "ask_heavy")
                         .otherwise("balanced")}).drop("_top")


def regime_timeline(df: DataFrame, keys, order, label: str) -> DataFrame:
    """Runs of a regime with start, end, duration and the regime before."""
    from tickloom.operators.windows import runs
    r = runs(df, keys, order, label)
    plan = plan_series(r, keys, ["start"], depth=1)
    got = bounded(r, plan, 1, lambda d, p: d.withColumn("previous", F.lag(label).over(p.window())))
    return got.withColumn("duration_seconds", F.timestamp_diff("SECOND", C("start"), C("end"))).drop("island")
