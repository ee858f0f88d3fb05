"""Composite signals and their aggregation (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.operators.series import plan_series
from tickloom.plans import composites as P
from tickloom.session import kept

C = F.col

# Stream features as expressions over the events table; the same text runs in both engines.
INPUTS = {
    "prices": {"spread_zscore": "(k - 50) / 20e0", "price_efficiency": "(event_id % 17) / 17e0", "hurst_exponent": "(event_id % 10) / 10e0",
               "spread_compression_velocity": "(k % 13 - 6) / 10e0", "mid_zscore": "(value - 50) / 25e0",
               "price_vs_vwap": "(value - 50) / 5e0", "spread_bps": "k / 5e0"},
    "orderbook": {"absorption_ratio": "(k % 23) / 18e0", "pull_wall_detected": "event_id % 7 = 0", "push_wall_detected": "event_id % 5 = 0",
                  "add_cancel_ratio": "(k % 11) / 9e0", "depth_imbalance_5": "(k - 50) / 60e0", "depth_imbalance_10": "(event_id % 21 - 10) / 15e0",
                  "liquidity_persistence_score": "(event_id % 13) / 13e0", "liquidity_gradient": "(k % 30) / 15e0",
                  "bid_depth_10": "value", "ask_depth_10": "value / 2", "spread": "k / 1000e0", "bid_wall_detected": "event_id % 8 = 3",
                  "ask_wall_detected": "event_id % 11 = 5"},
    "trades": {"whale_volume_ratio": "(k % 9) / 12e0", "whale_trade_detected": "event_id % 4 = 0", "flow_toxicity": "(event_id % 11) / 11e0",
               "cvd_price_divergence": "(k - 50) / 50e0", "sweep_detected": "event_id % 9 = 0", "cvd_slope": "(event_id % 19 - 9) / 90e0",
               "aggressive_delta": "(value - 50) / 100", "buy_pressure": "k / 100e0", "sell_pressure": "1 - k / 100e0",
               "aggressive_ratio": "(k + 1) / 50e0", "iceberg_detected": "event_id % 6 = 1", "trade_clustering_index": "(event_id % 12) / 12e0"},
    "funding": {"funding_zscore": "(value - 60) / 20", "funding_regime_score": "(event_id % 5 - 2) * 1e0", "funding_percentile": "k * 1e0",
                "funding_momentum": "(event_id % 7 - 3) / 10e0", "funding_carry_yield": "(value - 50) / 300",
                "funding_regime": "CASE WHEN event_id % 3 = 0 THEN 'neutral' ELSE 'positive' END"},
    "oi": {"leverage_zscore": "(k - 40) / 25e0", "position_crowding_score": "(event_id % 15) / 15e0", "liquidation_cascade_risk": "(k % 10) / 10e0",
           "position_intent_score": "(event_id % 5 - 2) / 2e0", "leverage_index": "(k + 20) / 60e0", "oi_delta_pct": "(value - 50) / 20",
           "position_intent": "CASE WHEN event_id % 4 = 0 THEN 'long_accumulation' WHEN event_id % 4 = 1 THEN 'short_accumulation' "
                              "WHEN event_id % 4 = 2 THEN 'long_liquidation' ELSE 'neutral' END",
           "oi_price_correlation": "(event_id % 13 - 6) / 7e0", "long_short_ratio": "(k + 1) / 50e0"},
    "liquidations": {"liquidation_cluster_detected": "event_id % 6 = 0", "cascade_probability": "(event_id % 8) / 10e0",
                     "cascade_acceleration": "(k - 50) / 100e0", "liquidation_imbalance": "(k - 50) / 50e0", "exhaustion_signal": "event_id % 10 = 0"},
    "mark_prices": {"basis_zscore": "(k - 50) / 18e0", "dislocation_detected": "event_id % 12 = 0", "annualized_basis": "(value - 50) / 400",
                    "mark_price": "value"},
    "ticker": {"volatility_compression_idx": "(event_id % 9 - 2) / 8e0", "range_vs_atr": "(k + 40) / 90e0", "volatility_expansion_idx": "(k % 16) / 20e0",
               "price_change_pct": "(value - 50) / 8", "market_strength": "(event_id % 20) / 20e0", "volume": "value * 4",
               "institutional_interest_idx": "k / 100e0", "relative_volume_percentile": "(event_id % 100) * 1e0"}}

FLAT = ("WITH f AS (SELECT event_id, symbol, exchange, ts, " + ", ".join(
    f"{e} AS {s}_{n}" for s, fs in INPUTS.items() for n, e in fs.items()) + " FROM ev)")


def cache(t):
    return t.ev.select("event_id", "symbol", "exchange", "ts", *[
        F.struct(*[F.expr(e).alias(n) for n, e in fs.items()]).alias(s) for s, fs in INPUTS.items()])


def one(t, fn):
    f = P.Feed(cache(t))
    return f.finish(s=fn(f)).select("event_id", "s").where("s IS NOT NULL").select("event_id", "s.*").drop("components")


def wavg(weights=None, **parts):
    """SQL of the weighted mean of the known parts and of their number."""
    w = weights or {k: 1.0 for k in parts}
    top = " + ".join(f"coalesce({p}, 0) * {w[k]}" for k, p in parts.items())
    bottom = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w[k]} END" for k, p in parts.items())
    n = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in parts.values())
    return f"(({top}) / nullif({bottom}, 0))", f"({n})"


def sql_signal(parts, out, least=2, weights=None, of=4, labels="", extra=""):
    """SELECT of one signal: ``parts`` are SQL expressions over f, ``out`` may use v for the blend."""
    names = list(parts)
    v, n = wavg(weights, **{k: k for k in names})
    cols = ", ".join(f"{e} AS {k}" for k, e in parts.items())
    return (f"{FLAT}, p AS (SELECT *, {cols} FROM f), q AS (SELECT *, {v} AS v, {n} AS n FROM p){extra} SELECT event_id, {out} AS value, "
            f"n / {of} AS confidence{', ' + labels if labels else ''} FROM q WHERE n >= {least}")


@query("c1_smart_money_index", uses="ev", doubles="value confidence", sql=sql_signal({
    "orderbook_absorption": "least(1, orderbook_absorption_ratio)",
    "whale_activity": "least(1, trades_whale_volume_ratio * 2 + CASE WHEN trades_whale_trade_detected THEN 0.3 ELSE 0 END)",
    "flow_toxicity": "trades_flow_toxicity", "cvd_divergence": "abs(trades_cvd_price_divergence)"}, "v", weights=P.SMART_MONEY))
def _(t):
    return one(t, P.smart_money_index)


SQUEEZE_PARTS = {"funding_extreme": "least(1, abs(funding_funding_zscore) / 3)", "oi_leverage": "least(1, abs(oi_leverage_zscore) / 2)",
                 "crowding": "oi_position_crowding_score", "price_compression": "greatest(0, -prices_spread_zscore / 2)"}


@query("c2_squeeze_probability", uses="ev", doubles="value confidence", sql=sql_signal(SQUEEZE_PARTS, "least(1, v)", weights=P.SQUEEZE))
def _(t):
    return one(t, P.squeeze_probability)


HUNT_PARTS = {
    "wall_manipulation": "nullif(CASE WHEN orderbook_pull_wall_detected THEN 0.5e0 ELSE 0e0 END + CASE WHEN orderbook_push_wall_detected THEN 0.3e0 ELSE 0e0 END, 0)",
    "spoofing_indicator": "greatest(0, 1 - orderbook_add_cancel_ratio)", "efficiency_degradation": "greatest(0, 1 - prices_price_efficiency)",
    "sweep_detected": "CASE WHEN trades_sweep_detected THEN 0.8e0 END"}


@query("c3_stop_hunt_probability", uses="ev", doubles="value confidence", sql=sql_signal(HUNT_PARTS, "least(1, v)", least=1))
def _(t):
    return one(t, P.stop_hunt_probability)


@query("c4_momentum_quality", uses="ev", doubles="value confidence", sql=sql_signal({
    "a": "0.5 + greatest(-0.5, least(0.5, trades_cvd_slope * 10))", "b": "0.5 + oi_position_intent_score * 0.5",
    "c": "0.5 + funding_funding_regime_score * 0.25", "d": "0.5 + orderbook_depth_imbalance_5 * 0.5"}, "greatest(0, least(1, v))"))
def _(t):
    return one(t, P.momentum_quality)


@query("c5_composite_risk", uses="ev", doubles="value confidence", sql=f"""{FLAT}, p AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in
       {**SQUEEZE_PARTS, **HUNT_PARTS}.items())} FROM f), q AS (SELECT *, least(1, {wavg(P.SQUEEZE, **{k: k for k in SQUEEZE_PARTS})[0]}) AS sq,
       least(1, {wavg(None, **{k: k for k in HUNT_PARTS})[0]}) AS sh FROM p) SELECT event_id, greatest(0, least(1, (oi_liquidation_cascade_risk +
       sq + sh + abs(prices_hurst_exponent - 0.5) * 2) / 4)) AS value, 1e0 AS confidence FROM q""")
def _(t):
    return P.all_signals(cache(t), names=["composite_risk"]).select("event_id", "composite_risk.value", "composite_risk.confidence")


@query("c6_market_maker_activity", uses="ev", doubles="value confidence", sql=sql_signal({
    "wall_activity": """nullif(CASE WHEN orderbook_pull_wall_detected OR orderbook_push_wall_detected THEN 0.4e0 ELSE 0 END + CASE WHEN
        orderbook_bid_wall_detected OR orderbook_ask_wall_detected THEN 0.3e0 ELSE 0 END, 0)""",
    "spread_manipulation": "least(1, abs(prices_spread_zscore) * 0.3 + abs(prices_spread_compression_velocity) * 0.5)",
    "quote_stuffing": "greatest(0, 1 - orderbook_add_cancel_ratio)",
    "inventory_signal": "CASE WHEN orderbook_depth_imbalance_5 <> 0 OR orderbook_depth_imbalance_10 <> 0 THEN least(1, abs(orderbook_depth_imbalance_5 - orderbook_depth_imbalance_10) * 2) END"},
    "least(1, v)", weights=P.MARKET_MAKER, labels="""CASE WHEN v > 0.7 THEN 'aggressive' WHEN v > 0.3 THEN 'passive' ELSE 'neutral' END AS activity_type,
    CASE WHEN orderbook_depth_imbalance_5 > 0.2 THEN 'long' WHEN orderbook_depth_imbalance_5 < -0.2 THEN 'short' ELSE 'balanced' END AS inventory_bias"""))
def _(t):
    return one(t, P.market_maker_activity)


@query("c7_cascade_risk", uses="ev", doubles="value confidence estimated_trigger_move_pct", sql=sql_signal({
    "liquidation_cluster": """CASE WHEN liquidations_cascade_probability > 0 OR liquidations_liquidation_cluster_detected THEN least(1,
        liquidations_cascade_probability * 0.6 + CASE WHEN liquidations_liquidation_cluster_detected THEN 0.3 ELSE 0 END + least(0.4,
        liquidations_cascade_acceleration)) END""",
    "leverage_stress": """CASE WHEN oi_leverage_index > 1 OR oi_leverage_zscore <> 0 THEN least(1, (oi_leverage_index - 1) * 0.5 +
        abs(oi_leverage_zscore) * 0.3 + oi_liquidation_cascade_risk * 0.5) END""",
    "thin_liquidity": """CASE WHEN orderbook_liquidity_persistence_score < 0.5 OR abs(orderbook_depth_imbalance_10) > 0.3 THEN least(1, (1 -
        orderbook_liquidity_persistence_score) * 0.5 + abs(orderbook_depth_imbalance_10)) END""",
    "funding_pressure": """CASE WHEN abs(funding_funding_zscore) > 1 OR funding_funding_regime <> 'neutral' THEN least(1,
        abs(funding_funding_zscore) / 3 + CASE WHEN funding_funding_regime <> 'neutral' THEN 0.3 ELSE 0 END) END"""},
    "least(1, v)", weights=P.CASCADE, labels="""CASE WHEN v >= 0.8 THEN 'CRITICAL' WHEN v >= 0.6 THEN 'HIGH' WHEN v >= 0.4 THEN 'MEDIUM' ELSE
    'LOW' END AS severity, CASE WHEN liquidations_liquidation_imbalance > 0.3 THEN 'long' WHEN liquidations_liquidation_imbalance < -0.3 THEN
    'short' ELSE 'both' END AS direction, v * 5 AS estimated_trigger_move_pct"""))
def _(t):
    return one(t, P.cascade_risk)


@query("c8_institutional_phase", uses="ev", doubles="value confidence intensity", sql=f"""{FLAT}, p AS (SELECT *, CASE WHEN
       trades_whale_trade_detected OR trades_whale_volume_ratio > 0.1 OR trades_iceberg_detected THEN trades_whale_volume_ratio * 2 + CASE WHEN
       trades_whale_trade_detected THEN 0.3 ELSE 0 END + CASE WHEN trades_iceberg_detected THEN 0.4 ELSE 0 END END AS w, CASE WHEN orderbook_absorption_ratio > 0 THEN orderbook_absorption_ratio END AS a, CASE WHEN
       abs(oi_oi_delta_pct) > 0.5 THEN least(1, abs(oi_oi_delta_pct) / 5) END AS o, least(1, abs(prices_price_vs_vwap / 100) * 10) AS vw FROM f), q AS
       (SELECT *, (CASE WHEN w IS NULL THEN 0 ELSE 1 END + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN o IS NULL THEN 0 ELSE 1 END + 1) AS n,
       CASE WHEN trades_cvd_slope > 0 THEN coalesce(w, 0) * 0.5 ELSE 0 END + CASE WHEN orderbook_depth_imbalance_5 > 0.1 THEN coalesce(a, 0) * 0.4
       ELSE 0 END + CASE WHEN oi_position_intent = 'long_accumulation' THEN coalesce(o, 0) * 0.4 ELSE 0 END + CASE WHEN prices_price_vs_vwap < 0
       THEN vw * 0.3 ELSE 0 END AS ac, CASE WHEN trades_cvd_slope > 0 THEN 0 ELSE coalesce(w, 0) * 0.5 END + CASE WHEN orderbook_depth_imbalance_5 <
       -0.1 THEN coalesce(a, 0) * 0.4 ELSE 0 END + CASE WHEN oi_position_intent IN ('short_accumulation', 'long_liquidation') THEN coalesce(o, 0) *
       0.4 ELSE 0 END + CASE WHEN prices_price_vs_vwap < 0 THEN 0 ELSE vw * 0.3 END AS di FROM p), r AS (SELECT *, CASE WHEN ac + di = 0 THEN
       'NEUTRAL' WHEN ac > di * 1.5 THEN 'ACCUMULATION' WHEN di > ac * 1.5 THEN 'DISTRIBUTION' ELSE 'NEUTRAL' END AS phase FROM q) SELECT event_id,
       least(1, greatest(ac, di)) AS value, n / 4 AS confidence, phase, CASE WHEN ac + di = 0 THEN 0 WHEN phase = 'ACCUMULATION' THEN ac / (ac + di +
       0.001) WHEN phase = 'DISTRIBUTION' THEN di / (ac + di + 0.001) ELSE 0.3 END AS intensity, CASE phase WHEN 'ACCUMULATION' THEN 'higher' WHEN
       'DISTRIBUTION' THEN 'lower' ELSE 'neutral' END AS price_target_direction FROM r WHERE n >= 2""")
def _(t):
    return one(t, P.institutional_phase)


@query("c9_volatility_breakout", uses="ev", doubles="value confidence expected_magnitude_pct", sql=sql_signal({
    "a": """CASE WHEN ticker_volatility_compression_idx > 0 OR ticker_range_vs_atr < 0.8 THEN least(1, ticker_volatility_compression_idx +
        greatest(0, 1 - ticker_range_vs_atr)) END""",
    "b": """CASE WHEN orderbook_liquidity_gradient > 1.2 OR orderbook_liquidity_persistence_score < 0.4 THEN least(1, (orderbook_liquidity_gradient - 1)
        * 0.5 + (1 - orderbook_liquidity_persistence_score) * 0.5) END""",
    "c": "CASE WHEN abs(funding_funding_zscore) > 1 THEN least(1, abs(funding_funding_zscore) / 3) END",
    "d": "CASE WHEN trades_trade_clustering_index > 0.5 THEN least(1, trades_trade_clustering_index) END"}, "least(1, v)",
    extra=", z AS (SELECT 1)", labels="""CASE WHEN CASE WHEN abs(funding_funding_zscore) > 1 THEN -funding_funding_zscore * 0.3 ELSE 0 END + CASE WHEN
    trades_trade_clustering_index > 0.5 THEN trades_cvd_slope * 2 + trades_aggressive_delta * 0.5 ELSE 0 END + oi_oi_delta_pct * 0.3 > 0.3 THEN 'UP' WHEN CASE WHEN abs(funding_funding_zscore) > 1 THEN -funding_funding_zscore * 0.3 ELSE 0 END + CASE WHEN
    trades_trade_clustering_index > 0.5 THEN trades_cvd_slope * 2 + trades_aggressive_delta * 0.5 ELSE 0 END + oi_oi_delta_pct * 0.3 < -0.3 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, v * 3 AS expected_magnitude_pct, CASE WHEN v > 0.7 THEN 4 WHEN v > 0.5
    THEN 12 ELSE 24 END AS timeframe_hours"""))
def _(t):
    return one(t, P.volatility_breakout)


@query("c10_mean_reversion", uses="ev", doubles="value confidence strength expected_reversion_pct", sql=f"""{FLAT}, p AS (SELECT *, CASE WHEN
       abs(prices_mid_zscore) > 1.5 THEN least(1, abs(prices_mid_zscore) / 3) END AS x, funding_funding_zscore > 2 OR funding_funding_percentile > 90 AS
       hot, funding_funding_zscore < -2 OR funding_funding_percentile < 10 AS cold, CASE WHEN abs(mark_prices_basis_zscore) > 2 OR
       mark_prices_dislocation_detected THEN greatest(abs(mark_prices_basis_zscore) / 3, CASE WHEN mark_prices_dislocation_detected THEN 0.5 ELSE 0 END)
       END AS b, CASE WHEN abs(trades_cvd_price_divergence) > 0.3 THEN abs(trades_cvd_price_divergence) END AS d FROM f), q AS (SELECT *, CASE WHEN hot OR
       cold THEN greatest(abs(funding_funding_zscore) / 3, abs(funding_funding_percentile - 50) / 50) END AS fu FROM p), r AS (SELECT *, (CASE WHEN x IS
       NULL THEN 0 ELSE 1 END + CASE WHEN fu IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL THEN 0 ELSE 1 END) AS
       n, CASE WHEN prices_mid_zscore < -1.5 THEN x * 0.5 ELSE 0 END + CASE WHEN cold AND NOT hot THEN fu * 0.3 ELSE 0 END + CASE WHEN
       mark_prices_basis_zscore < -2 THEN b * 0.3 ELSE 0 END + CASE WHEN trades_cvd_price_divergence < -0.3 THEN d * 0.3 ELSE 0 END AS lo, CASE WHEN
       prices_mid_zscore > 1.5 THEN x * 0.5 ELSE 0 END + CASE WHEN hot THEN fu * 0.3 ELSE 0 END + CASE WHEN mark_prices_basis_zscore > 2 THEN b * 0.3 ELSE
       0 END + CASE WHEN trades_cvd_price_divergence > 0.3 THEN d * 0.3 ELSE 0 END AS hi FROM q) SELECT event_id, least(1, greatest(lo, hi)) AS value, n / 4
       AS confidence, CASE WHEN lo > hi * 1.3 THEN 'OVERSOLD' WHEN hi > lo * 1.3 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS signal, CASE WHEN lo > hi * 1.3
       THEN lo / (lo + hi + 0.001) WHEN hi > lo * 1.3 THEN hi / (lo + hi + 0.001) ELSE 0 END AS strength, greatest(lo, hi) * 2 AS expected_reversion_pct
       FROM r WHERE n >= 2""")
def _(t):
    return one(t, P.mean_reversion)


MQ = f"""{FLAT}, m AS (SELECT *, greatest(0, least(1, (0.5 + greatest(-0.5, least(0.5, trades_cvd_slope * 10)) + 0.5 + oi_position_intent_score * 0.5 +
       0.5 + funding_funding_regime_score * 0.25 + 0.5 + orderbook_depth_imbalance_5 * 0.5) / 4)) AS mq, (least(1, orderbook_absorption_ratio) * 0.25 +
       least(1, trades_whale_volume_ratio * 2 + CASE WHEN trades_whale_trade_detected THEN 0.3 ELSE 0 END) * 0.3 + trades_flow_toxicity * 0.2 +
       abs(trades_cvd_price_divergence) * 0.25) AS sm FROM f), h AS (SELECT *, CASE WHEN count(*) OVER (o ROWS 10 PRECEDING) > 10 THEN avg(mq) OVER (o
       ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) - avg(mq) OVER (o ROWS 4 PRECEDING) ELSE 0 END AS weak, CASE WHEN count(*) OVER (o ROWS 9 PRECEDING) >=
       10 THEN avg(sm) OVER (o ROWS 9 PRECEDING) WHEN count(*) OVER (o ROWS 9 PRECEDING) > 5 THEN 0.3 END AS base FROM m WINDOW o AS (PARTITION BY symbol,
       exchange ORDER BY ts, event_id))"""


@query("c11_momentum_exhaustion", uses="ev", doubles="value confidence reversal_probability", sql=f"""{MQ}, p AS (SELECT *, CASE WHEN
       abs(trades_cvd_slope) < 0.01 OR weak > 0.1 THEN greatest(0.1 - abs(trades_cvd_slope), 0) * 10 + weak END AS l, CASE WHEN abs(oi_oi_price_correlation)
       < 0.3 THEN 1 - abs(oi_oi_price_correlation) END AS d, CASE WHEN abs(funding_funding_zscore) > 2 AND abs(funding_funding_momentum) > 0 THEN CASE WHEN
       (funding_funding_zscore > 2 AND funding_funding_momentum < 0) OR (funding_funding_zscore < -2 AND funding_funding_momentum > 0) THEN 0.7 ELSE 0.3 END
       END AS t FROM h), q AS (SELECT *, (CASE WHEN l IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN
       liquidations_exhaustion_signal THEN 1 ELSE 0 END + CASE WHEN t IS NULL THEN 0 ELSE 1 END) AS n, CASE WHEN trades_aggressive_delta > 0 THEN coalesce(l,
       0) * 0.4 ELSE 0 END + CASE WHEN oi_position_intent = 'long_liquidation' THEN coalesce(d, 0) * 0.3 ELSE 0 END + CASE WHEN
       liquidations_exhaustion_signal AND liquidations_liquidation_imbalance < -0.3 THEN 0.5 ELSE 0 END + CASE WHEN funding_funding_zscore > 2 AND
       funding_funding_momentum < 0 THEN t * 0.3 ELSE 0 END AS bu, CASE WHEN trades_aggressive_delta > 0 THEN 0 ELSE coalesce(l, 0) * 0.4 END + CASE WHEN
       oi_position_intent IN ('short_accumulation', 'long_accumulation') THEN coalesce(d, 0) * 0.3 ELSE 0 END + CASE WHEN liquidations_exhaustion_signal AND
       liquidations_liquidation_imbalance > 0.3 THEN 0.5 ELSE 0 END + CASE WHEN funding_funding_zscore < -2 AND funding_funding_momentum > 0 THEN t * 0.3 ELSE
       0 END AS be FROM p) SELECT event_id, least(1, greatest(bu, be)) AS value, n / 4 AS confidence, greatest(bu, be) > 0.5 AS exhaustion, CASE WHEN bu > be
       THEN 'bullish' ELSE 'bearish' END AS trend_direction, greatest(bu, be) * 0.8 AS reversal_probability FROM q WHERE n >= 2""")
def _(t):
    out = P.all_signals(cache(t), names=["momentum_exhaustion"]).where("momentum_exhaustion IS NOT NULL")
    return out.select("event_id", "momentum_exhaustion.*").drop("components")


@query("c12_smart_money_flow", uses="ev", doubles="value confidence strength volume_estimate", sql=f"""{FLAT}, p AS (SELECT *, CASE WHEN
       trades_whale_trade_detected OR trades_whale_volume_ratio > 0.05 THEN (trades_buy_pressure - trades_sell_pressure) * trades_whale_volume_ratio * 5 END AS
       w, CASE WHEN trades_aggressive_ratio <> 0.5 OR trades_cvd_slope <> 0 THEN (trades_aggressive_ratio - 0.5) * 2 + trades_cvd_slope * 10 END AS a, CASE WHEN
       orderbook_depth_imbalance_5 <> 0 OR orderbook_depth_imbalance_10 <> 0 THEN (orderbook_depth_imbalance_5 + orderbook_depth_imbalance_10) / 2 END AS d, CASE
       WHEN abs(oi_oi_delta_pct) > 0.5 OR abs(oi_long_short_ratio - 1) > 0.1 THEN sign(oi_oi_delta_pct) * least(1, abs(oi_oi_delta_pct) / 5) +
       (oi_long_short_ratio - 1) * 0.5 END AS o FROM f), q AS (SELECT *, (CASE WHEN w IS NULL THEN 0 ELSE 1 END + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE
       WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN o IS NULL THEN 0 ELSE 1 END) AS n, greatest(-1, least(1, coalesce(w, 0) * 0.4 + coalesce(a, 0) * 0.3 +
       coalesce(d, 0) * 0.2 + coalesce(o, 0) * 0.2)) AS v FROM p) SELECT event_id, v AS value, n / 4 AS confidence, CASE WHEN v > 0.2 THEN 'BUYING' WHEN v <
       -0.2 THEN 'SELLING' ELSE 'NEUTRAL' END AS direction, abs(v) AS strength, CASE WHEN trades_whale_volume_ratio > 0 THEN ticker_volume *
       ticker_institutional_interest_idx * trades_whale_volume_ratio ELSE 0 END AS volume_estimate FROM q WHERE n >= 2""")
def _(t):
    return one(t, P.smart_money_flow)


@query("c13_arbitrage_opportunity", uses="ev", doubles="value confidence expected_return_pct_annual", sql=f"""{FLAT}, p AS (SELECT *, CASE WHEN
       abs(funding_funding_carry_yield) > 0.1 THEN abs(funding_funding_carry_yield) ELSE 0 END AS fu, CASE WHEN abs(mark_prices_annualized_basis) > 0.1 OR
       abs(mark_prices_basis_zscore) > 2 THEN abs(mark_prices_annualized_basis) ELSE 0 END AS ba, (1 + CASE WHEN abs(funding_funding_carry_yield) > 0.1 THEN 1
       ELSE 0 END + CASE WHEN abs(mark_prices_annualized_basis) > 0.1 OR abs(mark_prices_basis_zscore) > 2 THEN 1 ELSE 0 END) AS n, orderbook_spread /
       mark_prices_mark_price * 10000 AS bps FROM f), q AS (SELECT *, greatest(0, 1 - CASE WHEN bps > 5 THEN (bps - 5) * 0.1 ELSE 0 END - CASE WHEN ticker_volume
       < 100 THEN 0.3 ELSE 0 END) AS ex, CASE WHEN fu > ba AND fu > 0.1 THEN 'funding' WHEN ba > fu AND ba > 0.1 THEN 'basis' WHEN fu > 0.05 AND ba > 0.05 THEN
       'combined' ELSE 'none' END AS type FROM p), r AS (SELECT *, least(1, (fu + ba) * 2) * ex AS v FROM q) SELECT event_id, v AS value, n / 3 AS confidence, v >
       0.3 AND type <> 'none' AS opportunity, type, CASE type WHEN 'funding' THEN fu WHEN 'basis' THEN ba WHEN 'combined' THEN fu + ba ELSE 0 END * 100 AS
       expected_return_pct_annual, CASE WHEN ex > 0.8 AND abs(mark_prices_basis_zscore) < 3 THEN 'LOW' WHEN ex > 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
       FROM r WHERE n >= 2""")
def _(t):
    return one(t, P.arbitrage_opportunity)


@query("c14_regime_transition", uses="ev", doubles="value confidence transition_probability", sql=f"""{MQ}, p AS (SELECT *, CASE WHEN
       ticker_price_change_pct > 3 AND ticker_market_strength > 0.6 THEN 'BULL' WHEN ticker_price_change_pct < -3 AND ticker_market_strength < 0.4 THEN 'BEAR'
       ELSE 'RANGING' END AS now, CASE WHEN ticker_volatility_compression_idx > 0.5 OR ticker_volatility_expansion_idx > 0.5 THEN
       greatest(ticker_volatility_compression_idx, ticker_volatility_expansion_idx) END AS vo, CASE WHEN base IS NULL THEN 0 ELSE greatest(0,
       trades_flow_toxicity - base) END AS sp, CASE WHEN abs(funding_funding_zscore) > 2 THEN abs(funding_funding_zscore) / 3 END AS fu, CASE WHEN
       oi_leverage_index > 1.5 OR oi_position_crowding_score > 0.7 THEN (oi_leverage_index - 1) * 0.5 + oi_position_crowding_score * 0.5 END AS pk FROM h), q AS
       (SELECT *, CASE WHEN sp > 0.2 OR trades_flow_toxicity > 0.6 THEN least(1, sp + trades_flow_toxicity * 0.5) END AS fl FROM p), r AS (SELECT *, coalesce(vo,
       0) * 0.3 + coalesce(fl, 0) * 0.3 + coalesce(fu, 0) * 0.2 + coalesce(pk, 0) * 0.2 AS s, (CASE WHEN vo IS NULL THEN 0 ELSE 1 END + CASE WHEN fl IS NULL
       THEN 0 ELSE 1 END + CASE WHEN fu IS NULL THEN 0 ELSE 1 END + CASE WHEN pk IS NULL THEN 0 ELSE 1 END) AS n FROM q) SELECT event_id, least(1, s) AS value, n
       / 4 AS confidence, now AS current_regime, CASE WHEN s <= 0.5 THEN now WHEN now = 'BULL' THEN CASE WHEN funding_funding_zscore > 2 THEN 'BEAR' ELSE
       'RANGING' END WHEN now = 'BEAR' THEN CASE WHEN funding_funding_zscore < -2 THEN 'BULL' ELSE 'RANGING' END WHEN ticker_market_strength > 0.5 THEN 'BULL'
       ELSE 'BEAR' END AS predicted_regime, least(1, s) AS transition_probability, CASE WHEN ticker_volatility_compression_idx > 0.7 THEN 6 WHEN s > 0.7 THEN 12
       ELSE 24 END AS timeframe_hours FROM r WHERE n >= 2""")
def _(t):
    out = P.all_signals(cache(t), names=["regime_transition"]).where("regime_transition IS NOT NULL")
    return out.select("event_id", "regime_transition.*").drop("components")


@query("c15_execution_quality", uses="ev", doubles="value confidence slippage_estimate_bps max_size_no_impact", sql=sql_signal({
    "a": "least(1, (orderbook_bid_depth_10 + orderbook_ask_depth_10) / 100) * 0.6 + orderbook_liquidity_persistence_score * 0.4",
    "b": """CASE WHEN prices_spread_zscore < 0 THEN least(1, greatest(0, 1 - prices_spread_bps / 20) + abs(prices_spread_zscore) * 0.1) ELSE greatest(0, 1 -
        prices_spread_bps / 20) END""", "c": "greatest(0, 1 - (trades_trade_clustering_index * 0.5 + abs(trades_aggressive_ratio - 0.5)))",
    "d": "least(1, ticker_relative_volume_percentile / 100)"}, "least(1, v)", labels="""CASE WHEN v > 0.8 THEN 'EXCELLENT' WHEN v > 0.6 THEN 'GOOD' WHEN v >
    0.4 THEN 'FAIR' ELSE 'POOR' END AS quality, prices_spread_bps / 2 + (1 - c) * 10 AS slippage_estimate_bps, (orderbook_bid_depth_10 +
    orderbook_ask_depth_10) * v * 0.1 AS max_size_no_impact, CASE WHEN v > 0.8 THEN 1 WHEN v > 0.6 THEN 3 WHEN v > 0.4 THEN 5 ELSE 10 END AS
    optimal_order_splits"""))
def _(t):
    return one(t, P.execution_quality)


# A long table of signals from the events: five signals, one per event type, value and confidence from the row.
LONG = """l AS (SELECT event_id, symbol, 'x' AS exchange, ts, CASE exchange WHEN 'click' THEN 'smart_money_index' WHEN 'view' THEN 'institutional_phase' WHEN
       'purchase' THEN 'volatility_breakout' WHEN 'error' THEN 'liquidation_cascade_risk' ELSE 'mean_reversion' END AS signal, (k + 1) / 101e0 AS value,
       (event_id % 4 + 1) / 4e0 AS confidence, CASE WHEN exchange = 'purchase' AND event_id % 3 = 0 THEN 'UP' WHEN exchange = 'purchase' AND event_id % 3 = 1
       THEN 'NEUTRAL' END AS direction_word, CASE WHEN exchange = 'view' AND event_id % 2 = 0 THEN 'DISTRIBUTION' END AS phase_word, CASE WHEN exchange =
       'signup' AND event_id % 2 = 0 THEN 'OVERSOLD' END AS signal_word FROM ev), m AS (SELECT *, CASE signal WHEN 'smart_money_index' THEN 0.6 ELSE 0.5 END AS
       th, CASE signal WHEN 'smart_money_index' THEN 1.2e0 WHEN 'institutional_phase' THEN 1.3e0 WHEN 'volatility_breakout' THEN 1.2e0 WHEN
       'liquidation_cascade_risk' THEN 1.4e0 ELSE 1.0e0 END AS w, signal = 'liquidation_cascade_risk' AS inv, CASE signal WHEN 'smart_money_index' THEN 'flow'
       WHEN 'institutional_phase' THEN 'flow' WHEN 'liquidation_cascade_risk' THEN 'risk' ELSE 'timing' END AS category FROM l), r AS (SELECT *, CASE WHEN
       count(*) OVER h < 2 THEN 1 ELSE 0.8 + least(stddev_pop(value) OVER h * 0.4, 0.4) END AS rec FROM m WINDOW h AS (PARTITION BY symbol, exchange, signal ORDER
       BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), rk AS (SELECT *, greatest(0, least(2, abs(value - 0.5) * 2 * w * (1 + (confidence - 0.5) *
       0.3) * rec)) AS rank_score, CASE WHEN direction_word = 'UP' THEN 'bullish' WHEN direction_word IS NOT NULL THEN 'neutral' WHEN phase_word IS NOT NULL THEN
       'bearish' WHEN signal_word IS NOT NULL THEN 'bullish' WHEN inv THEN CASE WHEN value < th * 0.8 THEN 'bullish' WHEN value > th * 1.2 THEN 'bearish' ELSE
       'neutral' END WHEN value > th * 1.2 THEN 'bullish' WHEN value < th * 0.8 THEN 'bearish' ELSE 'neutral' END AS direction FROM r)"""


def long_rows(t):
    s = (F.when(C("exchange") == "click", "smart_money_index").when(C("exchange") == "view", "institutional_phase")
         .when(C("exchange") == "purchase", "volatility_breakout").when(C("exchange") == "error", "liquidation_cascade_risk")
         .otherwise("mean_reversion"))
    e, x = C("event_id"), C("exchange")
    return t.ev.select(
        "event_id", "symbol", F.lit("x").alias("exchange"), "ts", s.alias("signal"), ((C("k") + 1) / F.lit(101.0)).alias("value"),
        ((e % 4 + 1) / F.lit(4.0)).alias("confidence"),
        F.when((x == "purchase") & (e % 3 == 0), "UP").when((x == "purchase") & (e % 3 == 1), "NEUTRAL").alias("direction_word"),
        F.when((x == "view") & (e % 2 == 0), "DISTRIBUTION").alias("phase_word"),
        F.when((x == "signup") & (e % 2 == 0), "OVERSOLD").alias("signal_word"))


@query("c16_c17_rank_signals", uses="ev", doubles="rank_score", sql=f"WITH {LONG} SELECT event_id, signal, category, direction, rank_score FROM rk")
def _(t):
    return P.rank_signals(long_rows(t)).select("event_id", "signal", "category", "direction", "rank_score")


# Updates of six hours: the newest row of every signal in the window stands for the update.
UPDATE = f"""{LONG}, u AS (SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS ts, signal, arg_max(category, ts) AS category, arg_max(value, ts) AS value,
       arg_max(confidence, ts) AS confidence, arg_max(direction, ts) AS direction, arg_max(rank_score, ts) AS rank_score FROM rk GROUP BY 1, 2, 3), pa AS
       (SELECT *, rank_score * CASE WHEN signal IN ('smart_money_index', 'institutional_phase') THEN greatest(0.5, 1 - 0.1 * (row_number() OVER (PARTITION BY
       symbol, ts, signal IN ('smart_money_index', 'institutional_phase') ORDER BY rank_score DESC, CASE signal WHEN 'smart_money_index' THEN 0 ELSE 1 END) - 1))
       ELSE 1 END AS s1 FROM u), pb AS (SELECT symbol, ts, signal, category, value, confidence, direction, s1 * CASE WHEN signal IN ('mean_reversion',
       'volatility_breakout') THEN greatest(0.5, 1 - 0.1 * (row_number() OVER (PARTITION BY symbol, ts, signal IN ('mean_reversion', 'volatility_breakout') ORDER
       BY s1 DESC, CASE signal WHEN 'volatility_breakout' THEN 0 ELSE 1 END) - 1)) ELSE 1 END AS rank_score FROM pa)"""


def updates(t):
    r = P.rank_signals(long_rows(t))
    cols = ["category", "value", "confidence", "direction", "rank_score"]
    u = (r.groupBy("symbol", "exchange", F.window("ts", "6 hours").start.alias("ts"), "signal")
         .agg(F.max_by(F.struct(*cols), "ts").alias("r")).select("symbol", "exchange", "ts", "signal", "r.*"))
    return P.correlation_penalty(u, order=("ts",))


@query("c18_correlation_penalty", uses="ev", doubles="rank_score", sql=f"WITH {UPDATE} SELECT symbol, ts, signal, rank_score FROM pb")
def _(t):
    return updates(t).select("symbol", "ts", "signal", "rank_score")


SIDES = f"""{UPDATE}, sd AS (SELECT symbol, ts, sum(CASE WHEN direction = 'bullish' THEN rank_score * confidence ELSE 0 END) AS b, sum(CASE WHEN direction =
       'bearish' THEN rank_score * confidence ELSE 0 END) AS s, sum(CASE WHEN direction = 'neutral' THEN rank_score * confidence * 0.5 ELSE 0 END) AS fl, count(*)
       FILTER (direction = 'bullish') AS nb, count(*) FILTER (direction = 'bearish') AS ns, avg(value) FILTER (category = 'risk') AS rk_, avg(value) FILTER
       (category = 'timing') AS ti, max(value) FILTER (signal = 'liquidation_cascade_risk') AS ca, max(value) FILTER (signal = 'volatility_breakout') AS vb,
       max(value) FILTER (signal = 'mean_reversion') AS mr FROM pb GROUP BY 1, 2), cf AS (SELECT *, nb > 0 AND ns > 0 AND b + s > 0 AS both_ FROM sd), sv AS
       (SELECT *, CASE WHEN NOT both_ THEN 'none' WHEN least(b, s) / (b + s) < 0.15 THEN 'minor' WHEN least(b, s) / (b + s) < 0.3 THEN 'moderate' WHEN least(b, s)
       / (b + s) < 0.45 THEN 'severe' ELSE 'critical' END AS sev FROM cf), bi AS (SELECT *, CASE WHEN b + s + fl = 0 THEN 'neutral' WHEN b > s * 1.2 THEN
       'bullish' WHEN s > b * 1.2 THEN 'bearish' ELSE 'neutral' END AS bias FROM sv), bc AS (SELECT *, CASE WHEN b + s + fl = 0 THEN 0 ELSE greatest(0, least(1,
       CASE WHEN bias = 'neutral' THEN 1 - abs(b - s) / (b + s + fl) ELSE abs(b - s) / (b + s + fl) END * CASE WHEN sev IN ('severe', 'critical') THEN 0.7 ELSE 1
       END)) END AS conf FROM bi)"""


@query("c19_detect_conflicts", uses="ev", doubles="resolution_confidence", sql=f"""WITH {SIDES} SELECT symbol, ts, sev AS conflict_severity, CASE WHEN both_ THEN
       CASE WHEN b > s THEN 'bullish' WHEN s > b THEN 'bearish' ELSE 'neutral' END END AS resolution, CASE WHEN both_ THEN abs(b - s) / (b + s) END AS
       resolution_confidence FROM bc""")
def _(t):
    return P.detect_conflicts(updates(t), order=("ts",)).select("symbol", "ts", "conflict_severity", "resolution", "resolution_confidence")


@query("c20_market_bias", uses="ev", doubles="bias_confidence", sql=f"WITH {SIDES} SELECT symbol, ts, bias AS market_bias, conf AS bias_confidence FROM bc")
def _(t):
    return P.market_bias(updates(t), order=("ts",)).select("symbol", "ts", "market_bias", "bias_confidence")


@query("c20_category_scores", uses="ev", doubles="score", sql=f"WITH {UPDATE} SELECT symbol, ts, category, avg(value) AS score, count(*) AS signals FROM pb GROUP BY 1, 2, 3")
def _(t):
    return P.category_scores(updates(t), order=("ts",)).drop("exchange")


@query("c21_recommend", uses="ev", doubles="risk_score", sql=f"""WITH {SIDES}, st AS (SELECT *, CASE WHEN sev = 'critical' THEN 'conflicted' WHEN conf > 0.7 AND sev =
       'severe' THEN 'moderate' WHEN conf > 0.7 THEN 'strong' WHEN conf > 0.4 THEN 'moderate' WHEN conf > 0.2 THEN 'weak' ELSE 'no_action' END AS strength,
       round(CASE WHEN coalesce(rk_, 0.5) > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN ca > 0.7 THEN 0.3 ELSE 0 END + CASE sev WHEN 'critical' THEN 0.3 WHEN 'severe'
       THEN 0.2 ELSE 0 END, 6) AS risk_score FROM bc), rl AS (SELECT *, CASE WHEN risk_score > 0.7 THEN 'extreme' WHEN risk_score > 0.5 THEN 'high' WHEN
       risk_score > 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM st) SELECT symbol, ts, strength, risk_score, risk_level, (SELECT
       list(signal ORDER BY rank_score DESC)[1:3] FROM pb WHERE pb.symbol = rl.symbol AND pb.ts = rl.ts AND pb.direction = rl.bias) AS primary_signals, CASE WHEN
       strength IN ('conflicted', 'no_action') OR risk_level = 'extreme' THEN 'wait' WHEN risk_level = 'low' AND strength = 'strong' THEN 'aggressive' ELSE
       'conservative' END AS entry_bias, CASE WHEN vb > 0.7 THEN 'soon' WHEN abs(mr - 0.5) > 0.3 THEN 'patient' WHEN coalesce(ti, 0.5) > 0.6 THEN 'soon' ELSE
       'patient' END AS urgency FROM rl""")
def _(t):
    r = P.recommend(updates(t), order=("ts",))
    return r.select("symbol", "ts", "strength", "risk_score", "risk_level",
                    F.when(F.size("primary_signals") > 0, C("primary_signals")).alias("primary_signals"), "entry_bias", "urgency")


@query("c22_signal_dashboard", uses="ev", doubles="confidence strength", sql=f"""WITH {LONG}, d AS (SELECT symbol, signal, arg_max(direction, ts) AS d, arg_max(value,
       ts) AS v, arg_max(confidence, ts) AS c FROM rk GROUP BY 1, 2), g AS (SELECT symbol, count(*) AS signals, count(*) FILTER (d = 'bullish') AS bullish_count,
       count(*) FILTER (d = 'bearish') AS bearish_count, avg(c) AS confidence, count(*) FILTER (abs(v) > 0.3) AS active_signals FROM d GROUP BY 1) SELECT *, signals -
       bullish_count - bearish_count AS neutral_count, CASE WHEN bullish_count - bearish_count > 2 THEN 'bullish' WHEN bullish_count - bearish_count < -2 THEN
       'bearish' ELSE 'neutral' END AS bias, CASE WHEN abs(bullish_count - bearish_count) > 2 THEN abs(bullish_count - bearish_count) / signals ELSE 0 END AS
       strength FROM g""")
def _(t):
    return P.signal_dashboard(P.rank_signals(long_rows(t)))


@query("c23_feature_candles", uses="prices funding", digits=9, doubles="funding_rate_last", sql="""SELECT p.*, f.funding_rate_last FROM (SELECT symbol, exchange, time_bucket(INTERVAL '4 hours', ts)
       AS bucket, arg_min(mid_price, ts) AS open, max(mid_price) AS high, min(mid_price) AS low, arg_max(mid_price, ts) AS close, count(*) AS ticks FROM prices
       GROUP BY 1, 2, 3) p LEFT JOIN (SELECT symbol, exchange, time_bucket(INTERVAL '4 hours', ts) AS bucket, arg_max(funding_rate, ts) AS funding_rate_last FROM
       funding GROUP BY 1, 2, 3) f USING (symbol, exchange, bucket)""")
def _(t):
    return P.feature_candles(t.prices, t.funding, "4 hours", ["funding_rate"])


@query("c24_liquidity_heatmap", uses="books", doubles="imbalance_ratio price size strength depth_pct", sql="""WITH t AS (SELECT *, list_sum([x.qty for x in bids]) AS b,
       list_sum([x.qty for x in asks]) AS a, list_max([x.qty for x in list_concat(bids, asks)]) AS m FROM books), l AS (SELECT symbol, ts, b, a, m, 'bid' AS side,
       'support_wall' AS w, unnest(range(1, 11)) AS level, unnest(bids) AS x FROM t UNION ALL SELECT symbol, ts, b, a, m, 'ask', 'resistance_wall',
       unnest(range(1, 11)), unnest(asks) FROM t) SELECT symbol, ts, (b - a) / (b + a) AS imbalance_ratio, side, CAST(level AS INTEGER) AS level, x.price AS price,
       x.qty AS size, CASE WHEN x.qty / m > 0.5 THEN w END AS wall_type, x.qty / m AS strength, level / 10 AS depth_pct, CASE WHEN (b - a) / (b + a) > 0.1 THEN
       'bid_heavy' WHEN (b - a) / (b + a) < -0.1 THEN 'ask_heavy' ELSE 'balanced' END AS distribution FROM l""")
def _(t):
    return P.liquidity_heatmap(t.books)


@query("c25_regime_timeline", uses="hourly", sql="""WITH l AS (SELECT *, CASE WHEN value > 60 THEN 'HIGH' WHEN value > 40 THEN 'NORMAL' ELSE 'LOW' END AS regime FROM
       hourly), f AS (SELECT *, CASE WHEN lag(regime) OVER w <> regime THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY series ORDER BY ts)), i AS (SELECT
       *, sum(new) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f), r AS (SELECT series, island, regime, count(*) AS length,
       min(ts) AS start, max(ts) AS "end" FROM i GROUP BY 1, 2, 3) SELECT series, regime, length, start, "end", lag(regime) OVER (PARTITION BY series ORDER BY
       start) AS previous, CAST(epoch("end" - start) AS BIGINT) AS duration_seconds FROM r""")
def _(t):
    from tickloom.checks.windows import labelled
    return P.regime_timeline(labelled(t), ["series"], ["ts"], "regime")


def raw_streams(t):
    return {"prices": t.quotes, "orderbook": t.timed_books, "trades": t.trades, "funding": t.funding, "oi": t.oi, "liquidations": t.liquidations,
            "mark_prices": t.marks, "ticker": t.ticker}


@query("c0_signals_from_raw_streams")
def _(t):
    """All calculators, the newest features of every stream, all fifteen signals and the recommendation at every update.

    The counting passes read the events' fields, features and signals as stored, each computed once; ranked rows are dealt by update once.
    """
    from tickloom.checks.institutional import VENUES
    features = kept(P.market_features(raw_streams(t.parsed()), every="6 hours", venues=VENUES, cluster_ms=7_200_000), "c0-features")
    long = kept(P.signal_rows(P.all_signals(features, by=["symbol"]), ["symbol"]), "c0-signals")
    return P.recommend(P.correlation_penalty(P.rank_signals(long, ["symbol"]), ["symbol"]), ["symbol"])
