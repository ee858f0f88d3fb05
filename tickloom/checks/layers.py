"""Market analytics layers and venue reports (L)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickloom.checks.joins import LATEST, RETURNS, latest_price, returns_grid
from tickloom.checks.registry import SQL, query
from tickloom.checks.windows import CASCADE_SQL
from tickloom.plans import layers as L

C = F.col
E = "6 hours"
TB = "time_bucket(INTERVAL '6 hours', ts)"


def _band(n):
    lo, hi = repr(1 - n * 0.0001), repr(1 + n * 0.0001)
    b = f"coalesce(list_sum([x.qty for x in bids if x.price >= mid * {lo}e0]), 0)"
    a = f"coalesce(list_sum([x.qty for x in asks if x.price <= mid * {hi}e0]), 0)"
    return f"CASE WHEN {b} + {a} = 0 THEN 0 ELSE ({b} - {a}) / ({b} + {a}) END AS imbalance_{n}_ticks"


@query("l1_liquidity_imbalance", uses="books", doubles="imbalance_10_ticks imbalance_25_ticks imbalance_50_ticks imbalance_ratio velocity confidence",
       sql=f"""WITH m AS (SELECT *, (bids[1].price + asks[1].price) / 2 AS mid, list_sum([x.qty for x in bids]) AS b, list_sum([x.qty for x in
       asks]) AS a FROM books), r AS (SELECT *, {_band(10)}, {_band(25)}, {_band(50)}, (b - a) / (b + a) AS r FROM m) SELECT vec_id, imbalance_10_ticks,
       imbalance_25_ticks, imbalance_50_ticks, r AS imbalance_ratio, r - lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS velocity, CASE WHEN r > 0.3 THEN
       'STRONG_BUY_PRESSURE' WHEN r > 0.15 THEN 'BUY_PRESSURE' WHEN r < -0.3 THEN 'STRONG_SELL_PRESSURE' WHEN r < -0.15 THEN 'SELL_PRESSURE' ELSE 'NEUTRAL'
       END AS signal, CASE WHEN abs(r) > 0.3 THEN least(abs(r) * 100, 100) WHEN abs(r) > 0.15 THEN least(abs(r) * 100, 80) ELSE 50 END AS confidence FROM r""")
def _(t):
    return L.liquidity_imbalance(t.books).select("vec_id", "imbalance_10_ticks", "imbalance_25_ticks", "imbalance_50_ticks",
                                                 "imbalance_ratio", "velocity", "signal", "confidence")


def _within(n):
    return (f"coalesce(list_sum([x.qty for x in bids if x.price >= mid - mid * {n} / 10000]), 0) + "
            f"coalesce(list_sum([x.qty for x in asks if x.price <= mid + mid * {n} / 10000]), 0)")


@query("l2_liquidity_vacuum", uses="books", doubles="depth_25bps depth_50bps spread_bps vacuum_score", sql=f"""WITH m AS (SELECT *, (bids[1].price +
       asks[1].price) / 2 AS mid FROM books), d AS (SELECT *, {_within(10)} AS d10, {_within(25)} AS d25, {_within(50)} AS d50, (asks[1].price - bids[1].price) /
       mid * 10000 AS bps, least(5, len([i for i in range(2, 11) if abs(bids[i].price - bids[i - 1].price) / mid * 100 > 0.1])) + least(5, len([i for i in
       range(2, 11) if abs(asks[i].price - asks[i - 1].price) / mid * 100 > 0.1])) AS tz FROM m), v AS (SELECT *, (0.7 * (1 - least(d10 / 20, 1)) + 0.3 *
       least(bps / 10, 1)) * 100 AS v FROM d) SELECT vec_id, d25 AS depth_25bps, d50 AS depth_50bps, bps AS spread_bps, CAST(tz AS INTEGER) AS thin_zones, v AS
       vacuum_score, CASE WHEN v > 70 THEN 'EXTREME' WHEN v > 50 THEN 'HIGH' WHEN v > 30 THEN 'MODERATE' ELSE 'LOW' END AS slippage_risk, CASE WHEN v > 70 THEN
       85 WHEN v > 50 THEN 65 WHEN v > 30 THEN 40 ELSE 20 END AS breakout_probability FROM v""")
def _(t):
    return L.liquidity_vacuum(t.books, typical_depth=20.0).select(
        "vec_id", "depth_25bps", "depth_50bps", "spread_bps", "thin_zones", "vacuum_score", "slippage_risk", "breakout_probability")


def venues(books):
    return books.withColumn("exchange", F.concat(F.lit("X"), (C("vec_id") % 3).cast("string")))


@query("l3_orderbook_persistence", uses="books", doubles="price avg_size size_variance persistence_pct reliability overall_score", sql="""WITH l AS (SELECT *, 'X' || (vec_id % 3) AS exchange FROM
       books QUALIFY row_number() OVER (PARTITION BY symbol, exchange ORDER BY ts DESC, vec_id DESC) <= 60), n AS (SELECT symbol, exchange, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 5),
       x AS (SELECT symbol, exchange, 'support' AS zone, unnest(bids[1:20]) AS v FROM l UNION ALL SELECT symbol, exchange, 'resistance', unnest(asks[1:20]) FROM l), g AS (SELECT symbol,
       exchange, zone, round(v.price, 8) AS price, count(*) AS c, avg(v.qty) AS avg_size, var_pop(v.qty) AS size_variance FROM x GROUP BY 1, 2, 3, 4), p AS (SELECT symbol, exchange, zone,
       price, avg_size, size_variance, c / n * 100 AS persistence_pct, CASE WHEN avg_size > 0 THEN c / n * 100 * (1 - least(size_variance / avg_size, 1)) ELSE 0 END AS reliability FROM g
       JOIN n USING (symbol, exchange) WHERE c / n * 100 >= 50), v AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol, exchange, zone ORDER BY reliability DESC, price) <= 5),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, zone ORDER BY reliability DESC, exchange, price) AS INTEGER) AS rank FROM v) SELECT *, avg(reliability) OVER (PARTITION
       BY symbol) AS overall_score FROM r WHERE rank <= 10""")
def _(t):
    return L.orderbook_persistence(venues(t.books), tie="vec_id")


@query("l4_trade_aggression", uses="trades", doubles="buy_volume sell_volume delta delta_pct cvd delta_acceleration", sql=f"""WITH t AS (SELECT *, {TB} AS bucket FROM
       trades), b AS (SELECT symbol, bucket, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0
       END) AS sell_volume, count(*) AS trade_count, avg(quantity) AS a FROM t GROUP BY 1, 2), g AS (SELECT t.symbol, t.bucket, count(*) FILTER (quantity >= a * 5)
       AS large_trades FROM t JOIN b ON t.symbol = b.symbol AND t.bucket = b.bucket GROUP BY 1, 2), d AS (SELECT b.symbol, b.bucket, buy_volume, sell_volume,
       trade_count, large_trades, buy_volume - sell_volume AS delta, (buy_volume - sell_volume) / (buy_volume + sell_volume) * 100 AS delta_pct FROM b JOIN g ON
       b.symbol = g.symbol AND b.bucket = g.bucket) SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY bucket) AS cvd, delta - lag(delta) OVER (PARTITION BY
       symbol ORDER BY bucket) AS delta_acceleration, CASE WHEN delta_pct > 20 THEN 'STRONG_BUYERS' WHEN delta_pct > 10 THEN 'BUYERS' WHEN delta_pct < -20 THEN
       'STRONG_SELLERS' WHEN delta_pct < -10 THEN 'SELLERS' ELSE 'BALANCED' END AS aggressor FROM d""")
def _(t):
    return L.trade_aggression(t.trades, E)


@query("l5_microstructure", uses="trades", doubles="total_value micro_volatility price_impact slippage_per_million efficiency_score", sql=f"""WITH t AS (SELECT *, {TB} AS
       bucket FROM trades), m AS (SELECT *, CASE WHEN lag(bucket) OVER o = bucket THEN abs(price - lag(price) OVER o) END AS mv FROM t WINDOW o AS (PARTITION BY symbol
       ORDER BY ts)), g AS (SELECT symbol, bucket, arg_min(price, ts) AS p0, arg_max(price, ts) AS p1, sum(quantity) AS total_volume, sum(price * quantity) AS
       total_value, stddev_pop(mv) AS micro_volatility, count(*) AS trade_count FROM m GROUP BY 1, 2 HAVING count(*) >= 2), h AS (SELECT symbol, bucket,
       total_volume, total_value, micro_volatility, trade_count, abs(p1 - p0) / total_volume AS price_impact, abs(p1 - p0) / p0 * 100 / (total_value / 1e6) AS
       slippage_per_million FROM g), s AS (SELECT *, (greatest(0, 100 - price_impact * 10000) + greatest(0, 100 - micro_volatility * 100)) / 2 AS efficiency_score
       FROM h) SELECT *, CASE WHEN efficiency_score > 80 THEN 'EXCELLENT' WHEN efficiency_score > 60 THEN 'GOOD' WHEN efficiency_score > 40 THEN 'NORMAL' WHEN
       efficiency_score > 20 THEN 'POOR' ELSE 'FRAGILE' END AS market_quality FROM s""")
def _(t):
    return L.microstructure(t.trades, E)


OI_SQL = f"""v AS (SELECT symbol, exchange, {TB} AS bucket, arg_max(open_interest, ts) AS v, arg_max(price, ts) AS p FROM oi GROUP BY 1, 2, 3), o AS (SELECT symbol,
       bucket, sum(v) AS total_oi, avg(p) AS avg_price FROM v GROUP BY 1, 2), c AS (SELECT *, (total_oi - lag(total_oi) OVER w) / lag(total_oi) OVER w * 100 AS oc,
       (avg_price - lag(avg_price) OVER w) / lag(avg_price) OVER w * 100 AS pc FROM o WINDOW w AS (PARTITION BY symbol ORDER BY bucket)), i AS (SELECT *, CASE WHEN
       pc > 0.05 AND oc > 0.1 THEN 'LONGS_OPENING' WHEN pc < -0.05 AND oc > 0.1 THEN 'SHORTS_OPENING' WHEN pc > 0.05 AND oc < -0.1 THEN 'SHORTS_CLOSING' WHEN pc <
       -0.05 AND oc < -0.1 THEN 'LONGS_CLOSING' ELSE 'CONSOLIDATION' END AS position_intent FROM c WHERE oc IS NOT NULL)"""


@query("l6_oi_flow", uses="oi", doubles="oi_change_pct price_change_pct position_intent_score", sql=f"""WITH {OI_SQL} SELECT symbol, bucket, oc AS oi_change_pct, pc AS
       price_change_pct, position_intent, CASE position_intent WHEN 'LONGS_OPENING' THEN least(abs(oc + pc) * 10, 100) WHEN 'SHORTS_OPENING' THEN -least(abs(oc +
       abs(pc)) * 10, 100) WHEN 'SHORTS_CLOSING' THEN least(abs(pc) * 10, 80) WHEN 'LONGS_CLOSING' THEN -least(abs(pc) * 10, 80) ELSE 0 END AS
       position_intent_score FROM i""")
def _(t):
    return L.oi_flow(t.oi, E).drop("total_oi", "avg_price", "venues")


@query("l7_leverage_index", uses="oi ticker", doubles="leverage_index leverage_zscore", sql=f"""WITH o AS (SELECT symbol, exchange, {TB} AS bucket, arg_max(open_interest, ts)
       AS o FROM oi GROUP BY 1, 2, 3), k AS (SELECT symbol, exchange, {TB} AS bucket, arg_max(volume_24h, ts) AS v FROM ticker GROUP BY 1, 2, 3), d AS (SELECT
       symbol, bucket, avg(o / v) AS leverage_index FROM o JOIN k USING (symbol, exchange, bucket) GROUP BY 1, 2), z AS (SELECT *, (leverage_index - 1) / 0.5 AS
       leverage_zscore FROM d) SELECT *, CASE WHEN leverage_zscore > 2 THEN 'EXTREME' WHEN leverage_zscore > 1 THEN 'HIGH' WHEN leverage_zscore > 0 THEN 'ELEVATED'
       WHEN leverage_zscore > -1 THEN 'NORMAL' ELSE 'LOW' END AS risk_level, CASE WHEN leverage_zscore > 2 THEN 90 WHEN leverage_zscore > 1 THEN 70 WHEN
       leverage_zscore > 0 THEN 45 WHEN leverage_zscore > -1 THEN 20 ELSE 10 END AS cascade_probability FROM z""")
def _(t):
    return L.leverage_index(t.oi, t.ticker, E)


@query("l8_funding_stress", uses="funding", doubles="avg_funding_rate funding_zscore funding_momentum carry_crowding", digits=8, sql=f"""WITH v AS (SELECT symbol, exchange, {TB} AS
       bucket, arg_max(funding_rate, ts) * 100 AS r FROM funding GROUP BY 1, 2, 3), d AS (SELECT symbol, bucket, avg(r) AS a FROM v GROUP BY 1, 2), z AS (SELECT *, (a
       - 0.01) / 0.03 AS z, a - lag(a) OVER (PARTITION BY symbol ORDER BY bucket) AS m FROM d) SELECT symbol, bucket, a AS avg_funding_rate, z AS funding_zscore, m
       AS funding_momentum, abs(a * 1095) AS carry_crowding, CASE WHEN abs(z) > 3 THEN 'EXTREME' WHEN abs(z) > 2 THEN 'HIGH' WHEN abs(z) > 1 THEN 'ELEVATED' ELSE
       'NORMAL' END AS stress_level, CASE WHEN z > 2 THEN 'EXTREME_BULLISH_CROWDING' WHEN z > 1 THEN 'BULLISH_CROWDING' WHEN z < -2 THEN
       'EXTREME_BEARISH_CROWDING' WHEN z < -1 THEN 'BEARISH_CROWDING' ELSE 'NEUTRAL' END AS sentiment FROM z""")
def _(t):
    return L.funding_stress(t.funding, E)


@query("l9_basis_regime", uses="marks", doubles="avg_basis_pct basis_volatility regime_strength", sql=f"""WITH v AS (SELECT symbol, exchange, {TB} AS bucket, arg_max((mark_price -
       index_price) / index_price * 100, ts) AS b FROM marks GROUP BY 1, 2, 3), d AS (SELECT symbol, bucket, avg(b) AS a, stddev_pop(b) AS sd, count(*) > 1 AND
       max(b) - min(b) > 0.1 AS arb FROM v GROUP BY 1, 2), s AS (SELECT *, sign(a - lag(a) OVER (PARTITION BY symbol ORDER BY bucket)) AS st FROM d), t AS (SELECT *,
       count(*) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n, sum(st) OVER (PARTITION BY symbol ORDER BY bucket ROWS
       BETWEEN 4 PRECEDING AND 1 PRECEDING) AS tt FROM s) SELECT symbol, bucket, a AS avg_basis_pct, sd AS basis_volatility, arb AS arbitrage_opportunity, CASE WHEN
       n >= 5 AND tt = 4 THEN 'EXPANDING' WHEN n >= 5 AND tt = -4 THEN 'CONTRACTING' ELSE 'STABLE' END AS basis_trend, CASE WHEN a > 0.1 THEN
       'OVERHEATED_CONTANGO' WHEN a > 0.02 THEN 'HEALTHY_CONTANGO' WHEN a < -0.1 THEN 'BACKWARDATION_STRESS' WHEN a < -0.02 THEN 'MILD_BACKWARDATION' ELSE
       'NEUTRAL_BASIS' END AS regime, CASE WHEN abs(a) > 0.1 THEN least(abs(a) * 100, 100) WHEN abs(a) > 0.02 THEN abs(a) * 200 ELSE 50 END AS regime_strength FROM
       t""")
def _(t):
    return L.basis_regime(t.marks, E)


@query("l10_price_leadership", uses="ev", doubles="variance first_mover_ratio score", sql=f"""WITH {RETURNS}, q AS (SELECT * FROM r WHERE ret IS NOT NULL), a AS (SELECT *, CASE
       WHEN abs(ret) > 0.0001 AND count(*) FILTER (abs(ret) > 0.0001) OVER (PARTITION BY symbol, idx) = 1 THEN 1 ELSE 0 END AS f FROM q), p AS (SELECT symbol,
       exchange, var_pop(ret) AS variance, avg(f) AS first_mover_ratio FROM a GROUP BY 1, 2), s AS (SELECT *, variance * 1000 + first_mover_ratio * 100 AS score FROM
       p), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY score DESC, exchange) AS INTEGER) AS rank FROM s), c AS (SELECT x.symbol, x.exchange AS
       leader, y.exchange AS exchange, l.lag, corr(x.ret, y.ret) AS c FROM q x CROSS JOIN (SELECT unnest(range(5)) AS lag) l JOIN q y ON x.symbol = y.symbol AND y.idx
       = x.idx - l.lag AND x.exchange <> y.exchange GROUP BY 1, 2, 3, 4), b AS (SELECT symbol, leader, exchange, CAST(arg_max(lag, (abs(c), -lag)) AS INTEGER) AS
       best_lag FROM c GROUP BY 1, 2, 3) SELECT k.*, b.leader, b.best_lag FROM k LEFT JOIN (SELECT b.* FROM b JOIN k l ON b.symbol = l.symbol AND b.leader =
       l.exchange AND l.rank = 1) b ON k.symbol = b.symbol AND k.exchange = b.exchange""")
def _(t):
    return L.price_leadership(returns_grid(t))


DEPTH_SQL = """dp AS (SELECT symbol, exchange, (count(*) % 7) / 2e0 AS spread_pct, (count(*) % 9) * 1e0 AS bid_depth, (count(*) % 11) * 1e0 AS ask_depth FROM prices GROUP BY 1, 2)"""


@query("l11_spread_arbitrage", uses="prices", doubles="spread_pct fill_probability net_expected_profit_pct", sql=f"""WITH {LATEST}, {DEPTH_SQL}, o AS (SELECT a.symbol, a.exchange AS
       exchange_a, a.price AS price_a, b.exchange AS exchange_b, b.price AS price_b, (b.price - a.price) / a.price * 100 AS spread_pct FROM latest a JOIN latest b ON
       a.symbol = b.symbol AND a.exchange <> b.exchange), f AS (SELECT o.*, greatest(0.5, 1 - (x.spread_pct + y.spread_pct) / 2 / 10) AS fill_probability, CASE WHEN
       least(x.ask_depth, y.bid_depth) < 1 THEN 'HIGH' WHEN least(x.ask_depth, y.bid_depth) < 5 THEN 'MODERATE' ELSE 'LOW' END AS slippage_risk FROM o JOIN dp x ON
       o.symbol = x.symbol AND o.exchange_a = x.exchange JOIN dp y ON o.symbol = y.symbol AND o.exchange_b = y.exchange WHERE o.spread_pct > 0.01) SELECT *, spread_pct
       * fill_probability AS net_expected_profit_pct, CAST(row_number() OVER (PARTITION BY symbol ORDER BY spread_pct * fill_probability DESC, exchange_a, exchange_b)
       AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    n = F.count(F.lit(1))
    depth = t.prices.groupBy("symbol", "exchange").agg((n % 7 / F.lit(2.0)).alias("spread_pct"), (n % 9 * F.lit(1.0)).alias("bid_depth"),
                                                       (n % 11 * F.lit(1.0)).alias("ask_depth"))
    return L.spread_arbitrage(latest_price(t), depth)


SYNC_SQL = f"""p AS (SELECT symbol, {TB} AS bucket, exchange, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS b, sum(quantity) AS v FROM trades GROUP BY 1, 2, 3), q AS
       (SELECT *, (2 * b - v) / v * 100 AS d FROM p), g AS (SELECT symbol, bucket, count(*) AS venues, greatest(count(*) FILTER (d > 5), count(*) FILTER (d < -5)) /
       count(*) AS fc, greatest(0, (1 - stddev_pop(v) / avg(v)) * 100) AS vs, avg(d) AS a FROM q GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("l12_flow_sync", uses="trades", doubles="avg_delta_pct flow_correlation volume_sync_score synchronization_score", sql=f"""WITH {SYNC_SQL} SELECT symbol, bucket, venues, a AS
       avg_delta_pct, fc AS flow_correlation, vs AS volume_sync_score, fc * 60 + vs * 0.4 AS synchronization_score, fc > 0.8 AND fc * 60 + vs * 0.4 > 70 AS
       coordinated_flow, CASE WHEN a > 15 THEN 'STRONG_BUYING' WHEN a > 5 THEN 'BUYING' WHEN a < -15 THEN 'STRONG_SELLING' WHEN a < -5 THEN 'SELLING' ELSE 'NEUTRAL'
       END AS dominant_direction FROM g""")
def _(t):
    return L.flow_sync(t.trades, E)


@query("l13_price_divergence", uses="prices", doubles="mean zscore", sql=f"""WITH v AS (SELECT symbol, {TB} AS bucket, exchange, arg_max(mid_price, ts) AS price FROM prices GROUP BY 1,
       2, 3), d AS (SELECT *, avg(price) OVER w AS mean, (price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) AS zscore FROM v WINDOW w AS (PARTITION BY
       symbol, bucket)) SELECT *, CASE WHEN zscore > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM d WHERE abs(zscore) > 1.5""")
def _(t):
    return L.price_divergence(t.prices, E, z=1.5)


# Layer rows as expressions over the events: one row per event, the same text in both engines.
ROW = {"vacuum_score": "(k % 100) * 1e0", "delta_pct": "(value - 50) / 2", "imbalance_ratio": "(k - 50) / 80e0",
       "market_quality": "CASE event_id % 5 WHEN 0 THEN 'EXCELLENT' WHEN 1 THEN 'GOOD' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'POOR' ELSE 'FRAGILE' END",
       "risk_level": "CASE event_id % 4 WHEN 0 THEN 'EXTREME' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'ELEVATED' ELSE 'NORMAL' END",
       "cascade_risk": "CASE k % 9 WHEN 0 THEN 'EXTREME' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE' ELSE 'LOW' END",
       "dominance": "CASE k % 3 WHEN 0 THEN 'BALANCED' WHEN 1 THEN 'LONG_LIQUIDATION_DOMINANT' ELSE 'NEUTRAL' END",
       "stress_level": "CASE k % 4 WHEN 0 THEN 'EXTREME' WHEN 1 THEN 'ELEVATED' ELSE 'NORMAL' END",
       "position_intent": "CASE WHEN event_id % 3 = 0 THEN 'LONGS_OPENING' WHEN event_id % 3 = 1 THEN 'SHORTS_OPENING' ELSE 'CONSOLIDATION' END",
       "thin_zones": "event_id % 8", "delta_acceleration": "(k - 50) / 10e0", "large_trades": "event_id % 4", "liquidation_momentum": "(value - 50) * 3000",
       "leverage_zscore": "(k - 40) / 20e0", "funding_zscore": "(value - 60) / 20", "position_intent_score": "(k - 50) * 1e0", "avg_basis_pct": "(value - 50) / 60",
       "synchronization_score": "(event_id % 100) * 1e0", "dominant_direction":
       "CASE event_id % 5 WHEN 0 THEN 'STRONG_BUYING' WHEN 1 THEN 'BUYING' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN 'SELLING' ELSE 'STRONG_SELLING' END",
       "cascade_probability": "(event_id % 10) * 10", "long_liquidation_value": "value * (event_id % 4)", "short_liquidation_value": "value * (k % 3)",
       "micro_volatility": "value", "total_volume": "value * 2", "price_impact": "k / 10000e0"}
ROWS_SQL = "w AS (SELECT event_id, symbol, ts AS bucket, " + ", ".join(f"{e} AS {n}" for n, e in ROW.items()) + " FROM ev)"


def layer_input(t):
    return t.ev.select("event_id", "symbol", C("ts").alias("bucket"), *[F.expr(e).alias(n) for n, e in ROW.items()])


REGIME_SQL = f"""{ROWS_SQL}, s AS (SELECT *, CASE WHEN vacuum_score > 70 OR market_quality IN ('FRAGILE', 'POOR') THEN 80 WHEN vacuum_score > 40 THEN 50 ELSE 20 END AS sv, CASE WHEN
       vacuum_score < 30 AND market_quality IN ('EXCELLENT', 'GOOD') THEN 80 WHEN vacuum_score < 50 THEN 50 ELSE 20 END AS sl, CASE WHEN risk_level IN ('EXTREME',
       'HIGH') OR cascade_risk IN ('EXTREME', 'HIGH') THEN 90 WHEN risk_level = 'ELEVATED' THEN 60 ELSE 30 END AS sg FROM w), a AS (SELECT *, CASE WHEN delta_pct > 10
       AND imbalance_ratio > 0.1 AND position_intent = 'LONGS_OPENING' AND sv < 50 THEN 80 WHEN delta_pct > 5 AND imbalance_ratio > 0.05 THEN 50 ELSE 0 END AS sa, CASE
       WHEN delta_pct < -10 AND imbalance_ratio < -0.1 AND position_intent = 'SHORTS_OPENING' AND sv < 50 THEN 80 WHEN delta_pct < -5 AND imbalance_ratio < -0.05 THEN
       50 ELSE 0 END AS sd FROM s), r AS (SELECT *, CASE WHEN cascade_risk IN ('EXTREME', 'HIGH') AND dominance <> 'NEUTRAL' AND sv > 60 THEN 'SQUEEZE' WHEN sv > 70 AND
       sg > 70 AND market_quality = 'FRAGILE' THEN 'CHAOS' WHEN sv > 60 AND abs(delta_pct) > 20 AND vacuum_score > 50 THEN 'BREAKOUT' WHEN sa > 60 THEN 'ACCUMULATION'
       WHEN sd > 60 THEN 'DISTRIBUTION' WHEN sv < 40 AND sl > 60 AND abs(delta_pct) < 10 THEN 'MEAN_REVERSION' ELSE 'CONSOLIDATION' END AS g FROM a)"""


@query("l14_market_regime", uses="ev", doubles="regime_confidence regime_strength", sql=f"""WITH {REGIME_SQL}, n AS (SELECT *, CASE WHEN lag(g) OVER o <> g THEN 1 ELSE 0 END AS nw FROM r
       WINDOW o AS (PARTITION BY symbol ORDER BY bucket)), i AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS isl FROM n)
       SELECT event_id, g AS current_regime, CASE g WHEN 'SQUEEZE' THEN least(90, sg) WHEN 'CHAOS' THEN least(85, (sv + sg) / 2) WHEN 'BREAKOUT' THEN least(80, sv) WHEN
       'ACCUMULATION' THEN sa WHEN 'DISTRIBUTION' THEN sd WHEN 'MEAN_REVERSION' THEN sl ELSE 60 END AS regime_confidence, CASE g WHEN 'SQUEEZE' THEN sg WHEN 'CHAOS' THEN
       sv WHEN 'BREAKOUT' THEN abs(delta_pct) WHEN 'ACCUMULATION' THEN sa WHEN 'DISTRIBUTION' THEN sd WHEN 'MEAN_REVERSION' THEN 100 - sv ELSE 50 END AS
       regime_strength, row_number() OVER (PARTITION BY symbol, isl ORDER BY bucket) AS regime_duration FROM i""")
def _(t):
    return L.market_regime(layer_input(t)).select("event_id", "current_regime", "regime_confidence", "regime_strength", "regime_duration")


@query("l15_event_risk", uses="ev", doubles="event_risk_score", sql=f"""WITH {ROWS_SQL}, s AS (SELECT event_id, list_sort([vacuum_score, least(thin_zones * 15, 100),
       least(abs(delta_acceleration) * 10 + large_trades * 10, 100), CASE cascade_risk WHEN 'EXTREME' THEN 95 WHEN 'HIGH' THEN 70 WHEN 'MODERATE' THEN 40 ELSE 10 END +
       least(abs(liquidation_momentum) / 10000, 20), least(abs(leverage_zscore) * 30, 100), least(abs(funding_zscore) * 25, 100)], 'DESC') AS x FROM w), r AS (SELECT
       event_id, (x[1] * 2 + x[2] * 1.5 + x[3] * 1.2 + x[4] + x[5] + x[6]) / 7.7 AS event_risk_score FROM s) SELECT *, CASE WHEN event_risk_score > 80 THEN 'EXTREME'
       WHEN event_risk_score > 60 THEN 'HIGH' WHEN event_risk_score > 40 THEN 'ELEVATED' WHEN event_risk_score > 20 THEN 'MODERATE' ELSE 'LOW' END AS event_risk_level
       FROM r""")
def _(t):
    return L.event_risk(layer_input(t)).select("event_id", "event_risk_score", "event_risk_level")


@query("l16_volatility_state", uses="ev", doubles="volatility_percentile", sql=f"""WITH {ROWS_SQL}, x AS (SELECT *, list(micro_volatility) OVER (o ROWS 99 PRECEDING) AS xs,
       stddev_pop(micro_volatility) OVER (o ROWS 9 PRECEDING) / avg(micro_volatility) OVER (o ROWS 9 PRECEDING) AS cv FROM w WINDOW o AS (PARTITION BY symbol ORDER BY
       bucket)), p AS (SELECT *, len(xs) >= 10 AS e, CASE WHEN len(xs) >= 10 THEN len([v for v in xs if v < micro_volatility]) / len(xs) * 100 ELSE 50 END AS p FROM x)
       SELECT event_id, p AS volatility_percentile, CASE WHEN NOT e THEN 'NORMAL' WHEN p > 90 THEN 'EXTREME' WHEN p > 75 THEN 'HIGH' WHEN p > 50 THEN 'ELEVATED' WHEN p >
       25 THEN 'NORMAL' ELSE 'LOW' END AS volatility_regime, e AND cv < 0.3 AS clustering_detected FROM p""")
def _(t):
    return L.volatility_state(layer_input(t)).select("event_id", "volatility_percentile", "volatility_regime", "clustering_detected")


@query("l17_institutional_pressure", uses="ev", doubles="pressure_score pressure_confidence", sql=f"""WITH {ROWS_SQL}, c AS (SELECT *, [imbalance_ratio * 100, greatest(-100, least(100,
       delta_pct)), position_intent_score, -funding_zscore * 20, avg_basis_pct * 50, CASE dominant_direction WHEN 'STRONG_BUYING' THEN synchronization_score WHEN
       'BUYING' THEN synchronization_score * 0.6 WHEN 'STRONG_SELLING' THEN -synchronization_score WHEN 'SELLING' THEN -synchronization_score * 0.6 ELSE 0 END] AS x FROM
       w), s AS (SELECT *, x[1] * 0.2 + x[2] * 0.25 + x[3] * 0.2 + x[4] * 0.15 + x[5] * 0.1 + x[6] * 0.1 AS s, greatest(len([v for v in x if v > 10]), len([v for v in x
       if v < -10])) / 6 * 100 AS f FROM c), t AS (SELECT *, lag(s, 4) OVER o AS o4, lag(s) OVER o AS l1, lag(s, 2) OVER o AS l2, lag(s, 3) OVER o AS l3 FROM s WINDOW o
       AS (PARTITION BY symbol ORDER BY bucket)) SELECT event_id, s AS pressure_score, f AS pressure_confidence, CASE WHEN s > 50 THEN 'STRONG_BULLISH' WHEN s > 25 THEN
       'BULLISH' WHEN s > 10 THEN 'SLIGHTLY_BULLISH' WHEN s < -50 THEN 'STRONG_BEARISH' WHEN s < -25 THEN 'BEARISH' WHEN s < -10 THEN 'SLIGHTLY_BEARISH' ELSE 'NEUTRAL'
       END AS pressure_direction, CASE WHEN o4 IS NULL THEN 'STABLE' WHEN s > l1 AND l1 > l2 AND l2 > l3 AND l3 > o4 THEN 'STRENGTHENING_BULLISH' WHEN s < l1 AND l1 <
       l2 AND l2 < l3 AND l3 < o4 THEN 'STRENGTHENING_BEARISH' WHEN (s - o4) / 5 > 2 THEN 'TURNING_BULLISH' WHEN (s - o4) / 5 < -2 THEN 'TURNING_BEARISH' ELSE 'STABLE'
       END AS pressure_trend, CASE WHEN s > 25 AND f > 60 THEN 'FAVORABLE_FOR_LONGS' WHEN s < -25 AND f > 60 THEN 'FAVORABLE_FOR_SHORTS' ELSE 'NEUTRAL_WAIT' END AS
       recommendation FROM t""")
def _(t):
    return L.institutional_pressure(layer_input(t)).select("event_id", "pressure_score", "pressure_confidence", "pressure_direction",
                                                           "pressure_trend", "recommendation")


@query("l18_alpha_squeeze", uses="ev", doubles="squeeze_probability squeeze_intensity", sql=f"""WITH {REGIME_SQL}, b AS (SELECT *, cascade_probability * 0.4 + CASE WHEN
       abs(funding_zscore) > 2 THEN 80 WHEN abs(funding_zscore) > 1 THEN 50 ELSE 20 END * 0.3 + vacuum_score * 0.3 AS base FROM r), p AS (SELECT *, CASE WHEN g = 'SQUEEZE'
       THEN least(base * 1.3, 100) ELSE base END AS p FROM b) SELECT event_id, p AS squeeze_probability, (cascade_probability + vacuum_score) / 2 AS squeeze_intensity,
       CASE WHEN funding_zscore > 1 OR (long_liquidation_value + short_liquidation_value > 0 AND long_liquidation_value > short_liquidation_value * 2) THEN 'LONG_SQUEEZE'
       WHEN funding_zscore < -1 OR (long_liquidation_value + short_liquidation_value > 0 AND short_liquidation_value > long_liquidation_value * 2) THEN 'SHORT_SQUEEZE'
       ELSE 'NONE' END AS squeeze_type, CASE WHEN p > 80 THEN 'IMMINENT' WHEN p > 60 THEN 'LIKELY_SOON' WHEN p > 40 THEN 'POSSIBLE' ELSE 'UNLIKELY' END AS
       time_to_squeeze FROM p""")
def _(t):
    return L.alpha_squeeze(L.market_regime(layer_input(t))).select("event_id", "squeeze_probability", "squeeze_intensity", "squeeze_type", "time_to_squeeze")


@query("l19_absorption", uses="ev", doubles="absorption_strength", sql=f"""WITH {ROWS_SQL}, s AS (SELECT *, least(100, CASE WHEN price_impact > 0 THEN least(total_volume / 100, 2) /
       price_impact ELSE least(total_volume / 100, 2) * 100 END) AS s FROM w) SELECT event_id, s AS absorption_strength, CASE WHEN delta_pct > 15 AND s > 50 THEN
       'BUY_ABSORPTION' WHEN delta_pct < -15 AND s > 50 THEN 'SELL_ABSORPTION' WHEN abs(delta_pct) < 5 AND s > 60 THEN 'BALANCED_ABSORPTION' ELSE 'NONE' END AS
       absorption_type FROM s""")
def _(t):
    return L.absorption(layer_input(t)).select("event_id", "absorption_strength", "absorption_type")


@query("l19_defended_levels", uses="books", sql=f"""WITH z AS ({SQL["l3_orderbook_persistence"]}) SELECT symbol, 'NONE' AS absorption_type, g.defended_levels FROM (SELECT DISTINCT
       symbol FROM books) LEFT JOIN (SELECT symbol, list(price ORDER BY reliability DESC, zone DESC, price DESC)[1:5] AS defended_levels FROM z WHERE rank <= 3 AND reliability > 60 GROUP BY 1) g USING (symbol)""")
def _(t):
    zones = L.orderbook_persistence(venues(t.books), tie="vec_id")
    keys = t.books.select("symbol").distinct().withColumns({"total_volume": F.lit(100.0), "price_impact": F.lit(0.1), "delta_pct": F.lit(1.0)})
    return L.absorption(keys, zones).select("symbol", "absorption_type", C("defended_levels.price").alias("defended_levels"))


VOTES = {"pressure_direction": "CASE event_id % 4 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' WHEN 2 THEN 'SLIGHTLY_BULLISH' ELSE 'NEUTRAL' END",
         "pressure_confidence": "k * 1e0", "squeeze_probability": "(event_id % 100) * 1e0",
         "squeeze_type": "CASE k % 3 WHEN 0 THEN 'SHORT_SQUEEZE' WHEN 1 THEN 'LONG_SQUEEZE' ELSE 'NONE' END",
         "absorption_type": "CASE event_id % 3 WHEN 0 THEN 'BUY_ABSORPTION' WHEN 1 THEN 'SELL_ABSORPTION' ELSE 'NONE' END", "absorption_strength": "value / 3",
         "current_regime": "CASE k % 4 WHEN 0 THEN 'CHAOS' WHEN 1 THEN 'BREAKOUT' WHEN 2 THEN 'CONSOLIDATION' ELSE 'ACCUMULATION' END",
         "event_risk_level": "CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'ELEVATED' ELSE 'LOW' END"}


@query("l20_alpha_signal", uses="ev", doubles="alpha_confidence", sql="WITH v AS (SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in VOTES.items()) + """ FROM ev), q AS (SELECT *,
       CASE WHEN squeeze_probability > 70 THEN squeeze_probability WHEN squeeze_probability > 50 THEN squeeze_probability * 0.8 ELSE 0 END AS sq, CASE current_regime WHEN
       'CHAOS' THEN 1.2e0 WHEN 'BREAKOUT' THEN 1.1e0 WHEN 'CONSOLIDATION' THEN 0.8e0 ELSE 1e0 END AS m FROM v), w AS (SELECT *, m * (CASE WHEN pressure_direction LIKE
       '%BULLISH' THEN pressure_confidence ELSE 0 END + CASE WHEN squeeze_type = 'SHORT_SQUEEZE' THEN sq ELSE 0 END + CASE WHEN absorption_type = 'BUY_ABSORPTION' THEN
       absorption_strength * 0.8 ELSE 0 END) AS b, m * (CASE WHEN pressure_direction LIKE '%BEARISH' THEN pressure_confidence ELSE 0 END + CASE WHEN squeeze_type =
       'LONG_SQUEEZE' THEN sq ELSE 0 END + CASE WHEN absorption_type = 'SELL_ABSORPTION' THEN absorption_strength * 0.8 ELSE 0 END) AS s FROM q) SELECT event_id, CASE WHEN b
       > s THEN CASE WHEN b - s > 100 OR (squeeze_probability > 70 AND squeeze_type = 'SHORT_SQUEEZE') THEN 'STRONG_BUY' WHEN b - s > 50 THEN 'BUY' ELSE 'WEAK_BUY' END WHEN s
       > b THEN CASE WHEN s - b > 100 OR (squeeze_probability > 70 AND squeeze_type = 'LONG_SQUEEZE') THEN 'STRONG_SELL' WHEN s - b > 50 THEN 'SELL' ELSE 'WEAK_SELL' END
       ELSE 'NEUTRAL' END AS alpha_signal, CASE WHEN b > s THEN least(b, 100) WHEN s > b THEN least(s, 100) WHEN b + s > 0 THEN 50 ELSE 0 END AS alpha_confidence, CASE WHEN
       current_regime = 'CHAOS' THEN 'HIGH' WHEN current_regime = 'BREAKOUT' THEN 'MEDIUM' ELSE 'LOW' END AS urgency, CASE event_risk_level WHEN 'HIGH' THEN 'UNFAVORABLE'
       WHEN 'ELEVATED' THEN 'MODERATE' ELSE 'FAVORABLE' END AS risk_reward FROM w""")
def _(t):
    df = t.ev.select("event_id", *[F.expr(e).alias(n) for n, e in VOTES.items()])
    return L.alpha_signal(df).select("event_id", "alpha_signal", "alpha_confidence", "urgency", "risk_reward")


@query("l21_market_intelligence")
def _(t):
    """All layers joined; each layer has its own SQL check above."""
    return L.market_intelligence(t.trades, t.timed_books, t.oi, t.ticker, t.funding, t.marks, t.liquidations, "1 day").select(
        "symbol", "bucket", "current_regime", "event_risk_level", "volatility_regime", "pressure_direction", "squeeze_type", "absorption_type", "alpha_signal")


@query("l22_period_report", uses="prices trades funding liquidations", digits=7, doubles="deviation average avg_funding liquidation_value long_liquidations change_pct flow_imbalance_pct volatility_pct",
       sql="""WITH p AS (SELECT symbol, arg_min(mid_price, ts) AS open, arg_max(mid_price, ts) AS close, max(mid_price) AS high, min(mid_price) AS low, stddev(mid_price) AS
       deviation, avg(mid_price) AS average FROM prices WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17' GROUP BY 1), t AS (SELECT symbol, sum(CASE WHEN
       side = 'buy' THEN quantity ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS sell_volume, count(*) AS trades FROM trades WHERE ts
       BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17' GROUP BY 1), f AS (SELECT symbol, avg(funding_rate) AS avg_funding FROM funding WHERE ts BETWEEN TIMESTAMP
       '2024-01-10' AND TIMESTAMP '2024-01-17' GROUP BY 1), q AS (SELECT symbol, count(*) AS liquidations, sum(value_usd) AS liquidation_value, sum(CASE WHEN side = 'long'
       THEN value_usd ELSE 0 END) AS long_liquidations FROM liquidations WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17' GROUP BY 1), d AS (SELECT *,
       (close - open) / open * 100 AS change_pct, buy_volume - sell_volume AS cvd, (buy_volume - sell_volume) / (buy_volume + sell_volume) * 100 AS flow_imbalance_pct,
       deviation / average * 100 AS volatility_pct FROM p JOIN t USING (symbol) JOIN f USING (symbol) JOIN q USING (symbol)) SELECT *, CASE WHEN volatility_pct > 50 THEN
       'HIGH_VOL' WHEN change_pct > 1 THEN 'TRENDING_UP' WHEN change_pct < -1 THEN 'TRENDING_DOWN' ELSE 'RANGING' END AS regime, CASE WHEN flow_imbalance_pct > 10 THEN
       'BULLISH' WHEN flow_imbalance_pct < -10 THEN 'BEARISH' ELSE 'NEUTRAL' END AS flow_signal FROM d""")
def _(t):
    return L.period_report(t.prices, t.trades, t.funding, t.liquidations, datetime(2024, 1, 10), datetime(2024, 1, 17))


@query("l23_funding_patterns", uses="funding", digits=9, doubles="avg_rate rate_volatility", sql="""SELECT *, CASE WHEN avg_rate > 0.0001 THEN 'persistently_positive' WHEN avg_rate <
       -0.0001 THEN 'persistently_negative' ELSE 'mixed' END AS sign_pattern, CASE WHEN rate_volatility > 0.0002 THEN 'volatile' ELSE 'stable' END AS stability FROM (SELECT
       exchange, avg(funding_rate) AS avg_rate, stddev(funding_rate) AS rate_volatility FROM funding GROUP BY 1)""")
def _(t):
    return L.funding_patterns(t.funding)


@query("l24_cascade_probability", uses="liquidations", doubles="probability", sql=f"""WITH {CASCADE_SQL}, k AS (SELECT symbol, count(*) AS cascades, max(end_time) AS e FROM c GROUP BY 1), n
       AS (SELECT symbol, count(*) AS n, count(*) FILTER (side = 'long') AS l FROM liquidations GROUP BY 1), p AS (SELECT symbol, coalesce(cascades, 0) AS cascades, least(1,
       CASE WHEN date_diff('second', e, (SELECT max(ts) FROM liquidations)) < 1800 THEN 0.4 WHEN cascades > 0 THEN 0.1 * least(cascades / 5, 1) ELSE 0 END + 0.3 * least(n /
       720 / 20, 1) + 0.3 * abs(2 * l - n) / n) AS probability FROM n LEFT JOIN k USING (symbol)) SELECT *, CASE WHEN probability >= 0.8 THEN 'EXTREME' WHEN probability >=
       0.6 THEN 'HIGH' WHEN probability >= 0.4 THEN 'ELEVATED' WHEN probability >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM p""")
def _(t):
    return L.cascade_probability(t.liquidations, minutes=30, hours=720)


@query("l25_volatility_regime", uses="prices", doubles="short_vol long_vol vol_ratio", digits=5, sql="""WITH r AS (SELECT *, mid_price / lag(mid_price) OVER o - 1 AS ret, row_number() OVER o AS rn FROM
       prices WINDOW o AS (PARTITION BY symbol ORDER BY ts)), v AS (SELECT event_id, symbol, CASE WHEN rn > 20 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS
       19 PRECEDING) / 1000 * sqrt(525600) END AS short_vol, CASE WHEN rn > 100 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING) / 1000 *
       sqrt(525600) END AS long_vol FROM r), q AS (SELECT symbol, quantile_cont(short_vol, 0.25) AS p25, quantile_cont(short_vol, 0.75) AS p75, quantile_cont(short_vol, 0.95)
       AS p95 FROM v WHERE short_vol IS NOT NULL GROUP BY 1) SELECT event_id, short_vol, long_vol, short_vol / long_vol AS vol_ratio, CASE WHEN short_vol >= p95 THEN
       'EXTREME' WHEN short_vol >= p75 THEN 'HIGH' WHEN short_vol >= p25 THEN 'NORMAL' ELSE 'LOW' END AS regime FROM v JOIN q USING (symbol) WHERE short_vol IS NOT NULL""")
def _(t):
    d = L.volatility_regime(t.prices, ("symbol",), ("ts",), short=20, long=100)
    return d.select("event_id", (C("short_vol") / 1000).alias("short_vol"), (C("long_vol") / 1000).alias("long_vol"), "vol_ratio", "regime")


@query("l26_candle_summary", uses="bars", doubles="sma_20 sma_50 avg_volume price_vs_sma20_pct range_position_pct volume_ratio", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY
       symbol ORDER BY open_time DESC) AS r FROM bars), s AS (SELECT symbol, max(CASE WHEN r = 1 THEN close END) AS current_price, avg(close) FILTER (r <= 20) AS sma_20,
       avg(close) FILTER (r <= 50) AS sma_50, sum(volume) FILTER (r <= 5) / 5 / avg(volume) AS volume_ratio, max(high) AS period_high, min(low) AS period_low, avg(volume) AS
       avg_volume, count(*) AS candle_count FROM r GROUP BY 1) SELECT *, (current_price - sma_20) / sma_20 * 100 AS price_vs_sma20_pct, (current_price - period_low) /
       (period_high - period_low) * 100 AS range_position_pct, CASE WHEN current_price > sma_20 AND sma_20 > sma_50 THEN 'BULLISH' WHEN current_price < sma_20 AND sma_20 <
       sma_50 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend FROM s""")
def _(t):
    return L.candle_summary(t.bars)


@query("l27_oi_trend", uses="oi", doubles="change_pct", sql="""SELECT *, (end_oi - start_oi) / start_oi * 100 AS change_pct, CASE WHEN (end_oi - start_oi) / start_oi * 100 > 5 THEN
       'INCREASING' WHEN (end_oi - start_oi) / start_oi * 100 < -5 THEN 'DECREASING' ELSE 'STABLE' END AS trend FROM (SELECT symbol, arg_min(open_interest, ts) AS start_oi,
       arg_max(open_interest, ts) AS end_oi, max(open_interest) AS period_high, min(open_interest) AS period_low, count(*) AS data_points FROM oi GROUP BY 1)""")
def _(t):
    return L.oi_trend(t.oi)


@query("l28_funding_history", uses="funding", digits=9, doubles="current_rate avg_rate annualized_pct max_rate min_rate", sql="""SELECT symbol, arg_max(funding_rate, ts) AS current_rate,
       avg(funding_rate) AS avg_rate, avg(funding_rate) * 109500 AS annualized_pct, max(funding_rate) AS max_rate, min(funding_rate) AS min_rate, count(*) FILTER
       (funding_rate > 0) AS positive_count, count(*) FILTER (funding_rate < 0) AS negative_count, count(*) AS data_points FROM funding GROUP BY 1""")
def _(t):
    return L.funding_history(t.funding)


@query("l29_taker_trend", uses="ev", doubles="current_ratio avg_ratio total_buy_volume net_flow", sql="""WITH d AS (SELECT exchange AS symbol, ts, (k + 1) / 50e0 AS ratio, value AS b, value / 2 AS
       s FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS f, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS l FROM d), g AS
       (SELECT symbol, max(CASE WHEN l = 1 THEN ratio END) AS current_ratio, avg(ratio) AS avg_ratio, sum(b) AS total_buy_volume, sum(b) - sum(s) AS net_flow, avg(ratio)
       FILTER (l <= 10) AS n, avg(ratio) FILTER (f <= 10) AS o, count(*) AS data_points FROM r GROUP BY 1) SELECT symbol, current_ratio, avg_ratio, total_buy_volume,
       net_flow, CASE WHEN n > o * 1.1 THEN 'INCREASING_BUYS' WHEN n < o * 0.9 THEN 'INCREASING_SELLS' ELSE 'STABLE' END AS flow_trend, CASE WHEN current_ratio > 1.05 THEN
       'BUYERS' WHEN current_ratio < 0.95 THEN 'SELLERS' ELSE 'BALANCED' END AS aggressor, data_points FROM g""")
def _(t):
    df = t.ev.select(C("exchange").alias("symbol"), "ts", ((C("k") + 1) / F.lit(50.0)).alias("ratio"), C("value").alias("buy_vol"), (C("value") / 2).alias("sell_vol"))
    return L.taker_trend(df).drop("total_sell_volume")


def ratios(t):
    return t.ev.select("symbol", "ts", ((C("k") + 1) / F.lit(40.0)).alias("top_ratio"), (C("value") / 50).alias("global_ratio"),
                       ((C("event_id") % 30) / F.lit(15.0)).alias("taker_ratio"))


@query("l30_long_short_sentiment", uses="ev", doubles="top_ratio global_ratio taker_ratio", sql="""WITH d AS (SELECT symbol, arg_max((k + 1) / 40e0, ts) AS top_ratio, arg_max(value / 50, ts) AS
       global_ratio, arg_max((event_id % 30) / 15e0, ts) AS taker_ratio FROM ev GROUP BY 1) SELECT *, CASE WHEN top_ratio > 1.2 THEN 'BULLISH' WHEN top_ratio < 0.8 THEN
       'BEARISH' ELSE 'NEUTRAL' END AS top_trader_sentiment, CASE WHEN global_ratio > 1.2 THEN 'BULLISH' WHEN global_ratio < 0.8 THEN 'BEARISH' ELSE 'NEUTRAL' END AS
       global_sentiment, CASE WHEN taker_ratio > 1.1 THEN 'BUY_PRESSURE' WHEN taker_ratio < 0.9 THEN 'SELL_PRESSURE' ELSE 'NEUTRAL' END AS taker_pressure FROM d""")
def _(t):
    return L.long_short_sentiment(ratios(t))


@query("l31_basis_history", uses="marks", doubles="current_basis current_basis_rate_pct avg_basis avg_basis_rate_pct max_basis min_basis annualized_rate_pct", sql="""SELECT *,
       current_basis_rate_pct * 1095 AS annualized_rate_pct, CASE WHEN current_basis > 0 THEN 'PREMIUM' WHEN current_basis < 0 THEN 'DISCOUNT' ELSE 'AT_PAR' END AS
       premium_discount FROM (SELECT symbol, arg_max(mark_price - index_price, ts) AS current_basis, arg_max((mark_price - index_price) / index_price, ts) * 100 AS
       current_basis_rate_pct, avg(mark_price - index_price) AS avg_basis, avg((mark_price - index_price) / index_price) * 100 AS avg_basis_rate_pct, max(mark_price -
       index_price) AS max_basis, min(mark_price - index_price) AS min_basis, count(*) AS data_points FROM marks GROUP BY 1)""")
def _(t):
    return L.basis_history(t.marks)


@query("l32_vol_index_summary", uses="prices", doubles="average", sql="""SELECT *, CASE WHEN current > 80 THEN 'HIGH_VOL' WHEN current < 40 THEN 'LOW_VOL' ELSE 'NORMAL' END AS flag FROM (SELECT
       exchange, arg_max(mid_price, ts) AS current, max(mid_price) AS period_high, min(mid_price) AS period_low, avg(mid_price) AS average, count(*) AS data_points FROM prices
       GROUP BY 1)""")
def _(t):
    return L.vol_index_summary(t.prices, ["exchange"], close="mid_price")


@query("l33_venue_signals", uses="funding oi ev prices", sql="""WITH f AS (SELECT symbol, arg_max(funding_rate, ts) * 10 AS f FROM funding GROUP BY 1), s AS (SELECT symbol, arg_max((k + 1) / 40e0, ts) AS r
       FROM ev GROUP BY 1), o AS (SELECT symbol, (arg_max(open_interest, ts) - arg_min(open_interest, ts)) / arg_min(open_interest, ts) * 100 AS o FROM oi GROUP BY 1), v AS
       (SELECT symbol, arg_max(mid_price, ts) AS d FROM prices GROUP BY 1), j AS (SELECT * FROM f JOIN s USING (symbol) JOIN o USING (symbol) JOIN v USING (symbol)), x AS (
       SELECT symbol, 'funding' AS type, 'SHORT_BIAS' AS signal, 'STRONG' AS strength FROM j WHERE f > 0.001 UNION ALL SELECT symbol, 'funding', 'LONG_BIAS', 'STRONG' FROM j
       WHERE f < -0.001 UNION ALL SELECT symbol, 'positioning', 'CROWDED_LONG', 'MODERATE' FROM j WHERE r > 2 UNION ALL SELECT symbol, 'positioning', 'CROWDED_SHORT',
       'MODERATE' FROM j WHERE r < 0.5 UNION ALL SELECT symbol, 'open_interest', 'OI_INCREASING', 'MODERATE' FROM j WHERE o > 10 UNION ALL SELECT symbol, 'open_interest',
       'OI_DECREASING', 'MODERATE' FROM j WHERE o < -10 UNION ALL SELECT symbol, 'volatility', 'HIGH_VOL', 'MODERATE' FROM j WHERE d > 80 UNION ALL SELECT symbol,
       'volatility', 'LOW_VOL', 'MODERATE' FROM j WHERE d < 40), m AS (SELECT symbol, CASE WHEN count(*) FILTER (signal LIKE '%LONG%' OR signal NOT LIKE '%SHORT_BIAS%') >
       count(*) / 2 THEN 'BULLISH' WHEN count(*) FILTER (signal LIKE '%SHORT%') > count(*) / 2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS overall_sentiment FROM x GROUP BY 1) SELECT
       x.*, overall_sentiment FROM x JOIN m USING (symbol)""")
def _(t):
    f = L.funding_history(t.funding).withColumn("current_rate", C("current_rate") * 10)
    return L.venue_signals(f, L.long_short_sentiment(ratios(t)), L.oi_trend(t.oi), vol=L.vol_index_summary(t.prices, ["symbol"], close="mid_price"))


@query("l34_market_snapshot", uses="prices trades liquidations", doubles="average buy_value sell_value buy_sell_ratio long_liquidated short_liquidated", sql="""WITH n AS (SELECT max(ts) - INTERVAL 48
       HOUR AS t0 FROM prices), l AS (SELECT symbol, exchange, arg_max(mid_price, ts) AS price, max(ts) AS last_update FROM prices GROUP BY 1, 2), p AS (SELECT symbol,
       exchange, min(mid_price) AS low, max(mid_price) AS high, avg(mid_price) AS average FROM prices, n WHERE ts >= t0 GROUP BY 1, 2), t AS (SELECT symbol, exchange, sum(CASE
       WHEN side = 'buy' THEN quote_value ELSE 0 END) AS buy_value, sum(CASE WHEN side = 'sell' THEN quote_value ELSE 0 END) AS sell_value FROM trades, n WHERE ts >= t0 GROUP
       BY 1, 2), q AS (SELECT symbol, exchange, sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS long_liquidated, sum(CASE WHEN side = 'short' THEN value_usd ELSE 0
       END) AS short_liquidated FROM liquidations, n WHERE ts >= t0 GROUP BY 1, 2), d AS (SELECT *, buy_value / nullif(sell_value, 0) AS buy_sell_ratio FROM l LEFT JOIN p
       USING (symbol, exchange) LEFT JOIN t USING (symbol, exchange) LEFT JOIN q USING (symbol, exchange)) SELECT *, CASE WHEN buy_sell_ratio > 1.5 THEN 'STRONG_BUYING' WHEN
       buy_sell_ratio < 0.67 THEN 'STRONG_SELLING' ELSE 'BALANCED' END AS flow_signal, CASE WHEN coalesce(long_liquidated, 0) > coalesce(short_liquidated, 0) * 2 THEN
       'BEARISH_CAPITULATION' WHEN coalesce(short_liquidated, 0) > coalesce(long_liquidated, 0) * 2 THEN 'BULLISH_SQUEEZE' ELSE 'UNKNOWN' END AS market_state FROM d""")
def _(t):
    return L.market_snapshot(t.prices, t.trades, t.liquidations, 48)
