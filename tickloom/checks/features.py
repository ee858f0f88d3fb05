"""Stored feature jobs (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.joins import RETURNS, returns_grid
from tickloom.checks.registry import query
from tickloom.operators import aggregates as A
from tickloom.operators import joins as J
from tickloom.operators import windows as W
from tickloom.plans import features as B
from tickloom.session import scratch_path
from tickloom.sources import store

C = F.col
VENUES = ["click", "view", "purchase", "error", "signup"]


@query("b1_price_features", uses="quotes timed_books", digits=7,
       doubles="spread spread_bps microprice weighted_mid_price bid_depth_5 ask_depth_10 total_depth_10 depth_imbalance_5 weighted_imbalance price_change_1m price_change_5m",
       sql="""WITH j AS (SELECT q.event_id, q.mid_price, q.bid_price, q.ask_price, b.bids, b.asks, p1.mid_price AS m1,
       p5.mid_price AS m5 FROM quotes q ASOF LEFT JOIN timed_books b ON q.symbol = b.symbol AND q.ts >= b.ts
       ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, mid_price FROM quotes) p1 ON q.symbol = p1.symbol AND
       q.ts >= p1.ts ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 5 HOUR AS ts, mid_price FROM quotes) p5 ON q.symbol =
       p5.symbol AND q.ts >= p5.ts), d AS (SELECT *, list_sum([x.qty for x in bids[1:5]]) AS b5, list_sum([x.qty for x in
       asks[1:5]]) AS a5, list_sum([x.qty for x in bids]) AS b10, list_sum([x.qty for x in asks]) AS a10,
       list_sum([bids[i].qty / i for i in range(1, 6)]) AS bq, list_sum([asks[i].qty / i for i in range(1, 6)]) AS aq,
       list_sum([bids[i].price * bids[i].qty / i for i in range(1, 6)]) AS bv, list_sum([asks[i].price * asks[i].qty / i for i
       in range(1, 6)]) AS av FROM j) SELECT event_id, ask_price - bid_price AS spread, (ask_price - bid_price) / mid_price *
       10000 AS spread_bps, CASE WHEN bids IS NULL THEN 0 ELSE (bids[1].price * asks[1].qty + asks[1].price * bids[1].qty) /
       (bids[1].qty + asks[1].qty) END AS microprice, CASE WHEN bids IS NULL THEN 0 ELSE (bv / bq + av / aq) / 2 END AS
       weighted_mid_price, coalesce(b5, 0) AS bid_depth_5, coalesce(a10, 0) AS ask_depth_10, coalesce(b10 + a10, 0) AS
       total_depth_10, coalesce((b5 - a5) / (b5 + a5), 0) AS depth_imbalance_5, coalesce((bq - aq) / (bq + aq), 0) AS
       weighted_imbalance, coalesce((mid_price - m1) / m1 * 100, 0) AS price_change_1m, coalesce((mid_price - m5) / m5 * 100, 0)
       AS price_change_5m FROM d""")
def _(t):
    return B.price_features(t.quotes, t.timed_books, steps=(3600.0, 18000.0)).select(
        "event_id", "spread", "spread_bps", "microprice", "weighted_mid_price", "bid_depth_5", "ask_depth_10",
        "total_depth_10", "depth_imbalance_5", "weighted_imbalance", "price_change_1m", "price_change_5m")


@query("b2_trade_features", uses="trades", doubles="vwap_1m vwap_5m avg_trade_size quote_volume_5m large_trade_volume", sql="""WITH n AS
       (SELECT max(ts) AS now FROM trades), s AS (SELECT * FROM trades, n WHERE ts >= now - INTERVAL 72 HOUR), b AS (SELECT symbol,
       exchange, CAST(count(*) FILTER (ts >= now - INTERVAL 6 HOUR) AS DOUBLE) AS trade_count_1m, CAST(count(*) FILTER (ts >= now
       - INTERVAL 24 HOUR) AS DOUBLE) AS trade_count_5m, coalesce(sum(quantity) FILTER (ts >= now - INTERVAL 6 HOUR), 0) AS
       volume_1m, coalesce(sum(quantity) FILTER (ts >= now - INTERVAL 24 HOUR), 0) AS volume_5m, coalesce(sum(quote_value) FILTER
       (ts >= now - INTERVAL 24 HOUR), 0) AS quote_volume_5m, coalesce(sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END)
       FILTER (ts >= now - INTERVAL 6 HOUR), 0) AS cvd_1m, coalesce(sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END)
       FILTER (ts >= now - INTERVAL 24 HOUR), 0) AS cvd_5m, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS
       cvd_15m, coalesce(sum(price * quantity) FILTER (ts >= now - INTERVAL 6 HOUR) / sum(quantity) FILTER (ts >= now - INTERVAL 6
       HOUR), 0) AS vwap_1m, coalesce(sum(price * quantity) FILTER (ts >= now - INTERVAL 24 HOUR) / sum(quantity) FILTER (ts >=
       now - INTERVAL 24 HOUR), 0) AS vwap_5m, coalesce(avg(quantity) FILTER (ts >= now - INTERVAL 24 HOUR), 0) AS avg_trade_size
       FROM s GROUP BY 1, 2) SELECT b.*, (SELECT count(*) FROM s WHERE s.symbol = b.symbol AND s.exchange = b.exchange AND
       avg_trade_size > 0 AND quantity > 2 * avg_trade_size) AS large_trade_count, (SELECT coalesce(sum(quantity), 0) FROM s WHERE
       s.symbol = b.symbol AND s.exchange = b.exchange AND avg_trade_size > 0 AND quantity > 2 * avg_trade_size) AS
       large_trade_volume FROM b""")
def _(t):
    return B.trade_features(t.trades, minutes=(360, 1440, 4320)).select(
        "symbol", "exchange", "trade_count_1m", "trade_count_5m", "volume_1m", "volume_5m", "quote_volume_5m", "cvd_1m",
        "cvd_5m", "cvd_15m", "vwap_1m", "vwap_5m", "avg_trade_size", "large_trade_count", "large_trade_volume")


@query("b2_trade_features_rolling", uses="trades", digits=7, doubles="trade_count_1m volume_5m cvd_1m cvd_15m vwap_1m vwap_5m avg_trade_size", sql="""
       SELECT trade_id, CAST(count(*) OVER a AS DOUBLE) AS trade_count_1m, sum(quantity) OVER b AS volume_5m,
       sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER a AS cvd_1m, sum(CASE WHEN side = 'buy' THEN quantity ELSE
       -quantity END) OVER c AS cvd_15m, sum(price * quantity) OVER a / sum(quantity) OVER a AS vwap_1m, sum(price * quantity) OVER
       b / sum(quantity) OVER b AS vwap_5m, avg(quantity) OVER b AS avg_trade_size FROM trades WINDOW
       a AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
       c AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    return B.trade_features_rolling(t.trades, minutes=(360, 1440, 4320)).select(
        "trade_id", "trade_count_1m", "volume_5m", "cvd_1m", "cvd_15m", "vwap_1m", "vwap_5m", "avg_trade_size")


TENS = "r AS (SELECT *, round(price, -1) AS p10, time_bucket(INTERVAL '6 hours', ts) AS bucket FROM trades)"


def tens(t):
    return t.trades.withColumn("price", F.round("price", -1))


@query("b3_flow_features", uses="trades timed_books", doubles="buy_sell_ratio taker_buy_ratio aggressive_buy_volume net_aggressive_flow flow_imbalance flow_toxicity absorption_ratio momentum_flow",
       sql=f"""WITH {TENS}, b AS (SELECT symbol, bucket, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS b, sum(CASE WHEN
       side = 'sell' THEN quantity ELSE 0 END) AS s, avg(quantity) AS av, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END)
       AS ab, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS asl, arg_min(p10, ts) AS p0, arg_max(p10, ts) AS p1,
       count(*) AS n, max(ts) AS ts FROM r GROUP BY 1, 2), l AS (SELECT r.symbol, r.bucket, sum(CASE WHEN quantity > 2 * av THEN
       quantity ELSE 0 END) AS big FROM r JOIN b ON r.symbol = b.symbol AND r.bucket = b.bucket GROUP BY 1, 2), j AS (SELECT b.*,
       big, list_sum([x.qty for x in k.bids[1:5]]) + list_sum([x.qty for x in k.asks[1:5]]) AS depth FROM b JOIN l ON b.symbol =
       l.symbol AND b.bucket = l.bucket ASOF LEFT JOIN timed_books k ON b.symbol = k.symbol AND b.ts >= k.ts) SELECT symbol, bucket,
       CASE WHEN s > 0 THEN least(b / s, 10) WHEN b > 0 THEN 10 ELSE 0 END AS buy_sell_ratio, b / (b + s) AS taker_buy_ratio, ab AS
       aggressive_buy_volume, ab - asl AS net_aggressive_flow, (b - s) / (b + s) AS flow_imbalance, abs(b - s) / (b + s) AS
       flow_toxicity, coalesce(least(1, big / depth), 0) AS absorption_ratio, CASE WHEN n >= 2 AND p0 <> 0 THEN (p1 - p0) / p0 * 100
       * (b - s) / (b + s) ELSE 0 END AS momentum_flow FROM j""")
def _(t):
    return B.flow_features(tens(t), t.timed_books, "6 hours").select(
        "symbol", "bucket", "buy_sell_ratio", "taker_buy_ratio", "aggressive_buy_volume", "net_aggressive_flow",
        "flow_imbalance", "flow_toxicity", "absorption_ratio", "momentum_flow")


@query("b4_sweep_flag", uses="trades", sql=f"""WITH {TENS}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, bucket
       ORDER BY ts DESC) <= 10), g AS (SELECT symbol, bucket, count(DISTINCT CASE WHEN side = 'buy' THEN p10 END) AS bp, count(DISTINCT
       CASE WHEN side = 'sell' THEN p10 END) AS sp, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS b, sum(CASE WHEN side =
       'sell' THEN quantity ELSE 0 END) AS s, count(*) AS n FROM l GROUP BY 1, 2) SELECT symbol, bucket, n >= 5 AND (bp >= 3 OR sp >= 3)
       AND abs(b - s) / (b + s) > 0.7 AS sweep_detected FROM g""")
def _(t):
    df = tens(t).withColumn("bucket", F.window("ts", "6 hours").start)
    return B.sweep_flags(df, ["symbol", "bucket"], ["ts", "trade_id"])


@query("b5_iceberg_flag", uses="trades", sql="""WITH r AS (SELECT *, round(price, -1) AS p10, time_bucket(INTERVAL '6 hours', ts) AS bucket,
       round(quantity, -2) + 50 AS q FROM trades), m AS (SELECT symbol, bucket, p10, avg(q) AS av FROM r GROUP BY 1, 2, 3 HAVING count(*)
       >= 5), p AS (SELECT r.symbol, r.bucket, r.p10, count(*) FILTER (q BETWEEN 0.8 * av AND 1.2 * av) / count(*) >= 0.8 AS hit FROM r
       JOIN m ON r.symbol = m.symbol AND r.bucket = m.bucket AND r.p10 = m.p10 GROUP BY 1, 2, 3) SELECT symbol, bucket, bool_or(hit) AS
       iceberg_detected FROM p GROUP BY 1, 2""")
def _(t):
    df = tens(t).withColumns({"bucket": F.window("ts", "6 hours").start, "quantity": F.round("quantity", -2) + 50})
    return B.iceberg_flags(df, ["symbol", "bucket"])


@query("b6_funding_features", uses="funding", digits=10, doubles="funding_rate_8h_avg funding_rate_24h_avg funding_rate_7d_avg funding_rate_change funding_rate_zscore funding_rate_pct annualized_rate funding_premium",
       sql="""WITH w AS (SELECT *, avg(funding_rate) OVER a AS a8, avg(funding_rate) OVER b AS a24, avg(funding_rate) OVER c AS a7,
       funding_rate - lag(funding_rate) OVER o AS ch, avg(funding_rate) OVER r AS m, stddev_pop(funding_rate) OVER r AS sd FROM funding
       WINDOW a AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 8 HOUR PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
       c AS (PARTITION BY symbol, exchange ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW),
       o AS (PARTITION BY symbol, exchange ORDER BY ts, event_id), r AS (PARTITION BY symbol, exchange ORDER BY ts, event_id ROWS 99
       PRECEDING)) SELECT event_id, a8 AS funding_rate_8h_avg, a24 AS funding_rate_24h_avg, a7 AS funding_rate_7d_avg, ch AS
       funding_rate_change, CASE WHEN sd < 1e-12 THEN 0 ELSE (funding_rate - m) / sd END AS funding_rate_zscore, funding_rate * 100 AS
       funding_rate_pct, funding_rate * 1095 AS annualized_rate, funding_rate - a7 AS funding_premium,
       time_bucket(INTERVAL '8 hours', ts) + INTERVAL 8 HOUR AS next_funding_time FROM w""")
def _(t):
    return B.funding_features(t.funding).select(
        "event_id", "funding_rate_8h_avg", "funding_rate_24h_avg", "funding_rate_7d_avg", "funding_rate_change",
        "funding_rate_zscore", "funding_rate_pct", "annualized_rate", "funding_premium", "next_funding_time")


@query("b7_oi_features", uses="oi ticker", digits=7, doubles="open_interest_usd oi_change_1h oi_change_24h oi_change_pct_24h leverage_ratio oi_delta oi_momentum oi_price_divergence",
       sql="""WITH j AS (SELECT o.*, a.open_interest AS o1, c.open_interest AS o24, k.volume_24h FROM oi o
       ASOF LEFT JOIN (SELECT symbol, exchange, ts + INTERVAL 1 HOUR AS ts, open_interest FROM oi) a ON o.symbol = a.symbol AND
       o.exchange = a.exchange AND o.ts >= a.ts ASOF LEFT JOIN (SELECT symbol, exchange, ts + INTERVAL 24 HOUR AS ts, open_interest FROM
       oi) c ON o.symbol = c.symbol AND o.exchange = c.exchange AND o.ts >= c.ts ASOF LEFT JOIN ticker k ON o.symbol = k.symbol AND
       o.exchange = k.exchange AND o.ts >= k.ts) SELECT event_id, open_interest * price AS open_interest_usd, open_interest - o1 AS
       oi_change_1h, open_interest - o24 AS oi_change_24h, (open_interest - o24) / o24 * 100 AS oi_change_pct_24h, open_interest /
       volume_24h AS leverage_ratio, open_interest - lag(open_interest) OVER w AS oi_delta, coalesce((open_interest -
       lag(open_interest, 9) OVER w) / 10, 0) AS oi_momentum, CASE WHEN count(*) OVER r >= 10 THEN -corr(open_interest, price) OVER r
       ELSE 0 END AS oi_price_divergence FROM j WINDOW w AS (PARTITION BY symbol, exchange ORDER BY ts, event_id), r AS (PARTITION BY
       symbol, exchange ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def _(t):
    return B.oi_features(t.oi, t.ticker).select(
        "event_id", "open_interest_usd", "oi_change_1h", "oi_change_24h", "oi_change_pct_24h", "leverage_ratio", "oi_delta",
        "oi_momentum", "oi_price_divergence")


@query("b8_volatility_features", uses="bars", doubles="volatility_5m volatility_1h realized_volatility garman_klass_vol parkinson_vol atr_14 volatility_percentile volatility_zscore",
       sql="""WITH r AS (SELECT *, close / lag(close) OVER w - 1 AS r, ln(high / low) AS hl, ln(close / open) AS co, greatest(high - low,
       abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
       v AS (SELECT *, coalesce(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING), 0) AS v5,
       coalesce(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY open_time ROWS 14 PRECEDING), 0) AS v15, coalesce(stddev_samp(r) OVER
       (PARTITION BY symbol ORDER BY open_time ROWS 59 PRECEDING), 0) AS v60, avg(tr) OVER (PARTITION BY symbol ORDER BY open_time ROWS 13
       PRECEDING) AS atr, sqrt(coalesce(sum(r * r) OVER h, 0)) AS rv, sqrt(greatest(0, avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co) OVER
       h)) AS gk, sqrt(avg(hl * hl) OVER h / (4 * ln(2))) AS pk FROM r WINDOW h AS (PARTITION BY symbol ORDER BY open_time ROWS 59
       PRECEDING)), p AS (SELECT *, list(v15) OVER b AS xs, avg(v15) OVER b AS m, stddev_pop(v15) OVER b AS sd FROM v WINDOW b AS
       (PARTITION BY symbol ORDER BY open_time ROWS 99 PRECEDING)), q AS (SELECT *, len([x for x in xs if x < v15]) / len(xs) * 100 AS pct
       FROM p) SELECT symbol, open_time, v5 AS volatility_5m, v60 AS volatility_1h, rv AS realized_volatility, gk AS garman_klass_vol, pk
       AS parkinson_vol, atr AS atr_14, pct AS volatility_percentile, CASE WHEN sd < 1e-12 THEN 0 ELSE (v15 - m) / sd END AS
       volatility_zscore, CASE WHEN pct >= 67 THEN 'HIGH' WHEN pct >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS volatility_regime FROM q""")
def _(t):
    return B.volatility_features(t.bars).select(
        "symbol", "open_time", "volatility_5m", "volatility_1h", "realized_volatility", "garman_klass_vol", "parkinson_vol",
        "atr_14", "volatility_percentile", "volatility_zscore", "volatility_regime")


@query("b9_momentum_features", uses="bars", digits=7, doubles="momentum_1m momentum_1h rsi_14 stoch_k stoch_d williams_r cci roc rsi_divergence macd_line macd_signal",
       sql="""WITH c AS (SELECT *, close - lag(close) OVER w AS ch, (close / lag(close) OVER w - 1) * 100 AS m1, (close / lag(close, 60) OVER
       w - 1) * 100 AS m60, (close / lag(close, 12) OVER w - 1) * 100 AS roc, min(low) OVER f AS ll, max(high) OVER f AS hh, (high + low +
       close) / 3 AS tp, row_number() OVER w AS rn, list(close) OVER u AS cs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time),
       f AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING), u AS (PARTITION BY symbol ORDER BY open_time ROWS 900 PRECEDING)),
       g AS (SELECT *, avg(CASE WHEN ch > 0 THEN ch WHEN ch IS NOT NULL THEN 0 END) OVER f AS gain, avg(CASE WHEN ch < 0 THEN -ch WHEN ch IS
       NOT NULL THEN 0 END) OVER f AS loss, CASE WHEN hh > ll THEN (close - ll) / (hh - ll) * 100 ELSE 50 END AS k, list(tp) OVER t AS tps,
       list_reduce(cs, lambda a, x: x * (2e0 / 13) + a * (11e0 / 13)) - list_reduce(cs, lambda a, x: x * (2e0 / 27) + a * (25e0 / 27)) AS
       macd FROM c WINDOW f AS (PARTITION BY symbol ORDER BY open_time ROWS 14 PRECEDING), t AS (PARTITION BY symbol ORDER BY open_time ROWS
       19 PRECEDING)), h AS (SELECT *, CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, list_avg(tps) AS tm, list(macd) OVER
       (PARTITION BY symbol ORDER BY open_time ROWS 900 PRECEDING) AS ms FROM g), d AS (SELECT *, list_avg([abs(x - tm) for x in tps]) AS dev
       FROM h) SELECT symbol, open_time, m1 AS momentum_1m, m60 AS momentum_1h, rsi AS rsi_14, k AS stoch_k, avg(k) OVER (PARTITION BY symbol
       ORDER BY open_time ROWS 2 PRECEDING) AS stoch_d, CASE WHEN hh > ll THEN (hh - close) / (hh - ll) * -100 ELSE -50 END AS williams_r,
       CASE WHEN dev > 1e-12 THEN (tp - tm) / (0.015 * dev) ELSE 0 END AS cci, roc, CASE WHEN rn >= 14 THEN coalesce(-corr(rsi, close) OVER
       (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING), 0) ELSE 0 END AS rsi_divergence, macd AS macd_line, list_reduce(ms, lambda
       a, x: x * 0.2e0 + a * 0.8e0) AS macd_signal FROM d""")
def _(t):
    return B.momentum_features(t.bars).select(
        "symbol", "open_time", "momentum_1m", "momentum_1h", "rsi_14", "stoch_k", "stoch_d", "williams_r", "cci", "roc",
        "rsi_divergence", "macd_line", "macd_signal")


@query("b10_signals", uses="ev", digits=8, doubles="composite_score signal_confidence trend_signal", sql="""WITH x AS (SELECT event_id, (value -
       50) / 10 AS pc, CASE WHEN k > 5 THEN k END AS rsi, (k - 50) / 60.0e0 AS fi, (value - 40) / 20 AS fz, (event_id % 31 - 15) / 2.0e0 AS
       oc, (event_id % 13 - 6) / 2.5e0 AS vz FROM ev), s AS (SELECT *, greatest(-1, least(1, pc / 5)) AS t, CASE WHEN rsi IS NOT NULL THEN
       greatest(-1, least(1, (rsi - 50) / 50)) END AS m, greatest(-1, least(1, fi)) AS f, greatest(-1, least(1, -fz / 3)) AS fu,
       greatest(-1, least(1, oc / 10)) * sign(pc) AS o, greatest(-1, least(1, -vz / 3)) AS v FROM x), c AS (SELECT *, (t * 0.25 +
       coalesce(m, 0) * 0.2 + f * 0.2 + fu * 0.15 + o * 0.1 + v * 0.1) / (CASE WHEN m IS NULL THEN 0.8 ELSE 1.0 END) AS comp,
       abs(sign(t) + coalesce(sign(m), 0) + sign(f) + sign(fu) + sign(o) + sign(v)) / nullif(CAST(t <> 0 AS INT) + CAST(coalesce(m <> 0,
       false) AS INT) + CAST(f <> 0 AS INT) + CAST(fu <> 0 AS INT) + CAST(o <> 0 AS INT) + CAST(v <> 0 AS INT), 0) AS conf FROM s) SELECT
       event_id, t AS trend_signal, comp AS composite_score, coalesce(conf, 0) AS signal_confidence, CASE WHEN vz > 2 THEN 'VOLATILE' WHEN t
       > 0.3 THEN 'TRENDING_UP' WHEN t < -0.3 THEN 'TRENDING_DOWN' ELSE 'RANGING' END AS market_regime, CASE WHEN comp > 0.2 THEN 'LONG'
       WHEN comp < -0.2 THEN 'SHORT' ELSE 'NEUTRAL' END AS bias FROM c""")
def _(t):
    e = C("event_id")
    f = t.ev.select("event_id", ((C("value") - 50) / 10).alias("price_change_5m"),
                    F.when(C("k") > 5, C("k").cast("double")).alias("rsi_14"), ((C("k") - 50) / 60.0).alias("flow_imbalance"),
                    ((C("value") - 40) / 20).alias("funding_zscore"), ((e % 31 - 15) / 2.0).alias("oi_change_pct"),
                    ((e % 13 - 6) / 2.5).alias("volatility_zscore"))
    return B.signals(f).select("event_id", "trend_signal", "composite_score", "signal_confidence", "market_regime", "bias")


@query("b11_cross_exchange_features", uses="prices funding trades oi", digits=7, doubles="click_view_spread max_price_spread avg_price_spread funding_spread_max funding_spread_avg click_volume_share view_oi_share exchange_flow_divergence",
       sql="""WITH p AS (SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS bucket, exchange, arg_max(mid_price, ts) AS price FROM prices
       GROUP BY 1, 2, 3), a AS (SELECT symbol, bucket, (max(price) FILTER (exchange = 'view') - max(price) FILTER (exchange = 'click')) /
       max(price) FILTER (exchange = 'click') * 100 AS click_view_spread, (max(price) - min(price)) / min(price) * 100 AS max_price_spread,
       count(*) AS venues, (max(price) - min(price)) / min(price) * 100 > 0.1 AS arbitrage_opportunity FROM p GROUP BY 1, 2), pr AS (SELECT
       x.symbol, x.bucket, avg(abs(y.price - x.price) / least(x.price, y.price) * 100) AS avg_price_spread FROM p x JOIN p y ON x.symbol =
       y.symbol AND x.bucket = y.bucket AND x.exchange < y.exchange GROUP BY 1, 2), f AS (SELECT symbol, time_bucket(INTERVAL '6 hours', ts)
       AS bucket, exchange, arg_max(funding_rate, ts) AS r FROM funding GROUP BY 1, 2, 3), fs AS (SELECT symbol, bucket, max(r) - min(r) AS
       funding_spread_max, max(r) - avg(r) AS funding_spread_avg FROM f GROUP BY 1, 2), t AS (SELECT symbol, time_bucket(INTERVAL '6 hours',
       ts) AS bucket, exchange, sum(quote_value) AS v, sum(CASE WHEN side = 'buy' THEN quote_value ELSE -quote_value END) AS net FROM trades
       GROUP BY 1, 2, 3), tf AS (SELECT symbol, bucket, coalesce(sum(v) FILTER (exchange = 'click'), 0) / sum(v) AS click_volume_share, 1 -
       abs(sum(sign(net))) / count(*) AS exchange_flow_divergence FROM t GROUP BY 1, 2), o AS (SELECT symbol, time_bucket(INTERVAL '6
       hours', ts) AS bucket, exchange, arg_max(open_interest, ts) AS v FROM oi GROUP BY 1, 2, 3), os AS (SELECT symbol, bucket,
       coalesce(sum(v) FILTER (exchange = 'view'), 0) / sum(v) AS view_oi_share FROM o GROUP BY 1, 2) SELECT * FROM a LEFT JOIN pr USING
       (symbol, bucket) LEFT JOIN fs USING (symbol, bucket) LEFT JOIN tf USING (symbol, bucket) LEFT JOIN os USING (symbol, bucket)""")
def _(t):
    return B.cross_exchange_features(t.prices, t.funding, t.trades, t.oi, VENUES, "6 hours").select(
        "symbol", "bucket", "click_view_spread", "max_price_spread", "avg_price_spread", "venues", "arbitrage_opportunity",
        "funding_spread_max", "funding_spread_avg", "click_volume_share", "view_oi_share", "exchange_flow_divergence")


@query("b11_lead_lag_score", uses="ev", doubles="lead_lag_score", sql=f"""WITH {RETURNS}, c AS (SELECT a.symbol, a.exchange AS leader,
       b.exchange AS follower, l.lag, corr(a.ret, b.ret) AS c FROM r a CROSS JOIN (SELECT unnest(range(5)) AS lag) l JOIN r b ON a.symbol =
       b.symbol AND b.idx = a.idx - l.lag AND a.exchange <> b.exchange WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3, 4), gg
       AS (SELECT symbol, leader, follower, max(abs(c)) FILTER (lag > 0) - max(abs(c)) FILTER (lag = 0) AS gain FROM c GROUP BY 1, 2, 3), p AS
       (SELECT symbol, leader, avg(gain) AS s FROM gg GROUP BY 1, 2) SELECT symbol, arg_max(leader, s) AS leader, max(s) AS lead_lag_score
       FROM p GROUP BY 1""")
def _(t):
    return B.lead_lag_score(J.lag_pairs(returns_grid(t)))


def _stored_funding(t):
    root = scratch_path(t.spark, "b12")
    store.append(B.funding_features(t.funding), root, "funding_features")
    return t.spark.read.parquet(f"{root}/funding_features")


@query("b12_feature_history", uses="funding", digits=9, doubles="funding_rate_pct", sql="""SELECT symbol, exchange, ts, funding_rate * 100 AS
       funding_rate_pct FROM funding WHERE ts >= (SELECT max(ts) FROM funding) - INTERVAL 48 HOUR""")
def _(t):
    return B.feature_history(_stored_funding(t), ["funding_rate_pct"], 48)


@query("b12_latest_features", uses="funding", digits=9, doubles="annualized_rate", sql="""SELECT symbol, exchange, max(ts) AS ts,
       arg_max(funding_rate, ts) * 1095 AS annualized_rate FROM funding WHERE symbol IN ('S0', 'S3') GROUP BY 1, 2""")
def _(t):
    return B.latest_features(_stored_funding(t), ["S0", "S3"]).select("symbol", "exchange", "ts", "annualized_rate")


@query("b13_feature_status", uses="funding trades", sql="""WITH s AS (SELECT count(*) AS row_count, max(ts) AS last_record, 'funding' AS category
       FROM funding UNION ALL SELECT count(*), max(ts), 'flow' FROM trades), n AS (SELECT max(last_record) AS now FROM s)
       SELECT s.*, CAST(floor(epoch(now - last_record)) AS BIGINT) AS age_seconds, CASE WHEN row_count = 0 THEN 'empty' WHEN floor(epoch(now -
       last_record)) > 300 THEN 'stale' ELSE 'fresh' END AS status FROM s, n""")
def _(t):
    return B.feature_status({"funding": _stored_funding(t), "flow": t.trades})
