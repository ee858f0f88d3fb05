"""Aggregations (A) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.functions import columns as K
from tickloom.operators import aggregates as A
from tickloom.operators import sets as U

C = F.col


@query("a1_trade_summary", uses="trades", doubles="buy_volume sell_volume total_volume avg_price", sql="""
       SELECT exchange, count(*) AS trade_count, sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END) AS buy_volume,
       sum(CASE WHEN side = 'sell' THEN quote_value ELSE 0 END) AS sell_volume, sum(quote_value) AS total_volume,
       avg(price) AS avg_price, max(price) AS high_price, min(price) AS low_price FROM trades GROUP BY 1""")
def _(t):
    return A.trade_summary(t.trades, ["exchange"])


@query("a2_liquidation_summary", uses="liquidations", doubles="long_liquidations short_liquidations total_value", sql="""
       SELECT exchange, count(*) AS total_count, sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS long_liquidations,
       sum(CASE WHEN side = 'short' THEN value_usd ELSE 0 END) AS short_liquidations, sum(value_usd) AS total_value,
       max(value_usd) AS largest_liquidation FROM liquidations WHERE value_usd >= 100 GROUP BY 1""")
def _(t):
    return A.liquidation_summary(t.liquidations, ["exchange"], least=100)


@query("a3_funding_stats", uses="funding", digits=9, doubles="avg_rate min_rate max_rate volatility cumulative avg_annualized",
       sql="""SELECT symbol, exchange, avg(funding_rate) AS avg_rate, min(funding_rate) AS min_rate, max(funding_rate)
       AS max_rate, stddev(funding_rate) AS volatility, sum(funding_rate) AS cumulative, count(funding_rate) AS samples,
       avg(funding_rate) * 3 * 365 * 100 AS avg_annualized FROM funding GROUP BY 1, 2""")
def _(t):
    return A.funding_stats(t.funding, ["symbol", "exchange"])


PRICE_STATS = """SELECT symbol, exchange, arg_min(mid_price, ts) AS open, arg_max(mid_price, ts) AS close,
       min(mid_price) AS low, max(mid_price) AS high, avg(mid_price) AS average, stddev(mid_price) AS volatility,
       count(*) AS ticks, arg_max(mid_price, ts) - arg_min(mid_price, ts) AS change,
       (arg_max(mid_price, ts) - arg_min(mid_price, ts)) / arg_min(mid_price, ts) * 100 AS change_pct
       FROM prices GROUP BY 1, 2"""


@query("a4_price_window_stats", uses="prices", doubles="average volatility change change_pct", sql=PRICE_STATS)
def _(t):
    return A.price_window_stats(t.prices, ["symbol", "exchange"])


@query("a4_price_window_stats_equal_times", uses="prices", doubles="average volatility change change_pct", sql="""WITH h AS (SELECT *, date_trunc('hour', ts) AS h FROM prices),
       s AS (SELECT symbol, exchange, first(mid_price ORDER BY h, event_id) AS open, last(mid_price ORDER BY h, event_id) AS close, min(mid_price) AS low, max(mid_price) AS high,
       avg(mid_price) AS average, stddev_samp(mid_price) AS volatility, count(*) AS ticks FROM h GROUP BY 1, 2) SELECT *, close - open AS change, (close - open) / open * 100 AS change_pct FROM s""")
def _(t):
    return A.price_window_stats(t.prices.withColumn("ts", F.date_trunc("hour", "ts")), ["symbol", "exchange"], tie="event_id")


@query("a5_quartiles", uses="prices", doubles="p25 p50 p75", sql="""SELECT exchange, quantile_cont(mid_price, 0.25) AS p25,
       quantile_cont(mid_price, 0.5) AS p50, quantile_cont(mid_price, 0.75) AS p75 FROM prices GROUP BY 1""")
def _(t):
    return A.quartiles(t.prices, ["exchange"], "mid_price")


@query("a6_compare_vs_history", uses="prices", doubles="avg_price stddev deviation deviation_pct z_score", sql="""
       WITH n AS (SELECT max(ts) AS now FROM prices), h AS (SELECT * FROM (VALUES ('5m', 5), ('15m', 15), ('1h', 60),
       ('4h', 240), ('24h', 1440)) AS v("window", minutes)), l AS (SELECT exchange, arg_max(mid_price, ts) AS live_price
       FROM prices, n WHERE ts >= now - INTERVAL 1440 MINUTE GROUP BY 1), s AS (SELECT exchange, "window", minutes,
       avg(mid_price) AS avg_price, stddev(mid_price) AS stddev, min(mid_price) AS min, max(mid_price) AS max
       FROM prices, n, h WHERE ts >= now - to_minutes(minutes) GROUP BY 1, 2, 3), z AS (SELECT *,
       live_price - avg_price AS deviation, (live_price - avg_price) / avg_price * 100 AS deviation_pct,
       CASE WHEN stddev IS NULL OR stddev = 0 THEN 0 ELSE (live_price - avg_price) / stddev END AS z_score
       FROM s JOIN l USING (exchange)) SELECT *, CASE WHEN z_score > 2 THEN 'SIGNIFICANTLY_HIGH' WHEN z_score > 1 THEN
       'MODERATELY_HIGH' WHEN z_score < -2 THEN 'SIGNIFICANTLY_LOW' WHEN z_score < -1 THEN 'MODERATELY_LOW'
       ELSE 'NORMAL' END AS signal FROM z""")
def _(t):
    return A.compare_vs_history(t.prices, ["exchange"])


@query("a7_ohlc", uses="prices", sql="""SELECT exchange, time_bucket(INTERVAL '4 hours', ts) AS bucket,
       arg_min(mid_price, ts) AS open, max(mid_price) AS high, min(mid_price) AS low, arg_max(mid_price, ts) AS close,
       count(*) AS ticks FROM prices GROUP BY 1, 2""")
def _(t):
    return A.ohlc(t.prices, "4 hours")


@query("a7_ohlc_equal_times", uses="prices", sql="""WITH h AS (SELECT *, date_trunc('hour', ts) AS h FROM prices) SELECT exchange, time_bucket(INTERVAL '4 hours', h) AS bucket,
       first(mid_price ORDER BY h, event_id) AS open, max(mid_price) AS high, min(mid_price) AS low, last(mid_price ORDER BY h, event_id) AS close, count(*) AS ticks FROM h GROUP BY 1, 2""")
def _(t):
    return A.ohlc(t.prices.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "4 hours", tie="event_id")


@query("a8_trade_candles", uses="trades", doubles="volume quote_volume taker_buy_volume taker_buy_quote taker_buy_pct", sql="""
       SELECT *, CASE WHEN volume > 0 AND taker_buy_volume <> 0 THEN taker_buy_volume / volume * 100 END AS taker_buy_pct
       FROM (SELECT symbol, exchange, time_bucket(INTERVAL '1 hour', ts) AS open_time, arg_min(price, ts) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(quantity) AS volume,
       sum(price * quantity) AS quote_volume, count(*) AS trade_count,
       sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS taker_buy_volume,
       sum(CASE WHEN side = 'buy' THEN price * quantity ELSE 0 END) AS taker_buy_quote FROM trades GROUP BY 1, 2, 3)""")
def _(t):
    return A.trade_candles(t.trades, "1 hour")


@query("a9_reaggregate", uses="trades", doubles="volume quote_volume taker_buy_volume taker_buy_quote", sql="""
       SELECT symbol, exchange, time_bucket(INTERVAL '4 hours', ts) AS open_time, arg_min(price, ts) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(quantity) AS volume,
       sum(price * quantity) AS quote_volume, count(*) AS trade_count,
       sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS taker_buy_volume,
       sum(CASE WHEN side = 'buy' THEN price * quantity ELSE 0 END) AS taker_buy_quote FROM trades GROUP BY 1, 2, 3""")
def _(t):
    return A.reaggregate(A.trade_candles(t.trades, "15 minutes"), "15m", "4h", by=("symbol", "exchange"))


@query("a10_volume_profile", uses="trades", doubles="volume buy_volume sell_volume", sql="""SELECT round(price, -1) AS price_level,
       sum(quote_value) AS volume, count(*) AS trade_count, sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END)
       AS buy_volume, sum(CASE WHEN side = 'sell' THEN quote_value ELSE 0 END) AS sell_volume FROM trades GROUP BY 1
       ORDER BY volume DESC, price_level LIMIT 20""")
def _(t):
    return A.volume_profile(t.trades, digits=-1)


@query("a11_volatility_buckets", uses="prices", doubles="price_stddev price_range avg_spread_bps", sql="""SELECT exchange,
       time_bucket(INTERVAL '1 hour', ts) AS bucket, stddev(mid_price) AS price_stddev,
       max(mid_price) - min(mid_price) AS price_range, avg(CASE WHEN (bid_price + ask_price) / 2 > 0 THEN
       (ask_price - bid_price) / ((bid_price + ask_price) / 2) * 10000 ELSE 0 END) AS avg_spread_bps,
       count(*) AS samples FROM prices GROUP BY 1, 2""")
def _(t):
    return A.volatility_buckets(K.with_spread(t.prices), "1 hour")


@query("a12_funding_cumulative", uses="funding", digits=9, doubles="funding_rate cumulative_rate", sql="""SELECT event_id, symbol,
       exchange, ts, funding_rate, sum(funding_rate) OVER (PARTITION BY symbol, exchange ORDER BY ts, event_id
       ROWS UNBOUNDED PRECEDING) AS cumulative_rate FROM funding""")
def _(t):
    return A.funding_cumulative(t.funding)


@query("a13_liquidation_buckets", uses="liquidations", doubles="total_value long_value short_value avg_price", sql="""
       SELECT exchange, time_bucket(INTERVAL '30 minutes', ts) AS bucket, count(*) AS liq_count, sum(value_usd) AS
       total_value, sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS long_value,
       sum(CASE WHEN side = 'short' THEN value_usd ELSE 0 END) AS short_value, avg(price) AS avg_price
       FROM liquidations GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY total_value DESC, bucket LIMIT 20""")
def _(t):
    return A.liquidation_buckets(t.liquidations, "30 minutes", n=20)


@query("a14_liquidation_cascades", uses="liquidations", doubles="total_value avg_price", sql="""SELECT
       date_trunc('minute', ts) AS minute, symbol, side, count(*) AS liq_count, sum(value_usd) AS total_value,
       avg(price) AS avg_price FROM liquidations GROUP BY 1, 2, 3 HAVING count(*) > 3 OR sum(value_usd) > 5000""")
def _(t):
    return A.liquidation_cascades(t.liquidations, least_value=5000)


@query("a15_liquidation_heatmap", uses="liquidations", doubles="price_start price_end long_liquidations short_liquidations total_value",
       sql="""WITH e AS (SELECT symbol, min(price) AS lo, (max(price) - min(price)) / 20 AS step FROM liquidations GROUP BY 1),
       h AS (SELECT symbol, CAST(least(floor((price - lo) / step), 19) AS INTEGER) AS zone,
       sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS l, sum(CASE WHEN side <> 'long' THEN value_usd ELSE 0 END)
       AS s, sum(value_usd) AS v, count(*) AS n FROM liquidations JOIN e USING (symbol) GROUP BY 1, 2), g AS (SELECT *
       FROM e, (SELECT CAST(unnest(range(20)) AS INTEGER) AS zone)), t AS (SELECT symbol, arg_max(zone, v) AS top FROM h
       GROUP BY 1) SELECT g.symbol, g.zone, lo + g.zone * step AS price_start, lo + (g.zone + 1) * step AS price_end,
       coalesce(l, 0) AS long_liquidations, coalesce(s, 0) AS short_liquidations, coalesce(v, 0) AS total_value,
       coalesce(n, 0) AS count, g.zone = top AS hottest FROM g LEFT JOIN h ON g.symbol = h.symbol AND g.zone = h.zone
       JOIN t ON g.symbol = t.symbol""")
def _(t):
    return A.liquidation_heatmap(t.liquidations)


@query("a16_liquidation_pressure", uses="liquidations", doubles="price pct_from_current long_value short_value zone_value total_value estimated_remaining_at_risk",
       digits=4, sql="""WITH c AS (SELECT symbol, 60.0e0 + count(*) % 7 AS p FROM liquidations GROUP BY 1), z AS (SELECT symbol, p,
       round_even(price / (p * 0.01), 0) AS z, sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS l,
       sum(CASE WHEN side <> 'long' THEN value_usd ELSE 0 END) AS s, count(*) AS n FROM liquidations JOIN c USING (symbol)
       GROUP BY 1, 2, 3), t AS (SELECT symbol, sum(l) AS lt, sum(s) AS st, CAST(sum(n) AS BIGINT) AS nt FROM z GROUP BY 1), r AS
       (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY l + s DESC, z) AS rank FROM z QUALIFY rank <= 10)
       SELECT symbol, CAST(rank AS INTEGER) AS rank, z * p * 0.01 AS price, (z * p * 0.01 - p) / p * 100 AS pct_from_current,
       l AS long_value, s AS short_value, l + s AS zone_value, n AS count, nt AS total_liquidations, lt + st AS total_value,
       CASE WHEN lt / (lt + st) > 0.7 THEN 'LONG_LIQUIDATION_DOMINANT' WHEN st / (lt + st) > 0.7 THEN
       'SHORT_LIQUIDATION_DOMINANT' ELSE 'BALANCED' END AS dominance, CASE WHEN lt + st > 10000000 THEN 'EXTREME'
       WHEN lt + st > 1000000 THEN 'HIGH' WHEN lt + st > 100000 THEN 'MODERATE' ELSE 'LOW' END AS cascade_risk,
       (lt + st) * 2.5 AS estimated_remaining_at_risk FROM r JOIN t USING (symbol)""")
def _(t):
    latest = t.liquidations.groupBy("symbol").agg((F.count(F.lit(1)) % 7 + F.lit(60.0)).alias("current_price"))
    return A.liquidation_pressure(t.liquidations, latest)


@query("a17_ofi", uses="books", doubles="ofi ofi_normalized", sql="""WITH d AS (SELECT symbol, ts,
       list_sum([x.qty for x in bids]) AS b, list_sum([x.qty for x in asks]) AS a FROM books), l AS (SELECT *,
       lag(b) OVER (PARTITION BY symbol ORDER BY ts) AS pb, lag(a) OVER (PARTITION BY symbol ORDER BY ts) AS pa FROM d)
       SELECT symbol, sum(b - coalesce(pb, b)) - sum(a - coalesce(pa, a)) AS ofi, (sum(b - coalesce(pb, b)) -
       sum(a - coalesce(pa, a))) / nullif(sum(b) + sum(a), 0) AS ofi_normalized FROM l GROUP BY 1""")
def _(t):
    return A.ofi(K.with_book_totals(t.books))


@query("a18_buy_sell_ratio", uses="trades", doubles="buy_volume sell_volume buy_ratio net_flow", sql="""SELECT exchange,
       sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN quote_value
       ELSE 0 END) AS sell_volume, sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END) / nullif(sum(quote_value), 0)
       AS buy_ratio, sum(CASE WHEN side = 'buy' THEN quote_value ELSE -quote_value END) AS net_flow FROM trades GROUP BY 1""")
def _(t):
    return A.buy_sell_ratio(t.trades)


@query("a19_flow_buckets", uses="trades", doubles="buy_volume sell_volume net_flow ratio avg_price", sql="""SELECT *,
       buy_volume - sell_volume AS net_flow, CASE WHEN sell_volume > 0 THEN least(buy_volume / sell_volume, 100) ELSE 100
       END AS ratio FROM (SELECT exchange, time_bucket(INTERVAL '15 minutes', ts) AS bucket,
       sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN quote_value
       ELSE 0 END) AS sell_volume, count(*) AS trade_count, avg(price) AS avg_price FROM trades GROUP BY 1, 2)""")
def _(t):
    return A.flow_buckets(t.trades)


@query("a20_vwap", doubles="vwap", sql="""SELECT l_returnflag, l_linestatus, sum(l_extendedprice * l_quantity) /
       sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2""")
def _(t):
    return A.vwap(t.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


@query("a21_oi_price_divergence", uses="oi prices", doubles="avg_oi avg_price oi_change_pct price_change_pct", digits=5, sql="""WITH h AS (
       SELECT o.symbol, o.exchange, date_trunc('hour', o.ts) AS hour, avg(o.open_interest) AS avg_oi,
       avg(p.mid_price) AS avg_price FROM oi o JOIN prices p ON o.symbol = p.symbol AND o.exchange = p.exchange AND
       date_trunc('minute', o.ts) = date_trunc('minute', p.ts) GROUP BY 1, 2, 3), c AS (SELECT *,
       (avg_oi - lag(avg_oi) OVER w) / nullif(lag(avg_oi) OVER w, 0) * 100 AS oi_change_pct,
       (avg_price - lag(avg_price) OVER w) / nullif(lag(avg_price) OVER w, 0) * 100 AS price_change_pct FROM h
       WINDOW w AS (PARTITION BY symbol, exchange ORDER BY hour)) SELECT *, CASE
       WHEN oi_change_pct > 2 AND price_change_pct > 0.5 THEN 'NEW_LONGS'
       WHEN oi_change_pct > 2 AND price_change_pct < -0.5 THEN 'NEW_SHORTS'
       WHEN oi_change_pct < -2 AND price_change_pct > 0.5 THEN 'SHORT_SQUEEZE'
       WHEN oi_change_pct < -2 AND price_change_pct < -0.5 THEN 'LONG_LIQUIDATION' ELSE 'NORMAL' END AS signal
       FROM c WHERE abs(oi_change_pct) > 1 OR abs(price_change_pct) > 0.3""")
def _(t):
    return A.oi_price_divergence(t.oi, t.prices)


@query("a22_table_stats", uses="trades liquidations", sql="""SELECT 'trades' AS stream, symbol, exchange, count(*) AS row_count,
       min(ts) AS first_record, max(ts) AS last_record, 'healthy' AS status FROM trades GROUP BY 2, 3 UNION ALL
       SELECT 'liquidations', symbol, exchange, count(*), min(ts), max(ts), 'healthy' FROM liquidations GROUP BY 2, 3""")
def _(t):
    return A.table_stats({"trades": t.trades, "liquidations": t.liquidations})


@query("a23_source_summary", sql="""SELECT o_orderstatus, count(DISTINCT o_custkey) AS symbols, count(DISTINCT o_orderpriority)
       AS exchanges, count(*) AS total_sources, count(*) FILTER (o_totalprice > 100000) AS has_price_feeds,
       count(*) FILTER (o_orderkey % 3 = 0) AS has_oi_feeds FROM orders GROUP BY 1""")
def _(t):
    df = t.table("orders").withColumns({"has_price": C("o_totalprice") > 100000, "has_oi": C("o_orderkey") % 3 == 0})
    return A.source_summary(df, "o_orderstatus", "o_custkey", "o_orderpriority", ["has_price", "has_oi"])


@query("a24_coverage_matrix", uses="trades", sql="""SELECT symbol, count(*) FILTER (exchange = 'click') AS click,
       count(*) FILTER (exchange = 'view') AS view, count(*) FILTER (exchange = 'purchase') AS purchase,
       count(*) FILTER (exchange = 'error') AS error, count(*) FILTER (exchange = 'signup') AS signup
       FROM trades GROUP BY 1""")
def _(t):
    return A.coverage_matrix(t.trades, "symbol", "exchange", ["click", "view", "purchase", "error", "signup"])


def _profile_sql(table, cols):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS row_count, CAST(min({c}) AS DOUBLE) AS min,
       CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS avg, stddev({c}) AS stddev, count(DISTINCT {c}) AS distinct_count,
       100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct, 100.0 * count(*) FILTER ({c} = 0) / count(*) AS zero_pct,
       count(*) FILTER (isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE))) AS nan_inf_count,
       count(*) FILTER ({c} < 0) AS negative_count, avg({c}) > 0 AND max({c}) > avg({c}) * 1000 AS extreme_outlier
       FROM {table}""" for c in cols)


@query("a25_profile", doubles="avg stddev null_pct zero_pct", digits=7,
       sql=_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return A.profile(t.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("a26_feature_statistics", doubles="mean std median p25 p75", sql="""WITH f AS (SELECT 'l_quantity' AS feature,
       l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL
       SELECT 'l_extendedprice', l_extendedprice FROM lineitem), s AS (SELECT feature, avg(v) AS mean, stddev(v) AS std,
       min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25,
       quantile_cont(v, 0.75) AS p75 FROM f GROUP BY 1) SELECT *, std > abs(mean) * 2 AS high_variability,
       CASE WHEN abs(mean - median) > abs(mean) * 0.3 AND mean <> 0 THEN CASE WHEN mean > median THEN 'right' ELSE 'left'
       END ELSE 'none' END AS skew, max > p75 * 3 AS high_outliers, p25 < 0 AND min < p25 * 3 AS low_outliers FROM s""")
def _(t):
    return A.feature_statistics(t.table("lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


CORR_COLS = {"l_quantity": "trades", "l_extendedprice": "prices", "l_discount": "prices", "l_tax": "funding"}
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{CORR_COLS[a]}' AS type_a, '{b}' AS feature_b, '{CORR_COLS[b]}' AS type_b, "
    f"corr({a}, {b}) AS value, count(*) AS n FROM lineitem"
    for i, a in enumerate(CORR_COLS) for b in list(CORR_COLS)[i + 1:])


@query("a27_feature_correlation", doubles="value", digits=8, sql=CORR_SQL)
def _(t):
    return A.feature_correlation(t.table("lineitem"), CORR_COLS)


@query("a27_top_correlations", doubles="value", digits=8, sql=f"""WITH c AS ({CORR_SQL}) SELECT *, 'positive' AS list FROM
       (SELECT * FROM c WHERE value > 0 ORDER BY value DESC LIMIT 15) UNION ALL SELECT *, 'negative' FROM
       (SELECT * FROM c WHERE value < 0 ORDER BY value LIMIT 15)""")
def _(t):
    return A.top_correlations(A.feature_correlation(t.table("lineitem"), CORR_COLS))


@query("a27_cross_stream", doubles="avg_correlation", digits=8, sql=f"""WITH c AS ({CORR_SQL}), g AS (SELECT least(type_a, type_b)
       AS from_stream, greatest(type_a, type_b) AS to_stream, avg(value) AS avg_correlation FROM c WHERE type_a <> type_b
       GROUP BY 1, 2) SELECT *, CASE WHEN abs(avg_correlation) > 0.5 THEN 'high' WHEN abs(avg_correlation) > 0.3 THEN
       'moderate' ELSE 'low' END AS significance FROM g""")
def _(t):
    return A.cross_stream_correlation(A.feature_correlation(t.table("lineitem"), CORR_COLS))


@query("a28_aggregate_features", uses="trades", doubles="price_avg quantity_avg", sql="""SELECT symbol, exchange,
       time_bucket(INTERVAL '1 hour', ts) AS bucket, avg(price) AS price_avg, min(price) AS price_min, max(price) AS
       price_max, arg_max(price, ts) AS price_last, avg(quantity) AS quantity_avg, min(quantity) AS quantity_min,
       max(quantity) AS quantity_max, arg_max(quantity, ts) AS quantity_last, count(*) AS samples FROM trades GROUP BY 1, 2, 3""")
def _(t):
    return A.aggregate_features(t.trades, "1 hour", ["price", "quantity"])


@query("a29_resample", uses="hourly", doubles="value", sql="""SELECT series, time_bucket(INTERVAL '1 day', ts) AS ts,
       sum(value) AS value FROM hourly GROUP BY 1, 2""")
def _(t):
    return A.resample(t.hourly, "1 day", "sum")


OPTIONS = """SELECT 'BTC-' || CAST(l_shipdate AS DATE) || '-' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_linestatus = 'O'
       THEN '-C' ELSE '-P' END AS instrument_name, l_returnflag AS currency, l_quantity AS open_interest,
       l_extendedprice AS volume FROM lineitem"""


def options(t):
    return t.table("lineitem").select(
        F.concat(F.lit("BTC-"), C("l_shipdate").cast("date").cast("string"), F.lit("-"), C("l_suppkey").cast("string"),
                 F.when(C("l_linestatus") == "O", "-C").otherwise("-P")).alias("instrument_name"),
        C("l_returnflag").alias("currency"), C("l_quantity").alias("open_interest"), C("l_extendedprice").alias("volume"))


@query("a30_options_summary", doubles="total_volume put_call_ratio total_open_interest_usd", sql=f"""WITH o AS ({OPTIONS})
       SELECT *, total_open_interest * index_price AS total_open_interest_usd, puts_open_interest / calls_open_interest
       AS put_call_ratio FROM (SELECT currency, count(*) AS total_options, count(*) FILTER (instrument_name LIKE '%-C')
       AS calls_count, count(*) FILTER (instrument_name LIKE '%-P') AS puts_count, sum(open_interest) AS
       total_open_interest, 50000e0 AS index_price, sum(CASE WHEN instrument_name LIKE '%-C' THEN open_interest ELSE 0 END)
       AS calls_open_interest, sum(CASE WHEN instrument_name LIKE '%-P' THEN open_interest ELSE 0 END) AS
       puts_open_interest, sum(volume) AS total_volume FROM o GROUP BY 1)""", digits=3)
def _(t):
    return A.options_summary(options(t).withColumn("index_price", F.lit(50000.0)))


@query("a31_options_chain", sql=f"""WITH o AS ({OPTIONS}) SELECT expiry, strike, max(instrument_name) FILTER
       (instrument_name LIKE '%-C') AS call, max(instrument_name) FILTER (instrument_name LIKE '%-P') AS put FROM (SELECT
       instrument_name, split_part(instrument_name, '-', 2) AS expiry, CAST(split_part(instrument_name, '-', 3) AS DOUBLE)
       AS strike FROM o) GROUP BY 1, 2""")
def _(t):
    return A.options_chain(options(t))


@query("a32_exchange_share", uses="trades", doubles="total share", sql="""SELECT symbol, exchange, total, total / sum(total) OVER
       (PARTITION BY symbol) AS share FROM (SELECT symbol, exchange, sum(quote_value) AS total FROM trades GROUP BY 1, 2)""")
def _(t):
    return A.exchange_share(t.trades, "quote_value")


@query("a33_volume_analysis", uses="trades", doubles="total_value buy_sell_ratio avg_trade_size volume_imbalance", sql="""WITH c AS (
       SELECT symbol, list_sort(list(quantity), 'DESC')[CAST(count(*) // 10 AS INTEGER) + 1] AS th FROM trades GROUP BY 1), s AS
       (SELECT symbol, sum(quantity) AS total_volume, sum(quantity * price) AS total_value, count(*) AS total_trades,
       sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0
       END) AS sell_volume, count(*) FILTER (side = 'buy') AS buy_count, count(*) FILTER (side = 'sell') AS sell_count,
       count(*) FILTER (quantity >= th) AS large_trade_count, sum(CASE WHEN quantity >= th THEN quantity ELSE 0 END) AS
       large_trade_volume FROM trades JOIN c USING (symbol) GROUP BY 1) SELECT *, buy_volume / sell_volume AS buy_sell_ratio,
       total_volume / total_trades AS avg_trade_size, (buy_volume - sell_volume) / total_volume * 100 AS volume_imbalance
       FROM s""")
def _(t):
    return A.volume_analysis(t.trades)


@query("a34_oi_totals", uses="oi", doubles="total_oi avg_price", sql="""SELECT symbol, bucket, sum(v) AS total_oi, avg(p) AS avg_price,
       count(*) AS venues FROM (SELECT symbol, exchange, time_bucket(INTERVAL '1 hour', ts) AS bucket,
       arg_max(open_interest, ts) AS v, arg_max(price, ts) AS p FROM oi GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return A.oi_totals(t.oi, "1 hour")


@query("u1_union_streams", uses="trades liquidations", sql="""SELECT 'trades' AS source, symbol, ts, price, trade_id, NULL AS
       value_usd FROM trades UNION ALL SELECT 'liquidations', symbol, ts, price, NULL, value_usd FROM liquidations""")
def _(t):
    return U.union_streams({"trades": t.trades.select("symbol", "ts", "price", "trade_id"),
                            "liquidations": t.liquidations.select("symbol", "ts", "price", "value_usd")})


@query("u2_distinct_values", sql="SELECT DISTINCT l_shipdate FROM lineitem")
def _(t):
    return U.distinct_values(t.table("lineitem"), "l_shipdate")


@query("u3_dup_ts", sql="""SELECT o_orderpriority, count(*) - count(DISTINCT o_orderdate) AS duplicates FROM orders GROUP BY 1""")
def _(t):
    return U.dup_ts(t.table("orders"), ["o_orderpriority"], "o_orderdate")


@query("u4_dedupe", sql="SELECT l_orderkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(t):
    one = U.dedupe(t.table("lineitem").select("l_orderkey"), ["l_orderkey"])
    return one.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("u5_level_overlap", uses="books", doubles="persistence", sql="""WITH p AS (SELECT vec_id, [x.price for x in bids] AS b,
       [x.price for x in asks] AS a, lag([x.price for x in bids]) OVER w AS pb, lag([x.price for x in asks]) OVER w AS pa
       FROM books WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT vec_id, CASE WHEN pb IS NOT NULL THEN
       CAST(len(list_intersect(b, pb)) AS INTEGER) END AS bids_kept, CASE WHEN pb IS NOT NULL THEN
       CAST(len(list_intersect(a, pa)) AS INTEGER) END AS asks_kept, CASE WHEN pb IS NULL THEN 1 ELSE
       (len(list_intersect(b, pb)) + len(list_intersect(a, pa))) / (len(pb) + len(pa)) END AS persistence FROM p""")
def _(t):
    return U.level_overlap(t.books, ["symbol"], ["ts"]).select("vec_id", "bids_kept", "asks_kept", "persistence")
