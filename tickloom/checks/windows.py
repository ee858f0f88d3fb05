"""Window functions (W), top-k (T) and data-quality jobs (Q)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickloom.checks.joins import LATEST, latest_price
from tickloom.checks.registry import query
from tickloom.operators import joins as J
from tickloom.operators import quality as Q
from tickloom.operators import windows as W
from tickloom.sources.schemas import raw_schemas

C = F.col
SE = ["symbol", "exchange"]
ORD = ["ts", "event_id"]
OVER = "PARTITION BY symbol, exchange ORDER BY ts, event_id"


@query("w1_lag_change", uses="oi", doubles="change change_pct", sql=f"""SELECT event_id, lag(open_interest) OVER w AS prev,
       open_interest - lag(open_interest) OVER w AS change, (open_interest - lag(open_interest) OVER w) /
       nullif(lag(open_interest) OVER w, 0) * 100 AS change_pct FROM oi WINDOW w AS ({OVER})""")
def _(t):
    return W.lag_change(t.oi, SE, ORD, "open_interest").select("event_id", "prev", "change", "change_pct")


@query("w2_running_sum", uses="trades", doubles="cvd", sql="""SELECT trade_id, sum(CASE WHEN side = 'buy' THEN quantity
       ELSE -quantity END) OVER (PARTITION BY symbol, exchange ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS cvd
       FROM trades""")
def _(t):
    df = t.trades.withColumn("delta", F.when(C("side") == "buy", C("quantity")).otherwise(-C("quantity")))
    return W.running_sum(df, SE, ["ts", "trade_id"], "delta", "cvd").select("trade_id", "cvd")


@query("w3_rolling", uses="prices", doubles="rolling_mean rolling_std", sql=f"""SELECT event_id,
       CASE WHEN count(*) OVER w >= 20 THEN avg(mid_price) OVER w END AS rolling_mean,
       CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(mid_price) OVER w END AS rolling_std FROM prices
       WINDOW w AS ({OVER} ROWS 19 PRECEDING)""")
def _(t):
    return W.rolling_mean_std(t.prices, SE, ORD, "mid_price", 20).select("event_id", "rolling_mean", "rolling_std")


@query("w4_buffer_stats", uses="prices", doubles="mean std zscore velocity percentile", digits=9, sql=f"""SELECT event_id,
       avg(mid_price) OVER w AS mean, stddev_pop(mid_price) OVER w AS std, CASE WHEN stddev_pop(mid_price) OVER w < 1e-12
       THEN 0 ELSE (mid_price - avg(mid_price) OVER w) / stddev_pop(mid_price) OVER w END AS zscore,
       coalesce((mid_price - lag(mid_price, 4) OVER (w0)) / 5, 0) AS velocity,
       len(list_filter(list(mid_price) OVER w, lambda v: v < mid_price)) / count(*) OVER w * 100 AS percentile FROM prices
       WINDOW w AS ({OVER} ROWS 99 PRECEDING), w0 AS ({OVER})""")
def _(t):
    return W.buffer_stats(t.prices, SE, ORD, "mid_price").select("event_id", "mean", "std", "zscore", "velocity", "percentile")


@query("w5_ewma", uses="hourly", doubles="ema", sql="""SELECT series, ts, list_reduce(list(value) OVER (PARTITION BY series
       ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, x: x * (2.0e0 / 13) + a * (11.0e0 / 13)) AS ema FROM hourly""")
def _(t):
    return W.ewma(t.hourly, ["series"], ["ts"], {"ema": ("value", 12)}).select("series", "ts", "ema")


@query("w6_time_sums", uses="trades", doubles="n_1h n_6h value_1h value_6h", digits=5, sql="""SELECT trade_id,
       CAST(count(*) OVER a AS DOUBLE) AS n_1h, CAST(count(*) OVER b AS DOUBLE) AS n_6h, sum(quote_value) OVER a AS value_1h,
       sum(quote_value) OVER b AS value_6h FROM trades WINDOW
       a AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    return W.time_sums(t.trades, ["symbol"], "ts", "trade_id", {"n": F.lit(1), "value": "quote_value"},
                       {"1h": 3600, "6h": 21600}).select("trade_id", "n_1h", "n_6h", "value_1h", "value_6h")


@query("w7_latest_per", uses="prices", sql="""SELECT symbol, exchange, arg_max(event_id, ts) AS event_id, max(ts) AS ts,
       arg_max(mid_price, ts) AS mid_price FROM prices GROUP BY 1, 2""")
def _(t):
    return W.latest_per(t.prices.select("symbol", "exchange", "event_id", "ts", "mid_price"), SE)


@query("w7_latest_per_equal_times", uses="prices", sql="""WITH h AS (SELECT *, date_trunc('day', ts) AS h FROM prices) SELECT symbol, exchange, last(event_id ORDER BY h, event_id) AS event_id,
       last(mid_price ORDER BY h, event_id) AS mid_price FROM h GROUP BY 1, 2""")
def _(t):
    p = t.prices.withColumn("ts", F.date_trunc("day", "ts")).select("symbol", "exchange", "event_id", "ts", "mid_price")
    return W.latest_per(p, SE, tie="event_id").drop("ts")


@query("w8_detect_gaps", uses="prices", doubles="duration_seconds", sql="""SELECT symbol, exchange, p AS gap_start, ts AS gap_end,
       epoch(ts - p) AS duration_seconds FROM (SELECT symbol, exchange, ts, lag(ts) OVER (PARTITION BY symbol, exchange
       ORDER BY ts) AS p FROM prices) WHERE epoch(ts - p) > 2 * 3600""")
def _(t):
    return W.detect_gaps(t.prices, SE, expected_s=3600)


CASCADE_SQL = """f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) >
       1800000000 THEN 1 ELSE 0 END AS new FROM liquidations), i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts
       ROWS UNBOUNDED PRECEDING) AS island FROM f), c AS (SELECT symbol, min(ts) AS start_time, max(ts) AS end_time,
       epoch(max(ts) - min(ts)) AS duration_seconds, count(*) AS liquidation_count, sum(value_usd) AS total_value,
       sum(CASE WHEN side = 'long' THEN value_usd ELSE 0 END) AS long_value, sum(CASE WHEN side = 'short' THEN value_usd
       ELSE 0 END) AS short_value, arg_min(price, ts) AS price_start, arg_max(price, ts) AS price_end, min(price) AS price_low,
       max(price) AS price_high FROM i GROUP BY symbol, island HAVING count(*) >= 3)"""


@query("w9_cascades", uses="liquidations", doubles="duration_seconds total_value long_value short_value intensity", sql=f"""
       WITH {CASCADE_SQL} SELECT *, CASE WHEN long_value > short_value THEN 'LONG' ELSE 'SHORT' END AS dominant_side,
       total_value / greatest(duration_seconds, 1) AS intensity FROM c""")
def _(t):
    return W.cascades(t.liquidations, ["symbol"], minutes=30)


@query("w10_streak_stats", uses="trades", doubles="avg_streak flow_toxicity", sql="""WITH f AS (SELECT *, CASE WHEN lag(side)
       OVER w <> side THEN 1 ELSE 0 END AS flip, row_number() OVER w AS rn FROM trades WINDOW w AS (PARTITION BY symbol
       ORDER BY ts)), a AS (SELECT trade_id, CASE WHEN rn >= 20 THEN 20 / (sum(flip) OVER (PARTITION BY symbol ORDER BY ts
       ROWS 18 PRECEDING) + 1) END AS avg_streak FROM f) SELECT *, coalesce(least(1, avg_streak / 5), 0) AS flow_toxicity
       FROM a""")
def _(t):
    return W.streak_stats(t.trades, ["symbol"], ["ts"]).select("trade_id", "avg_streak", "flow_toxicity")


REGIME = "CASE WHEN value > 60 THEN 'HIGH' WHEN value > 40 THEN 'NORMAL' ELSE 'LOW' END"
RUNS_SQL = f"""l AS (SELECT *, {REGIME} AS regime FROM hourly), f AS (SELECT *, CASE WHEN lag(regime) OVER w <> regime
       THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY series ORDER BY ts)), i AS (SELECT *, sum(new) OVER
       (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f), r AS (SELECT series, island, regime,
       count(*) AS length, min(ts) AS start, max(ts) AS "end" FROM i GROUP BY 1, 2, 3)"""


def labelled(t):
    return t.hourly.withColumn("regime", F.expr(REGIME))


@query("w11_regime_runs", uses="hourly", doubles="avg_duration distribution_pct", sql=f"""WITH {RUNS_SQL}, p AS (SELECT series,
       regime, CAST(sum(length) AS BIGINT) AS rows, count(*) AS run_count, avg(length) AS avg_duration FROM r GROUP BY 1, 2)
       SELECT *, rows / sum(rows) OVER (PARTITION BY series) * 100 AS distribution_pct FROM p""")
def _(t):
    return W.regime_runs(labelled(t), ["series"], ["ts"], "regime")


@query("w11_transitions", uses="hourly", sql=f"""WITH {RUNS_SQL}, p AS (SELECT series, regime, lag(regime) OVER (PARTITION BY
       series ORDER BY ts) AS f FROM l) SELECT series, f AS from_label, regime AS to_label, count(*) AS n FROM p
       WHERE f <> regime GROUP BY 1, 2, 3""")
def _(t):
    return W.transitions(labelled(t), ["series"], ["ts"], "regime")


@query("w12_arb_windows", uses="hourly", doubles="avg_spread_pct", sql="""WITH s AS (SELECT ts, (max(value) - min(value)) /
       min(value) AS max_spread, 'all' AS symbol FROM hourly GROUP BY 1), f AS (SELECT *, max_spread > 1.5 AS on_,
       CASE WHEN lag(max_spread > 1.5) OVER (ORDER BY ts) <> (max_spread > 1.5) THEN 1 ELSE 0 END AS new FROM s), i AS
       (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT symbol, count(*) AS
       duration_samples, avg(max_spread) AS avg_spread_pct, min(ts) AS start, max(ts) AS "end" FROM i
       WHERE on_ AND island < (SELECT max(island) FROM i) GROUP BY symbol, island""")
def _(t):
    s = (t.hourly.groupBy("ts").agg(((F.max("value") - F.min("value")) / F.min("value")).alias("max_spread"))
         .withColumn("symbol", F.lit("all")))
    return W.arb_windows(s, ["symbol"], ["ts"], threshold=1.5)


@query("w13_final_pct_rank", uses="prices", doubles="pct_rank", sql="""WITH n AS (SELECT symbol, exchange, arg_max(mid_price, ts)
       AS current FROM prices GROUP BY 1, 2) SELECT symbol, exchange, current, count(*) FILTER (mid_price < current) /
       count(*) * 100 AS pct_rank FROM prices JOIN n USING (symbol, exchange) GROUP BY 1, 2, 3""")
def _(t):
    return W.final_pct_rank(t.prices, SE, "ts", "mid_price")


@query("w13_expanding_pct_rank", uses="prices", doubles="pct_rank", sql="""SELECT event_id, mid_price, len(list_filter(list(mid_price) OVER w, lambda v: v < mid_price)) / count(*) OVER w * 100 AS pct_rank
       FROM prices WINDOW w AS (PARTITION BY symbol, exchange ORDER BY ts, event_id)""")
def _(t):
    return W.expanding_pct_rank(t.prices, SE, ["ts", "event_id"], "mid_price").select("event_id", "mid_price", "pct_rank")


@query("w14_rolling_vol", uses="hourly", doubles="volatility", sql="""WITH r AS (SELECT series, ts, value / lag(value) OVER w - 1
       AS ret, row_number() OVER w AS rn FROM hourly WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, ts,
       CASE WHEN rn > 24 THEN stddev_samp(ret) OVER (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING) * sqrt(525600) END AS
       volatility FROM r""")
def _(t):
    return W.rolling_vol(t.hourly, ["series"], ["ts"], "value", 24).select("series", "ts", "volatility")


@query("w15_rsi", uses="bars", doubles="rsi", sql="""WITH c AS (SELECT symbol, open_time, close - lag(close) OVER (PARTITION BY
       symbol ORDER BY open_time) AS ch FROM bars), g AS (SELECT symbol, open_time, avg(CASE WHEN ch > 0 THEN ch WHEN ch IS
       NOT NULL THEN 0 END) OVER w AS gain, avg(CASE WHEN ch < 0 THEN -ch WHEN ch IS NOT NULL THEN 0 END) OVER w AS loss
       FROM c WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 14 PRECEDING)) SELECT symbol, open_time,
       CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi FROM g""")
def _(t):
    return W.rsi(t.bars, ["symbol"], ["open_time"]).select("symbol", "open_time", "rsi")


@query("w16_rank_exchanges", uses="trades", doubles="score", sql="""SELECT symbol, exchange, sum(quote_value) AS score,
       CAST(row_number() OVER (PARTITION BY symbol ORDER BY sum(quote_value) DESC, exchange) AS INTEGER) AS rank FROM trades
       GROUP BY 1, 2""")
def _(t):
    return W.rank_exchanges(t.trades.groupBy("symbol", "exchange").agg(F.sum("quote_value").alias("score")))


@query("t1_latest_n", uses="prices", sql="SELECT event_id, ts, mid_price FROM prices ORDER BY ts DESC LIMIT 100")
def _(t):
    return W.latest_n(t.prices, 100).select("event_id", "ts", "mid_price")


@query("t2_latest_n_per", uses="prices", sql=f"""SELECT event_id, symbol, exchange, CAST(row_number() OVER (PARTITION BY symbol,
       exchange ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM prices QUALIFY rn <= 5""")
def _(t):
    return W.latest_n_per(t.prices, SE, 5, ORD).select("event_id", "symbol", "exchange", "rn")


@query("t3_top_arbitrage", uses="prices", doubles="spread_pct", sql=f"""WITH {LATEST} SELECT a.symbol, a.exchange AS exchange_a,
       a.price AS price_a, b.exchange AS exchange_b, b.price AS price_b, (b.price - a.price) / a.price * 100 AS spread_pct
       FROM latest a JOIN latest b ON a.symbol = b.symbol AND a.exchange <> b.exchange WHERE (b.price - a.price) / a.price
       * 100 >= 0.1 ORDER BY spread_pct DESC LIMIT 20""")
def _(t):
    return W.top_arbitrage(J.spread_matrix(latest_price(t)))


@query("t4_top_movers", doubles="change_pct volume", sql="""WITH c AS (SELECT l_suppkey AS symbol, (arg_max(l_extendedprice,
       l_orderkey * 10 + l_linenumber) / arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) - 1) * 100 AS change_pct,
       sum(l_quantity) AS volume FROM lineitem GROUP BY 1) SELECT * FROM (SELECT *, 'gainers' AS list FROM c
       ORDER BY change_pct DESC, symbol LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'losers' FROM c ORDER BY change_pct, symbol
       LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'volume' FROM c ORDER BY volume DESC, symbol LIMIT 10)""")
def _(t):
    o = C("l_orderkey") * 10 + C("l_linenumber")
    c = t.table("lineitem").groupBy(C("l_suppkey").alias("symbol")).agg(
        ((F.max_by("l_extendedprice", o) / F.min_by("l_extendedprice", o) - 1) * 100).alias("change_pct"),
        F.sum("l_quantity").alias("volume"))
    return W.top_movers(c)


@query("t5_top_walls", uses="books", doubles="w1 w3 p1", sql="""SELECT vec_id, list_sort([x.qty for x in bids], 'DESC')[1] AS w1,
       list_sort([x.qty for x in bids], 'DESC')[3] AS w3, [x.price for x in bids if x.qty = list_max([y.qty for y in bids])][1]
       AS p1 FROM books""")
def _(t):
    w = W.top_walls(C("bids"))
    return t.books.select("vec_id", w[0]["qty"].alias("w1"), w[2]["qty"].alias("w3"), w[0]["price"].alias("p1"))


@query("t6_large_trades", uses="trades", sql="""WITH c AS (SELECT symbol, list_sort(list(quote_value))[CAST(floor(count(*) * 95 /
       100) AS INTEGER) + 1] AS threshold FROM trades GROUP BY 1) SELECT trade_id, symbol, quote_value, threshold FROM trades
       JOIN c USING (symbol) WHERE quote_value >= threshold""")
def _(t):
    return W.large_trades(t.trades, ["symbol"], "quote_value").select("trade_id", "symbol", "quote_value", "threshold")


@query("t6_large_trades_mean", uses="trades", doubles="threshold", sql="""WITH c AS (SELECT symbol, avg(quote_value) * 5 AS
       threshold FROM trades GROUP BY 1) SELECT trade_id, symbol, quote_value, threshold FROM trades JOIN c USING (symbol)
       WHERE quote_value >= threshold""")
def _(t):
    return W.large_trades(t.trades, ["symbol"], "quote_value", times_mean=5).select(
        "trade_id", "symbol", "quote_value", "threshold")


@query("t7_arbitrage_summary", uses="prices", doubles="avg_profit_pct best_profit_pct spread_pct", sql=f"""WITH {LATEST}, o AS (
       SELECT a.symbol, a.exchange AS b, b.exchange AS s, (b.price - a.price) / a.price * 100 AS p FROM latest a JOIN latest b
       ON a.symbol = b.symbol AND a.exchange <> b.exchange AND b.price > a.price), r AS (SELECT symbol, b || ' → ' || s AS k,
       count(*) AS n FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, k) = 1), bb AS
       (SELECT symbol, b AS k, count(*) AS n FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n
       DESC, k) = 1), ss AS (SELECT symbol, s AS k, count(*) AS n FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY
       symbol ORDER BY n DESC, k) = 1), x AS (SELECT symbol, min(price) AS min_price, max(price) AS max_price FROM latest GROUP
       BY 1), z AS (SELECT symbol, count(*) AS opportunities, avg(p) AS avg_profit_pct, max(p) AS best_profit_pct FROM o GROUP
       BY 1) SELECT x.*, opportunities, avg_profit_pct, best_profit_pct, r.k AS top_route, bb.k AS cheapest_exchange, ss.k AS
       dearest_exchange, (max_price - min_price) / min_price * 100 AS spread_pct, CASE WHEN (max_price - min_price) / min_price
       * 100 < 0.01 THEN 'HIGHLY_EFFICIENT' WHEN (max_price - min_price) / min_price * 100 < 0.05 THEN 'EFFICIENT' WHEN
       (max_price - min_price) / min_price * 100 < 0.15 THEN 'MODERATE_INEFFICIENCY' ELSE 'INEFFICIENT' END AS market_status
       FROM x JOIN z USING (symbol) JOIN r USING (symbol) JOIN bb USING (symbol) JOIN ss USING (symbol)""")
def _(t):
    latest = latest_price(t)
    opps = J.spread_matrix(latest).where("spread_pct > 0").select(
        "symbol", C("exchange_a").alias("buy_exchange"), C("exchange_b").alias("sell_exchange"),
        C("spread_pct").alias("profit_pct"))
    return W.arbitrage_summary(opps, latest)


VENUE_SQL = """v AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket, exchange, arg_max(mid_price, ts) AS price
       FROM prices GROUP BY 1, 2, 3), m AS (SELECT *, CAST(count(*) OVER w AS INTEGER) AS venues, list_sort(list(price) OVER w)
       [CAST(count(*) OVER w // 2 AS INTEGER) + 1] AS median FROM v WINDOW w AS (PARTITION BY symbol, bucket)), d AS (SELECT *,
       abs((price - median) / median * 100) AS deviation_pct FROM m)"""


@query("q1_validate_prices", uses="prices", doubles="deviation_pct", sql=f"""WITH {VENUE_SQL} SELECT *,
       list_filter([CASE WHEN price <= 0 THEN 'invalid_price' END, CASE WHEN deviation_pct > 5 THEN 'price_deviation' END],
       lambda x: x IS NOT NULL) AS issues, price > 0 AND deviation_pct <= 5 AS valid FROM d""")
def _(t):
    return Q.validate_prices(t.prices)


@query("q2_validate_books", uses="books", sql="""SELECT vec_id, list_filter([CASE WHEN (asks[1].price - bids[1].price) /
       bids[1].price * 100 > 0.15 THEN 'wide_spread' END, CASE WHEN bids[1].price >= asks[1].price THEN 'crossed_book' END],
       lambda x: x IS NOT NULL) AS issues, NOT ((asks[1].price - bids[1].price) / bids[1].price * 100 > 0.15 OR
       bids[1].price >= asks[1].price) AS valid FROM (SELECT vec_id, bids, [{'price': a.price - 0.15e0 + (vec_id % 3) * 0.1e0 - 0.1e0,
       'qty': a.qty} for a in asks] AS asks FROM books)""")
def _(t):
    moved = t.books.withColumn("asks", F.transform("asks", lambda a: F.struct(
        (a["price"] - 0.15 + (C("vec_id") % 3) * 0.1 - 0.1).alias("price"), a["qty"].alias("qty"))))
    return Q.validate_books(moved, max_spread_pct=0.15).select("vec_id", "issues", "valid")


@query("q3_cross_exchange_outliers", uses="prices", doubles="deviation_pct", sql=f"""WITH {VENUE_SQL} SELECT * FROM d
       WHERE venues >= 2 AND deviation_pct > 3""")
def _(t):
    return Q.cross_exchange_outliers(t.prices)


@query("q4_validate_vs_history", uses="prices", doubles="mean std z_score deviation_pct", digits=7, sql="""WITH s AS (SELECT event_id,
       mid_price, count(*) OVER w - 1 AS samples, (sum(mid_price) OVER w - mid_price) / nullif(count(*) OVER w - 1, 0) AS mean,
       list(mid_price) OVER w AS xs FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR
       PRECEDING AND CURRENT ROW)), v AS (SELECT event_id, mid_price, samples, mean, CASE WHEN samples >= 2 THEN sqrt(
       list_sum([(x - mean) * (x - mean) for x in xs[1:len(xs) - 1]]) / (samples - 1)) END AS std FROM s), z AS (SELECT *,
       CASE WHEN mean > 0 AND std > 1e-9 THEN (mid_price - mean) / std END AS z_score, CASE WHEN mean > 0 AND std > 1e-9 THEN
       abs((mid_price - mean) / mean * 100) END AS deviation_pct FROM v) SELECT event_id, samples, mean, std, z_score,
       deviation_pct, coalesce(deviation_pct <= 5 AND abs(z_score) <= 3, mid_price > 0) AS valid FROM z""")
def _(t):
    return Q.validate_vs_history(t.prices, ["symbol"], minutes=360).select(
        "event_id", "samples", "mean", "std", "z_score", "deviation_pct", "valid")


@query("q5_point_anomaly", uses="prices", doubles="z_score", sql=f"""WITH z AS (SELECT event_id, CASE WHEN count(*) OVER w >= 10 THEN
       CASE WHEN stddev_pop(mid_price) OVER w > 1e-12 THEN (mid_price - avg(mid_price) OVER w) / stddev_pop(mid_price) OVER w
       ELSE 0 END END AS z_score FROM prices WINDOW w AS ({OVER} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT *,
       coalesce(abs(z_score) > 3, false) AS is_anomaly, CASE WHEN abs(z_score) > 4 THEN 'high' WHEN abs(z_score) > 3.5 THEN
       'medium' WHEN abs(z_score) > 3 THEN 'low' END AS severity FROM z""")
def _(t):
    return Q.point_anomaly(t.prices, SE, ORD, "mid_price").select("event_id", "z_score", "is_anomaly", "severity")


@query("q6_quarantine", uses="trades", sql="""SELECT trade_id, true AS bad, list_filter([CASE WHEN price < 1 THEN 'low_price' END,
       CASE WHEN quantity > 95 THEN 'huge_size' END], lambda x: x IS NOT NULL) AS reasons FROM trades WHERE price < 1 OR
       quantity > 95 UNION ALL SELECT trade_id, false, [] FROM trades WHERE NOT (price < 1 OR quantity > 95)""")
def _(t):
    good, bad = Q.quarantine(t.trades, {"low_price": C("price") < 1, "huge_size": C("quantity") > 95})
    return bad.select("trade_id", F.lit(True).alias("bad"), "reasons").unionByName(
        good.select("trade_id", F.lit(False).alias("bad"), F.array().cast("array<string>").alias("reasons")))


@query("q7_interpolate", doubles="value", digits=8, sql="""WITH d AS (SELECT l_suppkey, l_shipdate AS ts, avg(l_extendedprice) AS value FROM
       lineitem GROUP BY 1, 2), n AS (SELECT *, lead(ts) OVER w AS nt, lead(value) OVER w AS nv FROM d WINDOW w AS (PARTITION BY
       l_suppkey ORDER BY ts)), g AS (SELECT *, unnest(range(CAST(greatest(coalesce(date_diff('day', ts, nt), 1), 1) AS INTEGER)))
       AS k FROM n) SELECT l_suppkey, ts + to_days(CAST(k AS INTEGER)) AS ts, CASE WHEN k = 0 THEN value ELSE value + (nv - value) *
       k / date_diff('day', ts, nt) END AS value, k > 0 AS filled FROM g""")
def _(t):
    d = t.table("lineitem").groupBy("l_suppkey", C("l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("value"))
    return Q.interpolate(d, ["l_suppkey"], 86400, "linear")


@query("q8_rule_checks", uses="trades", sql="""SELECT exchange, count(*) AS row_count, count(*) - count(DISTINCT ts) AS duplicate_ts,
       count(*) FILTER (price > 0 AND quantity > 0 AND price > quantity) AS bid_above_ask, count(*) FILTER (price < 0) AS
       price_negative, count(*) FILTER (price = 0) AS price_zero, 0 AS price_nan_inf, 0 AS bad_side, count(*) AS
       note_bad_json, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future_ts FROM trades GROUP BY 1""")
def _(t):
    return Q.rule_checks(t.trades.withColumn("note", F.lit("{not json")), ["exchange"], bid="price", ask="quantity",
                         numeric=["price"], side="side", json_cols=["note"], as_of=datetime(2024, 1, 20))


@query("q8_ohlc_checks", uses="bars", sql="""SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT open_time) AS duplicate_ts,
       count(*) FILTER (volume < low / 1000 OR volume < open / 1000 OR volume < close / 1000 OR low / 1000 > open / 1000 OR
       low / 1000 > close / 1000) AS bad_ohlc FROM bars GROUP BY 1""")
def _(t):
    odd = t.bars.select("symbol", "open_time", C("volume").alias("high"), *[(C(c) / 1000).alias(c) for c in ("low", "open", "close")])
    return Q.rule_checks(odd, ["symbol"], ts="open_time", ohlc=True)


@query("q9_schema_check", sql="""SELECT c.*, (SELECT count(*) FROM events) AS row_count FROM (VALUES
       ('symbol', 'missing', 'string', NULL), ('exchange', 'missing', 'string', NULL), ('market_type', 'missing', 'string', NULL),
       ('trade_id', 'type_mismatch', 'string', 'bigint'), ('quantity', 'missing', 'double', NULL), ('quote_value', 'missing',
       'double', NULL), ('side', 'missing', 'string', NULL), ('is_buyer_maker', 'missing', 'boolean', NULL)) AS
       c("column", problem, expected, found)""")
def _(t):
    df = t.table("events").select("ts", C("event_id").alias("trade_id"), C("value").alias("price"))
    return Q.schema_check(df, raw_schemas()["trades"])


@query("q10_quality_report", uses="prices", doubles="pass_rate health_score", sql=f"""WITH {VENUE_SQL}, c AS (SELECT symbol, count(*)
       AS checked, count(*) FILTER (price > 0 AND deviation_pct <= 5) AS passed, count(*) FILTER (price <= 0) AS critical,
       count(*) FILTER (deviation_pct > 5) AS medium, 0 AS low FROM d GROUP BY 1) SELECT *, passed / checked * 100 AS pass_rate,
       greatest(0, 100 - (100 - passed / checked * 100) * 0.2 - least(15, critical * 5)) AS health_score FROM c""")
def _(t):
    return Q.quality_report(Q.validate_prices(t.prices), ["symbol"])


@query("q10_issue_log", uses="prices", sql=f"""WITH {VENUE_SQL} SELECT symbol, bucket, exchange, 'price_deviation' AS issue, 'medium' AS
       severity FROM d WHERE deviation_pct > 5""")
def _(t):
    return Q.issue_log(Q.validate_prices(t.prices), ["symbol", "bucket", "exchange"])


# a firing leads to the first hit at or after the end of its cooldown
@query("q11_triggers", uses="prices", doubles="value", sql="""WITH RECURSIVE g AS (SELECT symbol, ts, epoch(ts - lag(ts) OVER (PARTITION BY symbol
       ORDER BY ts)) AS value FROM prices), h AS (SELECT *, CASE WHEN value > 60 AND value <= 300 THEN 'interpolate_missing_data'
       WHEN value > 300 THEN 'request_backfill' END AS action, CASE WHEN value > 60 AND value <= 300 THEN 60 ELSE 600 END AS cool
       FROM g WHERE value > 60), n AS (SELECT h.*, (SELECT min(x.ts) FROM h x WHERE x.symbol = h.symbol AND x.action = h.action AND x.ts >= h.ts + to_seconds(h.cool)) AS next
       FROM h), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY symbol, action ORDER BY ts) = 1 UNION ALL SELECT n.* FROM f JOIN n ON n.symbol = f.symbol AND n.action =
       f.action AND n.ts = f.next) SELECT symbol, ts, 'gap_duration_seconds' AS metric, value, action FROM f""")
def _(t):
    gaps = W.detect_gaps(t.prices, ["symbol"], expected_s=0)
    m = gaps.select("symbol", C("gap_end").alias("ts"), F.lit("gap_duration_seconds").alias("metric"),
                    C("duration_seconds").alias("value"))
    return Q.triggers(m, ["symbol"])
