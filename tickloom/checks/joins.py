"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.operators import joins as J

C = F.col


@query("j1_oi_price_join", uses="oi prices", doubles="avg_oi avg_price", sql="""
       SELECT o.symbol, o.exchange, date_trunc('minute', o.ts) AS minute, count(*) AS pairs,
       avg(o.open_interest) AS avg_oi, avg(p.mid_price) AS avg_price FROM oi o JOIN prices p ON o.symbol = p.symbol
       AND o.exchange = p.exchange AND date_trunc('minute', o.ts) = date_trunc('minute', p.ts) GROUP BY 1, 2, 3""")
def _(t):
    return J.oi_price_join(t.oi, t.prices).drop("n_oi", "n_price")


@query("j2_compare_spot_futures", doubles="premium premium_pct", sql="""WITH s AS (SELECT o_orderpriority AS symbol,
       o_orderdate AS ts, o_orderstatus AS m, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1, 2, 3)
       SELECT a.symbol, a.ts, a.p AS spot_price, b.p AS futures_price, b.p - a.p AS premium,
       (b.p - a.p) / a.p * 100 AS premium_pct FROM s a JOIN s b ON a.symbol = b.symbol AND a.ts = b.ts
       AND a.m = 'O' AND b.m = 'F'""")
def _(t):
    df = t.table("orders").select(C("o_orderpriority").alias("symbol"), C("o_orderdate").alias("ts"),
                                  "o_orderstatus", "o_totalprice", "o_orderkey")
    return J.compare_spot_futures(df, "o_orderstatus", "O", "F", ["symbol", "ts"], "o_totalprice", "o_orderkey")


LATEST = """latest AS (SELECT symbol, exchange, arg_max(mid_price, ts) AS price FROM prices GROUP BY 1, 2)"""


def latest_price(t):
    return t.prices.groupBy("symbol", "exchange").agg(F.max_by("mid_price", "ts").alias("price"))


@query("j3_spread_matrix", uses="prices", doubles="spread_pct", sql=f"""WITH {LATEST} SELECT a.symbol,
       a.exchange AS exchange_a, a.price AS price_a, b.exchange AS exchange_b, b.price AS price_b,
       (b.price - a.price) / a.price * 100 AS spread_pct FROM latest a JOIN latest b ON a.symbol = b.symbol
       AND a.exchange <> b.exchange""")
def _(t):
    return J.spread_matrix(latest_price(t))


@query("j4_pairwise", uses="funding", doubles="funding_rate_a funding_rate_b diff", digits=8, sql="""WITH latest AS (
       SELECT symbol, exchange, arg_max(funding_rate, ts) AS r FROM funding GROUP BY 1, 2) SELECT a.symbol,
       a.exchange AS exchange_a, a.r AS funding_rate_a, b.exchange AS exchange_b, b.r AS funding_rate_b,
       b.r - a.r AS diff FROM latest a JOIN latest b ON a.symbol = b.symbol AND a.exchange < b.exchange""")
def _(t):
    return J.pairwise(t.funding.groupBy("symbol", "exchange").agg(F.max_by("funding_rate", "ts").alias("funding_rate")))


@query("j5_asof_join", uses="trades prices", doubles="bid_price", sql="""SELECT t.trade_id, t.symbol, t.ts,
       p.ts AS right_ts, p.bid_price FROM trades t ASOF LEFT JOIN
       (SELECT symbol, ts + INTERVAL 90 SECOND AS ts, bid_price FROM prices) p
       ON t.symbol = p.symbol AND t.ts >= p.ts""")
def _(t):
    right = t.prices.select("symbol", (C("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"), "bid_price")
    return J.asof_join(t.trades.select("symbol", "ts", "trade_id"), right, "symbol")


@query("j6_feature_cache", uses="ev", doubles="p q r", sql="""SELECT event_id, symbol,
       last_value(CASE WHEN exchange IN ('click', 'view') THEN value END IGNORE NULLS) OVER w AS p,
       last_value(CASE WHEN exchange IN ('error', 'signup') THEN value END IGNORE NULLS) OVER w AS q,
       last_value(CASE WHEN exchange = 'purchase' THEN value * k END IGNORE NULLS) OVER w AS r FROM ev
       WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    cut = lambda *x: t.ev.where(C("exchange").isin(*x)).select("symbol", "ts", "event_id", "value", "k")
    out = J.feature_cache({"prices": cut("click", "view"), "trades": cut("error", "signup"), "oi": cut("purchase")},
                          by=("symbol",))
    return out.select("event_id", "symbol", C("prices.value").alias("p"), C("trades.value").alias("q"),
                      (C("oi.value") * C("oi.k")).alias("r"))


@query("j7_match_forecasts", uses="ev", doubles="predicted actual", sql="""SELECT p.event_id, p.exchange, p.value AS predicted,
       arg_max(a.value, a.ts) AS actual FROM ev p JOIN ev a ON p.exchange = a.exchange AND
       a.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR GROUP BY 1, 2, 3""")
def _(t):
    pred = t.ev.select("exchange", "event_id", C("value").alias("predicted"),
                       (C("ts") + F.expr("INTERVAL 1 HOUR")).alias("target_ts"))
    return (J.match_forecasts(pred, t.ev.select("exchange", "ts", "value"), ["exchange"])
            .select("event_id", "exchange", "predicted", "actual"))


@query("j8_match_levels", uses="books", doubles="qty prev_qty", sql="""WITH p AS (SELECT *, lag(bids) OVER (
       PARTITION BY symbol ORDER BY ts) AS prev FROM books), m AS (SELECT vec_id, b.qty AS qty,
       [y for y in prev if abs(y.price - b.price) < 0.01] AS hits FROM (SELECT vec_id, prev, unnest(bids) AS b FROM p))
       SELECT vec_id, count(*) AS matched, sum(qty) AS qty, sum(hits[1].qty) AS prev_qty FROM m
       WHERE len(hits) > 0 GROUP BY 1""")
def _(t):
    m = J.match_levels(t.books, ["symbol"], ["ts"])
    return (m.where(F.size("matched") > 0)
            .select("vec_id", F.size("matched").cast("long").alias("matched"),
                    F.aggregate("matched", F.lit(0.0), lambda a, x: a + x["qty"]).alias("qty"),
                    F.aggregate("matched", F.lit(0.0), lambda a, x: a + x["prev_qty"]).alias("prev_qty")))


@query("j9_align_positional", uses="hourly ev", doubles="a b", sql="""WITH x AS (SELECT series, value, row_number()
       OVER (PARTITION BY series ORDER BY ts) AS pos FROM hourly), y AS (SELECT exchange AS series, value,
       row_number() OVER (PARTITION BY exchange ORDER BY ts) AS pos FROM ev)
       SELECT x.series, x.pos, x.value AS a, y.value AS b FROM x JOIN y ON x.series = y.series AND x.pos = y.pos""")
def _(t):
    b = t.ev.select(C("exchange").alias("series"), "ts", "value")
    return J.align_positional(t.hourly, b, ["series"], ["ts"])


def returns_grid(t):
    """Hourly last price per (symbol, exchange) as a return with a dense bucket index."""
    from tickloom.operators.series import bounded, plan_series
    g = (t.ev.groupBy("symbol", "exchange", F.window("ts", "6 hours").start.alias("ts"))
         .agg(F.max_by("value", "ts").alias("price")))
    plan = plan_series(g, ["symbol", "exchange"], ["ts"], depth=1)
    return bounded(g, plan, 1, lambda d, p: d.withColumn(
        "ret", C("price") / F.lag("price").over(p.window()) - 1)).where("ret IS NOT NULL").withColumn(
        "idx", (F.unix_seconds(C("ts").cast("timestamp")) / 21600).cast("long"))


RETURNS = """g AS (SELECT symbol, exchange, time_bucket(INTERVAL '6 hours', ts) AS ts, arg_max(value, ts) AS price
       FROM ev GROUP BY 1, 2, 3), r AS (SELECT symbol, exchange, price / lag(price) OVER (PARTITION BY symbol, exchange
       ORDER BY ts) - 1 AS ret, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS idx FROM g)"""


@query("j10_lag_pairs", uses="ev", doubles="corr", sql=f"""WITH {RETURNS} SELECT a.symbol, a.exchange AS leader,
       b.exchange AS follower, CAST(l.lag AS INTEGER) AS lag, corr(a.ret, b.ret) AS corr, count(*) AS n
       FROM r a CROSS JOIN (SELECT unnest(range(5)) AS lag) l JOIN r b ON a.symbol = b.symbol
       AND b.idx = a.idx - l.lag AND a.exchange <> b.exchange WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL
       GROUP BY 1, 2, 3, 4""")
def _(t):
    return J.lag_pairs(returns_grid(t))


@query("j11_missing_streams", sql="""SELECT DISTINCT c_nationkey, c_mktsegment FROM customer c WHERE NOT EXISTS
       (SELECT 1 FROM customer x WHERE x.c_nationkey = c.c_nationkey AND x.c_mktsegment = c.c_mktsegment
       AND x.c_acctbal > 8000)""")
def _(t):
    c = t.table("customer")
    return J.missing_streams(c, c.where("c_acctbal > 8000"), ["c_nationkey", "c_mktsegment"])


@query("j12_supported_only", sql="""SELECT c_custkey FROM customer WHERE c_nationkey IN
       (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def _(t):
    dim = t.table("nation").where("n_regionkey = 2").select(C("n_nationkey").alias("c_nationkey"))
    return J.supported_only(t.table("customer"), dim, ["c_nationkey"]).select("c_custkey")


@query("j13_with_signal_meta", sql="""SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation
       ON c_nationkey = n_nationkey""")
def _(t):
    meta = t.table("nation").withColumnRenamed("n_nationkey", "signal")
    return J.with_signal_meta(t.table("customer").select("c_custkey", C("c_nationkey").alias("signal")), meta).select(
        "c_custkey", "n_name", "n_regionkey")


@query("j14_pair_series", uses="hourly", sql="""WITH h AS (SELECT series, value, row_number() OVER (PARTITION BY series
       ORDER BY ts) AS i FROM hourly) SELECT a.series, max(b.i) AS n, count(*) FILTER (b.value > a.value) AS rising,
       count(*) FILTER (b.value < a.value) AS falling, count(*) FILTER (b.value = a.value) AS tied
       FROM h a JOIN h b ON a.series = b.series AND a.i < b.i GROUP BY 1""")
def _(t):
    return J.pair_series(t.hourly, ["series"])
