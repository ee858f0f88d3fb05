"""Streaming jobs (X): each query runs a stream over the tables to its end and reads the written result.

A window closes once the watermark (newest event less ten minutes) has passed its end; the SQL keeps
the same windows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.checks.composites import FLAT, INPUTS
from tickloom.checks.registry import SQL, query
from tickloom.checks.streams import Tables
from tickloom.plans import composites as P
from tickloom.session import scratch_path
from tickloom.streaming import jobs as X
from tickloom.streaming.live import stream_signals

C = F.col
NTZ = "timestamp_ntz"


class StreamTables(Tables):
    """The same tables as streams."""

    def table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return X.stream_source(self.spark, self.folder, schema, pattern=f"{name}.parquet")


def streams(t) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def done(t, df, name, mode="append"):
    """Run to the end and read back; times go back to zone-less."""
    path = scratch_path(t.spark, name)
    X.run_once(df, path, mode)
    out = t.spark.read.schema(df.schema).parquet(path)
    return out.withColumns({f.name: C(f.name).cast(NTZ) for f in out.schema.fields if f.dataType.typeName() == "timestamp"})


MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"


@query("x1_stream_source", uses="trades", sql="SELECT trade_id, price FROM trades")
def _(t):
    return done(t, streams(t).trades.select("trade_id", "price"), "x1")


@query("x2_watermark", uses="ev", sql=f"""SELECT exchange, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n FROM ev GROUP BY 1, 2 HAVING bucket + INTERVAL 1 HOUR <= {MARK}""")
def _(t):
    d = X.with_watermark(streams(t).ev).groupBy(F.window("ts", "1 hour").alias("w"), "exchange").agg(F.count(F.lit(1)).alias("n"))
    return done(t, d.select("exchange", C("w.start").alias("bucket"), "n"), "x2")


@query("x3_stream_candles", uses="ev trades", doubles="volume", sql=f"""SELECT exchange, time_bucket(INTERVAL '4 hours', ts) AS open_time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, ts) AS close, sum(quantity) AS volume, count(*) AS trade_count FROM trades GROUP BY 1, 2 HAVING open_time + INTERVAL 4 HOUR <= {MARK}""")
def _(t):
    return done(t, X.stream_candles(X.with_watermark(streams(t).trades), "4 hours"), "x3")


@query("x3_stream_flow", uses="ev trades", doubles="buy_volume sell_volume net_flow", sql=f"""SELECT exchange, time_bucket(INTERVAL '15 minutes', ts) AS bucket, sum(CASE WHEN side = 'buy' THEN quote_value ELSE 0 END)
       AS buy_volume, sum(CASE WHEN side = 'sell' THEN quote_value ELSE 0 END) AS sell_volume, sum(CASE WHEN side = 'buy' THEN quote_value ELSE -quote_value END) AS net_flow, count(*) AS
       trade_count FROM trades GROUP BY 1, 2 HAVING bucket + INTERVAL 15 MINUTE <= {MARK}""")
def _(t):
    return done(t, X.stream_flow(X.with_watermark(streams(t).trades), "15 minutes"), "x3f")


@query("x4_stream_trade_features", uses="ev trades", doubles="volume cvd vwap", sql=f"""WITH s AS (SELECT symbol, quantity, price, side, time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(unnest(range(5)) AS INTEGER)) AS
       window_start FROM trades) SELECT symbol, window_start, window_start + INTERVAL 5 HOUR AS window_end, count(*) AS trade_count, sum(quantity) AS volume, sum(CASE WHEN side = 'buy' THEN
       quantity ELSE -quantity END) AS cvd, sum(price * quantity) / sum(quantity) AS vwap FROM s GROUP BY 1, 2 HAVING window_start + INTERVAL 5 HOUR <= {MARK}""")
def _(t):
    return done(t, X.stream_trade_features(X.with_watermark(streams(t).trades), "5 hours", "1 hour"), "x4")


@query("x5_stream_cascades", uses="ev liquidations", doubles="total_value", sql=f"""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS
       new FROM liquidations), i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT symbol, count(*) AS liquidation_count,
       sum(value_usd) AS total_value, min(ts) AS start_time, max(ts) AS end_time FROM i GROUP BY symbol, island HAVING count(*) >= 3 AND max(ts) + INTERVAL 30 MINUTE <= {MARK}""")
def _(t):
    return done(t, X.stream_cascades(X.with_watermark(streams(t).liquidations), "30 minutes"), "x5")


@query("x6_stream_buffer_features", uses="ev prices", digits=8, doubles="mean std zscore velocity percentile", sql=f"""SELECT * EXCLUDE (ts) FROM (SELECT ts, symbol, exchange, event_id, avg(mid_price) OVER w AS mean, stddev_pop(mid_price) OVER w AS std, CASE
       WHEN stddev_pop(mid_price) OVER w < 1e-12 THEN 0 ELSE (mid_price - avg(mid_price) OVER w) / stddev_pop(mid_price) OVER w END AS zscore, coalesce((mid_price - lag(mid_price, 4) OVER
       w0) / 5, 0) AS velocity, len(list_filter(list(mid_price) OVER w, lambda v: v < mid_price)) / count(*) OVER w * 100 AS percentile FROM prices WINDOW w AS (PARTITION BY symbol,
       exchange ORDER BY ts, event_id ROWS 99 PRECEDING), w0 AS (PARTITION BY symbol, exchange ORDER BY ts, event_id)) WHERE ts <= {MARK}""")
def _(t):
    """A row appears once the watermark has reached it."""
    s = X.with_watermark(streams(t).prices.select("symbol", "exchange", "ts", "event_id", "mid_price"))
    return done(t, X.stream_buffer_features(s), "x6")


@query("x7_stream_cvd", uses="ev trades", sql=f"""SELECT * EXCLUDE (ts) FROM (SELECT ts, symbol, exchange, trade_id, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol, exchange ORDER BY ts, trade_id ROWS
       UNBOUNDED PRECEDING) AS cvd FROM trades) WHERE ts <= {MARK}""")
def _(t):
    s = X.with_watermark(streams(t).trades.select("symbol", "exchange", "ts", "trade_id", "side", "quantity"))
    return done(t, X.stream_cvd(s), "x7")


@query("x8_stream_dedupe", uses="trades", sql="SELECT trade_id, price FROM trades")
def _(t):
    """Every trade arrives twice."""
    s = X.with_watermark(streams(t).trades).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return done(t, X.stream_dedupe(s, ["trade_id"]).select("trade_id", "price"), "x8")


@query("x9_stream_join", uses="prices oi", sql="""SELECT p.event_id, o.event_id AS oi_id, p.mid_price, o.open_interest FROM prices p JOIN oi o ON p.symbol = o.symbol AND p.exchange = o.exchange AND o.ts BETWEEN p.ts -
       INTERVAL 60 SECOND AND p.ts + INTERVAL 60 SECOND""")
def _(t):
    p = X.with_watermark(streams(t).prices.select("symbol", "exchange", "ts", "event_id", "mid_price"))
    o = X.with_watermark(streams(t).oi.select("symbol", "exchange", C("ts").alias("oi_ts"), C("event_id").alias("oi_id"), "open_interest"), "oi_ts")
    return done(t, X.stream_join(p, o, ["symbol", "exchange"], "ts", "oi_ts", 60), "x9").select("event_id", "oi_id", "mid_price", "open_interest")


@query("x10_stream_enrich", sql="SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    dim = t.table("nation").select(C("n_nationkey").alias("c_nationkey"), "n_name")
    return done(t, X.stream_enrich(streams(t).table("customer"), dim, ["c_nationkey"]).select("c_custkey", "n_name"), "x10")


# A key's first event brings all streams, as a subscription's snapshot does; later ones bring one stream each.
LIVE = ("f AS (SELECT event_id, symbol, exchange, ts, " + ", ".join(f"{s}.{n} AS {s}_{n}" for s, fs in INPUTS.items() for n in fs)
        + " FROM (SELECT event_id, symbol, exchange, ts, " + ", ".join(
            f"last_value(CASE WHEN first_one OR event_id % 8 = {i} THEN struct_pack({', '.join(f'{n} := {e}' for n, e in fs.items())}) END IGNORE NULLS) OVER (PARTITION BY "
            f"symbol, exchange ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS {s}" for i, (s, fs) in enumerate(INPUTS.items()))
        + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange ORDER BY ts, event_id) = 1 AS first_one FROM ev)))")
# The words each signal adds to its value and confidence.
WORDS = {"market_maker_activity": "activity_type inventory_bias", "liquidation_cascade_risk": "severity direction", "institutional_phase": "phase price_target_direction",
         "volatility_breakout": "direction timeframe_hours", "mean_reversion": "signal", "momentum_exhaustion": "exhaustion trend_direction", "smart_money_flow": "direction",
         "arbitrage_opportunity": "opportunity type risk_level", "regime_transition": "current_regime predicted_regime timeframe_hours", "execution_quality": "quality optimal_order_splits"}
FIFTEEN = [m[0] for m in P.SIGNAL_META]


def in_row_order(sql: str) -> str:
    """Sums of the momentum quality and of the last rows in the order in which Spark adds: the features lie on a grid, so some meet a limit but for the last bit."""
    sql = re.sub(r"\+\s+0\.5 \+ ((?:oi_position_intent_score|funding_funding_regime_score|orderbook_depth_imbalance_5) \* 0\.(?:25|5))", r"+ (0.5 + \1)", sql)
    return re.sub(r"avg\((mq|sm)\) OVER (\(.*?\))", r"list_avg(list(\1) OVER \2)", sql, flags=re.S)


def live_sql() -> str:
    """The SQL of the fifteen batch signals over the newest features, side by side."""
    texts = {name.split("_", 1)[1]: in_row_order(sql.replace(FLAT[5:], LIVE)) for name, sql in SQL.items() if name.startswith("c") and name[1:].split("_")[0].isdigit()}
    texts["liquidation_cascade_risk"] = texts["cascade_risk"]
    columns = ", ".join(f"{n}.{c} AS {n}_{c}" for n in FIFTEEN for c in ("value", "confidence", *WORDS.get(n, "").split()))
    joins = " ".join(f"LEFT JOIN ({texts[n]}) AS {n} ON e.event_id = {n}.event_id" for n in FIFTEEN)
    return f"SELECT e.event_id, {columns} FROM ev e {joins} WHERE e.ts <= {MARK}"


@query("x11_stream_composites", uses="ev", sql=live_sql(), doubles=" ".join(f"{n}_{c}" for n in FIFTEEN for c in ("value", "confidence")))
def _(t):
    """Eight streams and fifteen signals, live; a row appears once the watermark has reached it."""
    first = t.ev.groupBy("symbol", "exchange").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))
    e = X.stream_enrich(X.with_watermark(streams(t).ev), first, ["symbol", "exchange"])
    updates = e.select("symbol", "exchange", "ts", "event_id", *[
        F.when((C("event_id") == C("first_id")) | (C("event_id") % 8 == i), F.struct(*[F.expr(x).alias(n) for n, x in fs.items()])).alias(s)
        for i, (s, fs) in enumerate(INPUTS.items())])
    out = stream_signals(updates)
    return done(t, out.select("event_id", *[C(f"{n}.{c}").alias(f"{n}_{c}") for n in FIFTEEN for c in ("value", "confidence", *WORDS.get(n, "").split())]), "x11")


@query("x12_stream_drift")
def _(t):
    s = X.with_watermark(streams(t).ev.select("exchange", "ts", "event_id", "value"))
    return done(t, X.stream_drift(s, threshold=2000.0), "x12")


@query("x13_stream_divergence", uses="ev prices", doubles="divergence_pct", sql=f"""SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket, max(mid_price) AS high, min(mid_price) AS low, (max(mid_price) - min(mid_price)) /
       min(mid_price) * 100 AS divergence_pct FROM prices GROUP BY 1, 2 HAVING count(DISTINCT exchange) >= 2 AND divergence_pct > 0.1 AND bucket + INTERVAL 1 HOUR <= {MARK}""")
def _(t):
    return done(t, X.stream_divergence(X.with_watermark(streams(t).prices), "1 hour"), "x13")


@query("x14_stream_sink", uses="trades", sql="SELECT trade_id, symbol, price FROM trades")
def _(t):
    path, cp = scratch_path(t.spark, "x14"), scratch_path(t.spark, "x14cp")
    df = streams(t).trades.select("trade_id", "symbol", "price")
    X.stream_sink(df, path, cp, keys=["trade_id"])
    X.stream_sink(df, path, cp, keys=["trade_id"])          # a second start finds nothing new
    return t.spark.read.schema(df.schema).parquet(f"{path}/*").select("trade_id", "symbol", "price")


@query("x15_stream_health", uses="ev", sql=f"""SELECT exchange, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS rows, count(*) < 3 AS low_rate FROM ev GROUP BY 1, 2 HAVING bucket + INTERVAL 1 HOUR <= {MARK}""")
def _(t):
    return done(t, X.stream_health(X.with_watermark(streams(t).ev), "1 hour", least=3), "x15")
