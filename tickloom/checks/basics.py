"""Sources, sinks, projections, filters and scalar functions (S, P, F)."""

from __future__ import annotations

from datetime import date, datetime
from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.functions import columns as K
from tickloom.session import scratch_path
from tickloom.sources import schemas, store

C = F.col


def _written_trades(t, name):
    root = scratch_path(t.spark, name)
    store.append(t.trades, root, "trades")
    return root, t.trades.schema


@query("s1_read_stream", uses="trades", sql="""SELECT trade_id, symbol, exchange, price FROM trades
       WHERE symbol IN ('S1', 'S2') AND exchange IN ('click', 'view')""")
def _(t):
    root, schema = _written_trades(t, "s1")
    return (store.read_stream(t.spark, root, "trades", ["S1", "S2"], ["click", "view"], schema=schema)
            .select("trade_id", "symbol", "exchange", "price"))


@query("s2_resolve_name", uses="trades", sql="""SELECT trade_id, price, 'futures' AS market_type FROM trades
       WHERE symbol = 'S1' AND exchange = 'click'""")
def _(t):
    root = scratch_path(t.spark, "s2")
    df = t.trades.withColumn("market_type", F.lit("futures"))
    store.append(df, root, "trades", store.PARTS)
    found = store.read_table(t.spark, root, "S1_click_futures_trades", df.schema)
    none = store.read_table(t.spark, root + "/absent", "S1_click_futures_trades", df.schema)
    return found.unionByName(none).select("trade_id", "price", "market_type")


@query("s3_list_streams", uses="trades funding", sql="""
       SELECT DISTINCT 'trades' AS stream, symbol, exchange FROM trades UNION ALL
       SELECT DISTINCT 'funding_rates', symbol, exchange FROM funding""")
def _(t):
    return store.list_streams({"trades": t.trades, "funding_rates": t.funding})


@query("s3_find_tables_for_symbol", uses="trades funding", sql="""
       SELECT DISTINCT 'trades' AS stream, symbol, exchange FROM trades WHERE symbol = 'S3' UNION ALL
       SELECT DISTINCT 'funding_rates', symbol, exchange FROM funding WHERE symbol = 'S3'""")
def _(t):
    return store.find_tables_for_symbol({"trades": t.trades, "funding_rates": t.funding}, "S3")


@query("s4_typed_raw_stream", uses="trades", sql="""SELECT symbol, exchange, 'futures' AS market_type, ts,
       CAST(trade_id AS VARCHAR) AS trade_id, price, quantity, quote_value, side, is_buyer_maker FROM trades""")
def _(t):
    root = scratch_path(t.spark, "s4")
    schema = schemas.raw_schemas()["trades"]
    df = t.trades.withColumn("market_type", F.lit("futures"))
    store.append(df.select([C(f.name).cast(f.dataType) for f in schema.fields]), root, "trades", store.PARTS)
    return store.read_stream(t.spark, root, "trades").select(*schema.fieldNames())


@query("s5_typed_feature_table", uses="funding", doubles="funding_rate annualized_rate", digits=8, sql="""
       SELECT symbol, exchange, ts, funding_rate, funding_rate * 1095 AS annualized_rate FROM funding""")
def _(t):
    root = scratch_path(t.spark, "s5")
    df = (t.funding.withColumn("market_type", F.lit("futures"))
          .withColumn("annualized_rate", K.annualize(C("funding_rate"))))
    store.append(df.select("symbol", "exchange", "market_type", "ts", "funding_rate", "annualized_rate"),
                 root, "funding_features", store.PARTS)
    return store.read_stream(t.spark, root, "funding_features").select(
        "symbol", "exchange", "ts", "funding_rate", "annualized_rate")


@query("s6_append", uses="trades", doubles="total", sql="""SELECT symbol, exchange, count(*) * 2 AS n,
       sum(quote_value) * 2 AS total FROM trades GROUP BY 1, 2""")
def _(t):
    root, schema = _written_trades(t, "s6")
    store.append(t.trades, root, "trades")
    return (store.read_stream(t.spark, root, "trades", schema=schema).groupBy("symbol", "exchange")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("quote_value").alias("total")))


@query("s7_upsert_ignore", sql="""SELECT DISTINCT o_orderpriority AS symbol, o_orderdate AS open_time FROM orders
       WHERE (o_orderpriority, o_orderdate) NOT IN (SELECT (o_orderpriority, o_orderdate) FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    bars = t.table("orders").select(C("o_orderpriority").alias("symbol"), C("o_orderdate").alias("open_time"), "o_orderstatus")
    stored = bars.where("o_orderstatus = 'F'")
    return store.upsert_ignore(bars, stored, ["symbol", "open_time"]).select("symbol", "open_time")


@query("s8_export_day", uses="trades", sql="SELECT * FROM trades WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def _(t):
    path = scratch_path(t.spark, "s8")
    store.export_day(t.trades, date(2024, 1, 15), path)
    return t.spark.read.schema(t.trades.schema).parquet(path)


@query("s9_export_csv", uses="prices", doubles="mid_price", sql="""SELECT event_id, symbol, mid_price FROM prices
       WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def _(t):
    path = scratch_path(t.spark, "s9")
    store.export_features_csv(t.prices, ["event_id", "symbol", "mid_price"], path,
                              start=datetime(2024, 1, 5), end=datetime(2024, 1, 20))
    return t.spark.read.schema("event_id long, symbol string, mid_price double").option("header", True).csv(path)


@query("s10_retention", uses="trades",
       sql="SELECT * FROM trades WHERE ts >= (SELECT max(ts) FROM trades) - INTERVAL 7 DAY")
def _(t):
    return store.apply_retention(t.trades, 7)


@query("s11_parse_book", uses="books", doubles="bid_price bid_qty ask_price", sql="""SELECT vec_id,
       bids[1].price AS bid_price, bids[1].qty AS bid_qty, asks[10].price AS ask_price,
       CAST(len(bids) AS INTEGER) AS levels, true AS bad_is_null FROM books""")
def _(t):
    text = lambda c: F.to_json(F.transform(c, lambda x: F.array(x["price"], x["qty"])))
    df = t.books.select("vec_id", text("bids").alias("bids"), text("asks").alias("asks"),
                        F.concat(F.lit("{"), text("bids")).alias("bad"))
    p = store.parse_book(df)
    return p.select("vec_id", C("bids")[0]["price"].alias("bid_price"), C("bids")[0]["qty"].alias("bid_qty"),
                    C("asks")[9]["price"].alias("ask_price"), F.size("bids").alias("levels"),
                    K.json_levels(C("bad")).isNull().alias("bad_is_null"))


@query("s12_book_columns", uses="books", doubles="bid_1_price bid_3_qty ask_10_price ask_10_qty total", sql="""
       SELECT vec_id, bids[1].price AS bid_1_price, bids[3].qty AS bid_3_qty, asks[10].price AS ask_10_price,
       asks[10].qty AS ask_10_qty, list_sum([x.qty for x in bids]) AS total FROM books""")
def _(t):
    flat = store.book_to_cols(t.books)
    back = store.cols_to_book(flat)
    keep = ["vec_id", "bid_1_price", "bid_3_qty", "ask_10_price", "ask_10_qty"]
    # both directions: flat columns, and the total of the rebuilt array
    return flat.select(*keep).join(back.select("vec_id", K.qty_sum(C("bids")).alias("total")), "vec_id")


@query("s13_query_sql", uses="trades", doubles="total", sql="""SELECT symbol, sum(quote_value) AS total
       FROM trades WHERE side = 'buy' GROUP BY symbol""")
def _(t):
    return store.query_sql(t.spark, "SELECT symbol, sum(quote_value) AS total FROM {trades} WHERE side = 'buy' "
                                    "GROUP BY symbol", trades=t.trades)


@query("s14_to_series", uses="trades", sql="SELECT symbol, ts, CAST(quantity AS DOUBLE) AS value FROM trades")
def _(t):
    return store.to_series(t.trades, ["symbol"], "ts", "quantity")


@query("s15_route", uses="trades", sql="SELECT symbol, count(*) AS n FROM trades GROUP BY symbol")
def _(t):
    path = scratch_path(t.spark, "s15")
    store.route(t.trades, path)
    return (t.spark.read.schema(t.trades.schema).parquet(path).groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p1_lookback", uses="trades", sql="""SELECT trade_id, ts FROM trades
       WHERE ts >= (SELECT max(ts) FROM trades) - INTERVAL 24 HOUR""")
def _(t):
    return K.lookback(t.trades, "ts", "24 HOURS").select("trade_id", "ts")


@query("p2_between", uses="trades", sql="""SELECT trade_id, ts FROM trades
       WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""")
def _(t):
    return K.between(t.trades, "ts", datetime(2024, 1, 10), datetime(2024, 1, 12)).select("trade_id", "ts")


@query("p3_filter_side", uses="trades", sql="SELECT trade_id, side FROM trades WHERE lower(side) = 'sell'")
def _(t):
    return K.filter_side(t.trades, "SELL").select("trade_id", "side")


@query("p4_min_value_positive", uses="trades",
       sql="SELECT trade_id, quote_value FROM trades WHERE quote_value >= 5000 AND price > 0")
def _(t):
    return K.positive(K.min_value(t.trades, "quote_value", 5000), "price").select("trade_id", "quote_value")


@query("p5_project", uses="trades", sql="SELECT trade_id, side, price FROM trades")
def _(t):
    return K.project(t.trades, ["trade_id", "side", "price"])


@query("p6_by_market", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return K.by_market(t.table("orders"), "F", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("p7_spread", uses="prices", doubles="mid spread spread_bps", sql="""SELECT event_id,
       (bid_price + ask_price) / 2 AS mid, ask_price - bid_price AS spread,
       CASE WHEN (bid_price + ask_price) / 2 > 0 THEN (ask_price - bid_price) / ((bid_price + ask_price) / 2) * 10000
       ELSE 0 END AS spread_bps FROM prices""")
def _(t):
    return K.with_spread(t.prices).select("event_id", "mid", "spread", "spread_bps")


@query("p8_quote_value", doubles="quote_value", sql="""SELECT l_orderkey, l_linenumber,
       l_extendedprice * l_quantity AS quote_value FROM lineitem""")
def _(t):
    return K.with_quote_value(t.table("lineitem"), "l_extendedprice", "l_quantity").select(
        "l_orderkey", "l_linenumber", "quote_value")


@query("p9_basis", uses="marks", doubles="basis basis_pct", sql="""SELECT event_id, mark_price - index_price AS basis,
       CASE WHEN index_price > 0 THEN (mark_price - index_price) / index_price * 100 ELSE 0 END AS basis_pct
       FROM marks""")
def _(t):
    return K.with_basis(t.marks).select("event_id", "basis", "basis_pct")


@query("p10_funding_pct", uses="funding", doubles="funding_pct annualized_pct", sql="""SELECT event_id,
       funding_rate * 100 AS funding_pct, funding_rate * 3 * 365 * 100 AS annualized_pct FROM funding""")
def _(t):
    return K.with_funding_pct(t.funding).select("event_id", "funding_pct", "annualized_pct")


@query("p11_taker_pct", doubles="taker_buy_pct", sql="""SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity > 0 AND l_discount <> 0 THEN l_discount / l_quantity * 100 END AS taker_buy_pct
       FROM lineitem""")
def _(t):
    return K.with_taker_pct(t.table("lineitem"), "l_discount", "l_quantity").select(
        "l_orderkey", "l_linenumber", "taker_buy_pct")


@query("p12_book_totals", uses="books", doubles="total_bid_depth total_ask_depth bid_ask_ratio spread_pct", sql="""
       SELECT vec_id, b AS total_bid_depth, a AS total_ask_depth, CASE WHEN a = 0 THEN 0 ELSE b / a END AS bid_ask_ratio,
       (asks[1].price - bids[1].price) / ((asks[1].price + bids[1].price) / 2) * 100 AS spread_pct FROM (SELECT *,
       list_sum([x.qty for x in bids]) AS b, list_sum([x.qty for x in asks]) AS a FROM books)""")
def _(t):
    return K.with_book_totals(t.books).select("vec_id", "total_bid_depth", "total_ask_depth", "bid_ask_ratio",
                                              "spread_pct")


@query("p13_values", uses="trades", doubles="value_usd est_profit_usd", sql="""SELECT trade_id,
       price * quantity AS value_usd, price * 100 AS est_profit_usd FROM trades""")
def _(t):
    return K.with_est_profit(K.with_value_usd(t.trades), "price").select("trade_id", "value_usd", "est_profit_usd")


@query("p14_normalize_fields", uses="trades", sql="""SELECT trade_id, price, quantity, ts AS timestamp FROM trades""")
def _(t):
    feed = t.trades.select("trade_id", C("price").alias("p"), C("quantity").alias("q"), C("ts").alias("T"))
    return K.normalize_fields(feed, "binance", "price")


@query("p15_normalize_symbol", sql="""SELECT c_custkey, COALESCE(n.n_name || '-PERPETUAL', c_mktsegment) AS venue_symbol
       FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def _(t):
    mapping = t.table("nation").where("n_regionkey < 3").select(
        C("n_nationkey").alias("exchange"), F.concat("n_name", F.lit("-PERPETUAL")).alias("venue_symbol"))
    df = t.table("customer").select("c_custkey", C("c_nationkey").alias("exchange"), C("c_mktsegment").alias("symbol"))
    mapping = df.select("exchange", "symbol").distinct().join(mapping, "exchange")
    return K.normalize_symbol(df, mapping).select("c_custkey", "venue_symbol")


@query("p16_label_by", uses="prices", sql="""SELECT event_id, CASE WHEN mid_price > 200 THEN 'EXTREME'
       WHEN mid_price > 100 THEN 'HIGH' WHEN mid_price > 50 THEN 'MODERATE' ELSE 'LOW' END AS level FROM prices""")
def _(t):
    return t.prices.select("event_id", K.label_by(
        C("mid_price"), [(200, "EXTREME"), (100, "HIGH"), (50, "MODERATE")], "LOW").alias("level"))


@query("f1_math", doubles="div clipped norm log_ratio", sql="""SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS div,
       greatest(10, least(30, l_quantity)) AS clipped, (l_quantity - 1) / 49 AS norm,
       CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn, ln(l_extendedprice / l_quantity) AS log_ratio FROM lineitem""")
def _(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", K.safe_div(C("l_tax"), C("l_discount")).alias("div"),
        K.clip(C("l_quantity"), 10.0, 30.0).alias("clipped"),
        K.normalize(C("l_quantity"), F.lit(1.0), F.lit(50.0)).alias("norm"),
        F.signum(C("l_quantity") - 25).alias("sgn"), F.log(C("l_extendedprice") / C("l_quantity")).alias("log_ratio"))


@query("f2_zscore", uses="prices", doubles="z pct", sql="""SELECT event_id, z, CASE WHEN z >= 3 THEN 99.9
       WHEN z >= 2 THEN 97.7 WHEN z >= 1 THEN 84.1 WHEN z >= -1 THEN 50 + z * 34.1 WHEN z >= -2 THEN 2.3 ELSE 0.1 END
       AS pct FROM (SELECT event_id, (mid_price - 50) / 25 AS z FROM prices)""")
def _(t):
    z = K.zscore(C("mid_price"), F.lit(50.0), F.lit(25.0))
    return t.prices.select("event_id", z.alias("z"), K.zscore_to_percentile(z).alias("pct"))


@query("f3_rates", uses="prices", doubles="annual bps fixed", digits=8, sql="""SELECT event_id, r * 3 * 365 AS annual,
       r * 10000 AS bps, CASE WHEN abs(mid_price) > 1 THEN mid_price / 10000 ELSE mid_price END AS fixed
       FROM (SELECT *, (mid_price - 50) / 100000 AS r FROM prices)""")
def _(t):
    r = (C("mid_price") - 50) / 100000
    return t.prices.select("event_id", K.annualize(r).alias("annual"), K.to_bps(r).alias("bps"),
                           K.fix_rate_unit(C("mid_price")).alias("fixed"))


@query("f4_time", uses="ev", sql="""SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS quarter,
       time_bucket(INTERVAL '7 days', ts) AS week, date_trunc('hour', ts) AS hour,
       28800 - (CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) % 28800) AS to_funding FROM ev""")
def _(t):
    return t.ev.select("event_id", K.bucket("ts", "15 minutes").alias("quarter"), "ts").select(
        "event_id", "quarter", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        K.countdown_secs(C("ts")).alias("to_funding"), "ts").withColumn("week", K.bucket("ts", "7 days")).drop("ts")


@query("f5_strings", sql="""SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('buy', 'b', 'bid', 'f') THEN 'buy'
       WHEN o_orderstatus IN ('O') THEN 'sell' WHEN o_orderkey % 2 = 0 THEN 'sell' ELSE 'buy' END AS side,
       split_part(o_orderpriority, '-', 2) AS expiry FROM orders""")
def _(t):
    word = F.when(C("o_orderstatus") == "F", "BID").when(C("o_orderstatus") == "O", "Ask").otherwise("?")
    return t.table("orders").select(
        "o_orderkey", K.norm_side(word, C("o_orderkey") % 2 == 0).alias("side"),
        K.split_instrument(C("o_orderpriority"))["expiry"].alias("expiry"))


@query("f6_arrays", uses="books", doubles="depth5 hhi vwap cum10 slope", sql="""SELECT vec_id,
       list_sum([x.qty for x in bids[1:5]]) AS depth5,
       list_sum([x.qty * x.qty for x in list_concat(bids, asks)]) /
       pow(list_sum([x.qty for x in list_concat(bids, asks)]), 2) AS hhi,
       list_sum([x.price * x.qty for x in list_concat(bids, asks)]) /
       list_sum([x.qty for x in list_concat(bids, asks)]) AS vwap, list_sum([x.qty for x in bids]) AS cum10,
       (10 * list_sum([i * bids[i].qty for i in range(1, 11)]) - 55 * list_sum([x.qty for x in bids])) / 825 AS slope
       FROM books""")
def _(t):
    return t.books.select(
        "vec_id", K.depth_n(C("bids"), 5).alias("depth5"), K.hhi(C("bids"), C("asks")).alias("hhi"),
        K.level_vwap(C("bids"), C("asks")).alias("vwap"), F.element_at(K.cumulative_qty(C("bids")), -1).alias("cum10"),
        K.array_slope(F.transform(F.sequence(F.lit(1), F.size("bids")), lambda i: i.cast("double")),
                      F.transform("bids", lambda x: x["qty"])).alias("slope"))


@query("f7_json", sql="""SELECT event_id, false AS is_array, true AS list_ok,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    return t.table("events").select(
        "event_id", K.json_valid(C("props")).alias("is_array"),
        K.json_valid(F.concat(F.lit("["), C("props"), F.lit("]"))).alias("list_ok"),
        F.from_json("props", "k long")["k"].alias("k"))


@query("f8_make_signal", uses="prices", doubles="strength", sql="""SELECT event_id, CASE WHEN mid_price > 50
       THEN 'BULLISH' ELSE 'BEARISH' END AS type, greatest(0, least(1, abs(mid_price - 50) / 50)) AS strength,
       'distance from 50' AS description FROM prices""")
def _(t):
    s = K.make_signal(F.when(C("mid_price") > 50, "BULLISH").otherwise("BEARISH"),
                      F.abs(C("mid_price") - 50) / 50, F.lit("distance from 50"))
    return t.prices.select("event_id", s.alias("s")).select("event_id", "s.type", "s.strength", "s.description")
