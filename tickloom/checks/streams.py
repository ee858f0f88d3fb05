"""Market streams derived from the benchmark tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import kept

# Each entry: (streams it reads, SQL text).
STREAM_SQL: dict[str, tuple[str, str]] = {
    "ev": ("", """SELECT event_id, ts, 'S' || CAST(user_id % 5 AS VARCHAR) AS symbol, event_type AS exchange,
        value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""),
    "trades": ("ev", """SELECT event_id AS trade_id, symbol, exchange, ts, value AS price,
        CAST(k + 1 AS DOUBLE) AS quantity, value * (k + 1) AS quote_value,
        CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id % 3 = 0 AS is_buyer_maker FROM ev"""),
    "prices": ("ev", """SELECT event_id, symbol, exchange, ts, value AS mid_price, value * 0.999 AS bid_price,
        value * 1.001 AS ask_price, CAST(k + 1 AS DOUBLE) AS bid_qty, CAST(event_id % 7 + 1 AS DOUBLE) AS ask_qty
        FROM ev"""),
    "liquidations": ("ev", """SELECT event_id, symbol, exchange, ts, value AS price, CAST(k + 1 AS DOUBLE) AS quantity,
        value * (k + 1) AS value_usd, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM ev"""),
    "funding": ("ev", """SELECT event_id, symbol, exchange, ts, (value - 50) / 100000 AS funding_rate FROM ev"""),
    "oi": ("ev", """SELECT event_id, symbol, exchange, ts, value * (k + 1) + 100 AS open_interest, value AS price,
        (k + 1) / 50.0 AS long_short_ratio FROM ev"""),
    "marks": ("ev", """SELECT event_id, symbol, exchange, ts, value AS mark_price,
        value * (1 + (event_id % 11 - 5) / 1000.0) AS index_price, (value - 50) / 100000 AS funding_rate FROM ev"""),
    "ticker": ("ev", """SELECT event_id, symbol, exchange, ts, value AS last_price, (k + 1) * 1000e0 AS volume_24h,
        value * 1.05 AS high_24h, value * 0.96 AS low_24h, value * (1 + (event_id % 9 - 4) / 100.0) AS open_24h,
        k AS trade_count_24h FROM ev"""),
    "books": ("", """SELECT vec_id, 'S' || CAST(label AS VARCHAR) AS symbol, vec_id AS ts,
        [{'price': 100 + (vec_id * 7 % 13) * 0.05e0 - i * 0.1e0, 'qty': abs(CAST(embedding[i] AS DOUBLE))}
         for i in range(1, 11)] AS bids,
        [{'price': 100 + (vec_id * 7 % 13) * 0.05e0 + i * 0.1e0, 'qty': abs(CAST(embedding[10 + i] AS DOUBLE))}
         for i in range(1, 11)] AS asks FROM embeddings"""),
    "timed_books": ("books", """SELECT 'S' || CAST(CAST(substr(symbol, 2) AS INTEGER) % 5 AS VARCHAR) AS symbol,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(vec_id * 86 AS INTEGER)) AS ts, vec_id AS event_id, bids, asks FROM books"""),
    "quotes": ("ev", """SELECT event_id, symbol, exchange, ts, value AS mid_price,
        value * (0.999 - (event_id % 5) * 0.0002) AS bid_price, value * (1.001 + (event_id % 3) * 0.0003) AS ask_price,
        CAST(k + 1 AS DOUBLE) AS bid_qty, CAST(event_id % 7 + 1 AS DOUBLE) AS ask_qty FROM ev"""),
    "bars": ("", """SELECT o_orderpriority AS symbol, o_orderdate AS open_time,
        arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        arg_max(o_totalprice, o_orderkey) AS close, sum(CAST(o_custkey % 100 + 1 AS DOUBLE)) AS volume,
        CAST(count(*) AS BIGINT) AS trade_count FROM orders GROUP BY 1, 2"""),
    "hourly": ("ev", """SELECT exchange AS series, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS value
        FROM ev GROUP BY 1, 2"""),
}


def with_streams(uses: str, sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the streams it names (and of the streams those read)."""
    names: list[str] = []

    def add(name: str) -> None:
        if name not in names:
            for dep in STREAM_SQL[name][0].split():
                add(dep)
            names.append(name)
    for n in uses.split():
        add(n)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({STREAM_SQL[n][1]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        body, ctes = "WITH " + body[15:], "RECURSIVE " + ctes
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


class Tables:
    """The benchmark tables of one folder and the market streams read from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "ts", F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
            F.col("event_type").alias("exchange"), "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"))

    def parsed(self) -> Tables:
        """The same tables with the events' fields stored, for jobs that read them many times."""
        out = Tables(self.spark, self.folder)
        out.ev = kept(self.ev, "events")
        return out

    @cached_property
    def trades(self) -> DataFrame:
        return self.ev.select(
            F.col("event_id").alias("trade_id"), "symbol", "exchange", "ts", F.col("value").alias("price"),
            (F.col("k") + 1).cast("double").alias("quantity"), (F.col("value") * (F.col("k") + 1)).alias("quote_value"),
            F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
            (F.col("event_id") % 3 == 0).alias("is_buyer_maker"))

    @cached_property
    def prices(self) -> DataFrame:
        return self.ev.select(
            "event_id", "symbol", "exchange", "ts", F.col("value").alias("mid_price"),
            (F.col("value") * 0.999).alias("bid_price"), (F.col("value") * 1.001).alias("ask_price"),
            (F.col("k") + 1).cast("double").alias("bid_qty"), (F.col("event_id") % 7 + 1).cast("double").alias("ask_qty"))

    @cached_property
    def liquidations(self) -> DataFrame:
        return self.ev.select(
            "event_id", "symbol", "exchange", "ts", F.col("value").alias("price"),
            (F.col("k") + 1).cast("double").alias("quantity"), (F.col("value") * (F.col("k") + 1)).alias("value_usd"),
            F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"))

    @cached_property
    def funding(self) -> DataFrame:
        return self.ev.select("event_id", "symbol", "exchange", "ts",
                              ((F.col("value") - 50) / 100000).alias("funding_rate"))

    @cached_property
    def oi(self) -> DataFrame:
        return self.ev.select("event_id", "symbol", "exchange", "ts",
                              (F.col("value") * (F.col("k") + 1) + 100).alias("open_interest"),
                              F.col("value").alias("price"), ((F.col("k") + 1) / F.lit(50.0)).alias("long_short_ratio"))

    @cached_property
    def marks(self) -> DataFrame:
        return self.ev.select(
            "event_id", "symbol", "exchange", "ts", F.col("value").alias("mark_price"),
            (F.col("value") * (1 + (F.col("event_id") % 11 - 5) / F.lit(1000.0))).alias("index_price"),
            ((F.col("value") - 50) / 100000).alias("funding_rate"))

    @cached_property
    def ticker(self) -> DataFrame:
        return self.ev.select(
            "event_id", "symbol", "exchange", "ts", F.col("value").alias("last_price"),
            ((F.col("k") + 1) * 1000.0).alias("volume_24h"), (F.col("value") * 1.05).alias("high_24h"),
            (F.col("value") * 0.96).alias("low_24h"),
            (F.col("value") * (1 + (F.col("event_id") % 9 - 4) / F.lit(100.0))).alias("open_24h"),
            F.col("k").alias("trade_count_24h"))

    @cached_property
    def books(self) -> DataFrame:
        def side(sign: int, offset: int):
            return F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(
                (100 + (F.col("vec_id") * 7 % 13) * 0.05e0 + sign * i * 0.1).alias("price"),
                F.abs(F.get("embedding", i + (offset - 1)).cast("double")).alias("qty")))
        return self.table("embeddings").select(
            "vec_id", F.concat(F.lit("S"), F.col("label").cast("string")).alias("symbol"), F.col("vec_id").alias("ts"),
            side(-1, 0).alias("bids"), side(1, 10).alias("asks"))

    @cached_property
    def timed_books(self) -> DataFrame:
        return self.books.select(
            F.concat(F.lit("S"), (F.substring("symbol", 2, 9).cast("int") % 5).cast("string")).alias("symbol"),
            F.timestamp_add("MINUTE", F.col("vec_id") * 86, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
            F.col("vec_id").alias("event_id"), "bids", "asks")

    @cached_property
    def quotes(self) -> DataFrame:
        """Quotes whose spread varies."""
        e = F.col("event_id")
        return self.ev.select(
            "event_id", "symbol", "exchange", "ts", F.col("value").alias("mid_price"),
            (F.col("value") * (0.999 - (e % 5) * 0.0002)).alias("bid_price"),
            (F.col("value") * (1.001 + (e % 3) * 0.0003)).alias("ask_price"),
            (F.col("k") + 1).cast("double").alias("bid_qty"), (e % 7 + 1).cast("double").alias("ask_qty"))

    @cached_property
    def bars(self) -> DataFrame:
        return (self.table("orders").groupBy(F.col("o_orderpriority").alias("symbol"),
                                             F.col("o_orderdate").alias("open_time"))
                .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"),
                     F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
                     F.sum((F.col("o_custkey") % 100 + 1).cast("double")).alias("volume"),
                     F.count(F.lit(1)).alias("trade_count")))

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly mean value per exchange: a regular grid whose length depends on the time span only."""
        return (self.ev.groupBy(F.col("exchange").alias("series"), F.window("ts", "1 hour").start.alias("ts"))
                .agg(F.avg("value").alias("value")))
