"""Partitioned Parquet store of the market streams: scans, sinks, catalog, retention."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import json_levels
from tickloom.sources.schemas import feature_schemas, raw_schemas

PARTS = ["symbol", "exchange", "market_type"]


def _schema(stream: str) -> T.StructType:
    return {**raw_schemas(), **{f"{k}_features": v for k, v in feature_schemas().items()}}[stream]


def read_stream(spark: SparkSession, root: str, stream: str, symbols=None, exchanges=None, market_type=None,
                schema: T.StructType | None = None) -> DataFrame:
    """Scan one stream; the key filters are partition filters."""
    df = spark.read.schema(schema or _schema(stream)).parquet(f"{root}/{stream}")
    for column, wanted in (("symbol", symbols), ("exchange", exchanges),
                           ("market_type", [market_type] if market_type else None)):
        if wanted:
            df = df.where(F.col(column).isin(*wanted))
    return df


def resolve(name: str) -> dict[str, str]:
    """``symbol_exchange_market_stream`` to its parts."""
    parts = name.split("_", 3)
    if len(parts) != 4:
        raise ValueError(f"not a stream table name: {name}")
    return dict(zip(["symbol", "exchange", "market_type", "stream"], parts))


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by table name; an unknown stream or folder gives an empty frame with the schema."""
    key = resolve(name)
    try:
        return read_stream(spark, root, key["stream"], [key["symbol"]], [key["exchange"]], key["market_type"], schema)
    except Exception as err:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema or _schema(key["stream"]))


def list_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """(stream, symbol, exchange) combinations that hold data."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("stream"), "symbol", "exchange").distinct() for name, df in streams.items()])


def find_tables_for_symbol(streams: dict[str, DataFrame], symbol: str) -> DataFrame:
    return list_streams({n: d.where(F.col("symbol") == symbol) for n, d in streams.items()})


def create_tables(spark: SparkSession, root: str, schemas: dict[str, T.StructType], prefix: str = "") -> list[str]:
    """External partitioned Parquet tables, one per stream."""
    made = []
    for name, schema in schemas.items():
        parts = [p for p in PARTS if p in schema.fieldNames()]
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        table = f"{prefix}{name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet "
                  f"PARTITIONED BY ({', '.join(parts)}) LOCATION '{root}/{name}'")
        made.append(table)
    return made


def append(df: DataFrame, root: str, stream: str, parts=("symbol", "exchange")) -> None:
    """Append to the partitioned stream, sorted by time inside each file.

    The rebalance hint lets Spark split partitions that are large and join small ones, so a hot key is
    written by many tasks and a rare one by few.
    """
    (df.hint("rebalance", *parts).sortWithinPartitions(*parts, *[c for c in ("ts",) if c in df.columns])
     .write.mode("append").partitionBy(*parts).parquet(f"{root}/{stream}"))


def upsert_ignore(new: DataFrame, target: DataFrame, keys: list[str], order: list[str] | None = None, parts: list[str] = ()) -> DataFrame:
    """Rows of ``new`` (one per key: the first by ``order``, else by all columns) whose key is not in ``target`` yet.

    Where keys include partition columns of ``target``, name them in ``parts``: only partitions that ``new`` touches are read.
    """
    rest = [c for c in new.columns if c not in keys]
    lead = [c for c in (order or []) if c not in keys]
    first = F.min(F.struct(*lead, *[c for c in rest if c not in lead])).alias("_first") if rest else None
    one = new.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*new.columns) if rest else new.distinct()
    if parts:
        target = target.join(F.broadcast(new.select(*parts).distinct()), list(parts), "left_semi")     # as many rows as partitions
    return one.join(target.select(*keys), keys, "left_anti")


def export_day(df: DataFrame, day: date, path: str, ts: str = "ts") -> None:
    (df.where((F.col(ts) >= F.lit(day)) & (F.col(ts) < F.date_add(F.lit(day), 1)))
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def export_features_csv(df: DataFrame, columns: list[str], path: str, ts: str = "ts", start=None, end=None) -> None:
    out = df
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end))
    out.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def retain(spark: SparkSession, root: str, stream: str, first_day: date, ts: str = "ts", day: str = "day") -> list[str]:
    """Retention of a stored stream partitioned by ``day``: whole partitions before ``first_day`` are removed by name, without
    reading a row. Returns the days removed. What falls inside the first day is kept."""
    jvm, folder = spark._jvm, f"{root}/{stream}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"{day}=*")):
        name = status.getPath().getName().split("=", 1)[1]
        if name < first_day.isoformat() and fs.delete(status.getPath(), True):
            gone.append(name)
    return sorted(gone)


def apply_retention(df: DataFrame, days: int, ts: str = "ts", as_of=None) -> DataFrame:
    now = F.lit(as_of) if as_of is not None else df.select(F.max(ts)).scalar()
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def book_to_cols(df: DataFrame, levels: int = 10, bids: str = "bids", asks: str = "asks") -> DataFrame:
    cols = {}
    for side, arr in (("bid", bids), ("ask", asks)):
        for i in range(1, levels + 1):
            cols[f"{side}_{i}_price"] = F.coalesce(F.get(F.col(arr), i - 1)["price"], F.lit(0.0))
            cols[f"{side}_{i}_qty"] = F.coalesce(F.get(F.col(arr), i - 1)["qty"], F.lit(0.0))
    return df.withColumns(cols).drop(bids, asks)


def cols_to_book(df: DataFrame, levels: int = 10) -> DataFrame:
    """Level columns back to arrays; empty (zero-price) levels are left out."""
    made = {}
    for side in ("bid", "ask"):
        arr = F.array(*[F.struct(F.col(f"{side}_{i}_price").alias("price"), F.col(f"{side}_{i}_qty").alias("qty"))
                        for i in range(1, levels + 1)])
        made[f"{side}s"] = F.filter(arr, lambda x: x["price"] > 0)
    drop = [f"{s}_{i}_{k}" for s in ("bid", "ask") for i in range(1, levels + 1) for k in ("price", "qty")]
    return df.withColumns(made).drop(*drop)


def parse_book(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    return df.withColumns({bids: json_levels(F.col(bids)), asks: json_levels(F.col(asks))})


def query_sql(spark: SparkSession, sql: str, **streams: DataFrame) -> DataFrame:
    """Ad hoc SQL; streams are named in braces: ``SELECT ... FROM {trades}``."""
    return spark.sql(sql, **streams)


def to_series(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    return df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).dropna(
        subset=["ts", "value"])


def route(df: DataFrame, path: str, by: str = "symbol") -> None:
    """Write a mixed feed into per-key folders; existing keys of other runs stay."""
    df.hint("rebalance", by).write.mode("append").partitionBy(by).parquet(path)
