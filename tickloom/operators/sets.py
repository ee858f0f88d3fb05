"""Unions, distinct values, duplicates and level overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import bounded, plan_series

C = F.col


def union_streams(streams: dict[str, DataFrame], label: str = "source") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def dup_ts(df: DataFrame, keys, ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - F.countDistinct(ts)).alias("duplicates"))


def dedupe(df: DataFrame, keys) -> DataFrame:
    return df.dropDuplicates(list(keys))


def level_overlap(books: DataFrame, keys, order, n: int = 10, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Prices present in this and the previous snapshot, and their share of the previous levels."""
    def prices(side):
        return F.transform(F.slice(side, 1, n), lambda x: x["price"])
    plan = plan_series(books, keys, order, depth=1)

    def body(d, p):
        w = p.window()
        return d.withColumns({"_pb": F.lag(prices(bids)).over(w), "_pa": F.lag(prices(asks)).over(w)})
    kept_b, kept_a = F.size(F.array_intersect(prices(bids), "_pb")), F.size(F.array_intersect(prices(asks), "_pa"))
    out = bounded(books, plan, 1, body)
    return out.withColumns({
        "bids_kept": F.when(C("_pb").isNotNull(), kept_b), "asks_kept": F.when(C("_pa").isNotNull(), kept_a),
        "persistence": F.when(C("_pb").isNull(), 1.0).otherwise((kept_b + kept_a) / (F.size("_pb") + F.size("_pa")))
    }).drop("_pb", "_pa")
