"""Structured Streaming jobs over the same streams: event time, watermarks, keyed state, idempotent sinks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import ieee_div
from tickloom.operators.aggregates import sum_if
from tickloom.streaming.ordered import in_event_order

C = F.col


def stream_source(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 8, pattern: str | None = None) -> DataFrame:
    """Replay of a Parquet folder, at most ``max_files`` files per micro-batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (r.option("pathGlobFilter", pattern) if pattern else r).parquet(path)


def with_watermark(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp (watermarks reject zone-less ones) and the late-data bound."""
    return df.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, delay)


def run_once(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is there, write Parquet, stop. A restart with the same checkpoint goes on where it stopped."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


# ---- windows ----

def stream_candles(trades: DataFrame, every: str, by=("exchange",), ts: str = "ts", price: str = "price", qty: str = "quantity") -> DataFrame:
    w = F.window(ts, every)
    return (trades.groupBy(w.alias("w"), *by)
            .agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"),
                 F.sum(qty).alias("volume"), F.count(F.lit(1)).alias("trade_count"))
            .select(*by, C("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trade_count"))


def stream_flow(trades: DataFrame, every: str, by=("exchange",), ts: str = "ts", value: str = "quote_value", side: str = "side") -> DataFrame:
    d = trades.groupBy(F.window(ts, every).alias("w"), *by).agg(
        sum_if(C(side) == "buy", value).alias("buy_volume"), sum_if(C(side) == "sell", value).alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"))
    return d.select(*by, C("w.start").alias("bucket"), "buy_volume", "sell_volume", (C("buy_volume") - C("sell_volume")).alias("net_flow"), "trade_count")


def stream_trade_features(trades: DataFrame, window: str = "5 minutes", slide: str = "1 minute", by=("symbol",), ts: str = "ts") -> DataFrame:
    """Sliding-window counts, volumes, CVD and VWAP."""
    q, pq = C("quantity"), C("price") * C("quantity")
    d = trades.groupBy(F.window(ts, window, slide).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(q).alias("volume"), sum_if(C("side") == "buy", "quantity").alias("_b"), F.sum(pq).alias("_pq"))
    return d.select(*by, C("w.start").alias("window_start"), C("w.end").alias("window_end"), "trade_count", "volume",
                    (2 * C("_b") - C("volume")).alias("cvd"), F.when(C("volume") > 0, C("_pq") / C("volume")).otherwise(0.0).alias("vwap"))


def stream_cascades(liq: DataFrame, gap: str = "5 minutes", least: int = 3, by=("symbol",), ts: str = "ts", value: str = "value_usd") -> DataFrame:
    """Sessions of liquidations closer than ``gap``; the ``least`` filter runs on closed sessions."""
    d = liq.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("liquidation_count"), F.sum(value).alias("total_value"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    return d.where(C("liquidation_count") >= least).drop("w")


def stream_divergence(prices: DataFrame, every: str, limit_pct: float = 0.1, ts: str = "ts", price: str = "mid_price") -> DataFrame:
    """Windows in which the venues of a symbol are further apart than ``limit_pct`` percent."""
    d = prices.groupBy(F.window(ts, every).alias("w"), "symbol").agg(
        F.max(price).alias("high"), F.min(price).alias("low"), F.min("exchange").alias("one"), F.max("exchange").alias("other"))
    pct = ieee_div(C("high") - C("low"), C("low")) * 100
    return d.withColumn("divergence_pct", pct).where((C("one") < C("other")) & (C("divergence_pct") > limit_pct)).select(
        "symbol", C("w.start").alias("bucket"), "high", "low", "divergence_pct")


def stream_health(df: DataFrame, every: str = "1 minute", least: float = 10, by=("exchange",), ts: str = "ts", expected: list[str] | None = None) -> DataFrame:
    """Rows per window and a low-rate alert.

    With the ``expected`` values of the (single) key, every window in which any of them sent something has a row for each, and
    ``silent`` marks those that sent nothing. The watermark upstream is the grace time.
    """
    d = df.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("rows"))
    if expected is None:
        return d.select(*by, C("w.start").alias("bucket"), "rows", (C("rows") < least).alias("low_rate"))
    seen = d.select(F.window_time("w").alias("t"), C(by[0]).alias("_own"), "rows", F.explode(F.array(*map(F.lit, expected))).alias(by[0]))
    full = seen.groupBy(F.window("t", every).alias("w"), by[0]).agg(F.sum(F.when(C("_own") == C(by[0]), C("rows")).otherwise(0)).alias("rows"))
    return full.select(by[0], C("w.start").alias("bucket"), "rows", (C("rows") < least).alias("low_rate"), (C("rows") == 0).alias("silent"))


# ---- dedupe and joins ----

def stream_dedupe(df: DataFrame, keys) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(list(keys))


def stream_join(left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Inner join of two watermarked streams whose times differ by at most ``seconds``; state is dropped beyond it.

    A stretch of ``seconds`` of event time is part of the join key: a row of the left meets the right's rows of its own stretch and
    the two beside it, not all that the key ever had. Each right row lies in one stretch, so no pair is found twice.
    """
    micros = max(1, seconds * 1_000_000)
    stretch = lambda ts: ((F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(micros))) / micros).cast("long")
    l = left.withColumn("_stretch", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: stretch(left_ts) + i)))
    r = right.withColumn("_stretch", stretch(right_ts))
    on = [l[k] == r[k] for k in (*keys, "_stretch")]
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    on += [r[right_ts] >= l[left_ts] - step, r[right_ts] <= l[left_ts] + step]
    return l.join(r, on, "inner").select(*[l[c] for c in left.columns], *[r[c] for c in right.columns if c not in keys])


def stream_enrich(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Left join with a static dimension (symbols, coverage); Spark broadcasts it when it is small."""
    return df.join(dim, on, "left")


# ---- keyed state ----

def _keyed(key: tuple, keys, columns: dict) -> pd.DataFrame:
    """Output rows of one key."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key)}, **columns})


def last_n_stats(past: np.ndarray, new: np.ndarray, n: int, periods: int) -> dict[str, np.ndarray]:
    """Mean, deviation, z-score, velocity and percentile of every new value among the last ``n`` up to it."""
    x = np.concatenate([np.full(n - 1, np.nan), past[len(past) - min(len(past), n - 1):], new])
    w = np.lib.stride_tricks.sliding_window_view(x, n)[-len(new):]
    seen = np.count_nonzero(~np.isnan(w), axis=1)
    mean = np.nanmean(w, axis=1)
    sd = np.where(seen > 1, np.sqrt(np.nanmean((w - mean[:, None]) ** 2, axis=1)), 0.0)
    z = np.divide(new - mean, sd, out=np.zeros(len(new)), where=sd >= 1e-12)
    velocity = np.where(seen >= periods, (new - w[:, -min(periods, n)]) / periods, 0.0) if periods <= n else np.zeros(len(new))
    return {"mean": mean, "std": sd, "zscore": z, "velocity": velocity, "percentile": (w < new[:, None]).sum(axis=1) / seen * 100}


def stream_buffer_features(df: DataFrame, keys=("symbol", "exchange"), order=("event_id",), value: str = "mid_price", n: int = 100, periods: int = 5,
                           ts: str = "ts", idle: str = "7 days") -> DataFrame:
    """Mean, deviation, z-score, velocity and percentile of every update among the last n of its key, in event order.

    The stream needs a watermark on ``ts``. A key that has been silent for ``idle`` starts with an empty buffer.
    """
    def fold(key, state, rows):
        past, new = np.array(state[0] if state else [], dtype=float), rows[value].to_numpy(float)
        kept = np.concatenate([past, new])[-(n - 1):].tolist() if n > 1 else []
        return (kept,), _keyed(key, keys, {"event_id": rows["event_id"].to_numpy(), **last_n_stats(past, new, n, periods)})
    ks = ", ".join(f"{k} string" for k in keys)
    return in_event_order(df.select(*keys, ts, "event_id", *[c for c in order if c != "event_id"], value), keys, ts, order, fold, "last array<double>",
                          f"{ks}, event_id long, mean double, std double, zscore double, velocity double, percentile double", idle)


def stream_cvd(trades: DataFrame, keys=("symbol", "exchange"), order=("trade_id",), ts: str = "ts", idle: str = "7 days") -> DataFrame:
    """Cumulative volume delta in event order, carried from batch to batch; it starts anew after ``idle`` without a trade."""
    def fold(key, state, rows):
        run = (state[0] if state else 0.0) + np.cumsum(np.where(rows["side"] == "buy", rows["quantity"], -rows["quantity"]))
        return (float(run[-1]),), _keyed(key, keys, {"trade_id": rows["trade_id"].to_numpy(), "cvd": run})
    ks = ", ".join(f"{k} string" for k in keys)
    return in_event_order(trades.select(*keys, ts, "trade_id", *[c for c in order if c != "trade_id"], "side", "quantity"), keys, ts, order, fold, "cvd double",
                          f"{ks}, trade_id long, cvd double", idle)


def stream_drift(df: DataFrame, keys=("exchange",), order=("event_id",), value: str = "value", delta: float = 0.005, threshold: float = 50.0,
                 alpha: float = 0.9999, width: int = 1000, adwin_delta: float = 0.002, ts: str = "ts", idle: str = "7 days") -> DataFrame:
    """Page-Hinkley and ADWIN alarms in event order; the state of a key is both detectors' own, and it is new after ``idle``."""
    from tickloom.operators.models import adwin_run

    def fold(key, state, rows):
        mean, total, low, last = state if state else (0.0, 0.0, math.inf, [])
        x = rows[value].to_numpy(float)
        hit = np.zeros(len(x), dtype=bool)
        for i, v in enumerate(x):
            mean = alpha * mean + (1 - alpha) * v
            total += v - mean - delta
            low = min(low, total)
            if total - low > threshold:
                hit[i], total, low = True, 0.0, math.inf
        wide, window = adwin_run(x, np.array(last, dtype=float), adwin_delta, width)
        return (float(mean), float(total), float(low), window.tolist()), _keyed(key, keys, {"event_id": rows["event_id"].to_numpy(), "page_hinkley": hit, "adwin": wide})
    ks = ", ".join(f"{k} string" for k in keys)
    return in_event_order(df.select(*keys, ts, "event_id", *[c for c in order if c != "event_id"], value), keys, ts, order, fold,
                          "mean double, total double, low double, window array<double>", f"{ks}, event_id long, page_hinkley boolean, adwin boolean", idle)


# ---- sink ----

def idempotent_writer(path: str, keys=None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: a batch lands in its own folder and a replay of it overwrites the same folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.dropDuplicates(list(keys)) if keys else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def stream_sink(df: DataFrame, path: str, checkpoint: str, keys=None, mode: str = "append", trigger: str | None = None) -> None:
    w = df.writeStream.outputMode(mode).foreachBatch(idempotent_writer(path, keys)).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()
    if trigger is None:
        q.awaitTermination()
