"""Data-quality jobs: validation, quarantine, interpolation, health and triggers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import bucket, json_valid
from tickloom.operators.aggregates import count_if
from tickloom.operators.series import bounded, plan_series, position, running
from tickloom.operators.windows import rows, time_moments

C = F.col


def issues(*tests: tuple[Column, str]) -> Column:
    """Array of the names of the failed checks."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())


def venue_prices(p: DataFrame, every: str, by, exchange: str, price: str, ts: str) -> DataFrame:
    """Last price of each venue in each bucket."""
    return p.groupBy(*by, bucket(ts, every).alias("bucket"), exchange).agg(F.max_by(price, ts).alias("price"))


def _with_venue_median(p: DataFrame, by) -> DataFrame:
    """Upper median over the venues of a bucket (a handful of rows)."""
    w = Window.partitionBy(*by, "bucket")
    arr = F.sort_array(F.collect_list("price").over(w))
    return p.withColumns({"venues": F.size(arr), "median": F.element_at(arr, F.floor(F.size(arr) / 2).cast("int") + 1)})


def validate_prices(p: DataFrame, every: str = "1 hour", by=("symbol",), exchange: str = "exchange",
                    price: str = "mid_price", ts: str = "ts", max_pct: float = 5.0) -> DataFrame:
    per = _with_venue_median(venue_prices(p, every, by, exchange, price, ts), by)
    dev = F.abs((C("price") - C("median")) / C("median") * 100)
    return (per.withColumn("deviation_pct", dev)
            .withColumn("issues", issues((C("price") <= 0, "invalid_price"), (C("deviation_pct") > max_pct, "price_deviation")))
            .withColumn("valid", F.size("issues") == 0))


def validate_books(b: DataFrame, bids: str = "bids", asks: str = "asks", min_levels: int = 3,
                   max_spread_pct: float = 10.0) -> DataFrame:
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    both = (bid > 0) & (ask > 0)

    def unsorted(side, rising):
        i = F.sequence(F.lit(1), F.size(side) - 1)
        step = lambda k: F.get(side, k)["price"] - F.get(side, k - 1)["price"]
        bad = F.exists(i, lambda k: step(k) < 0 if rising else step(k) > 0)
        return F.when(F.size(side) > 1, bad).otherwise(False)
    return (b.withColumn("issues", issues(
        (F.size(bids) < min_levels, "insufficient_bids"), (F.size(asks) < min_levels, "insufficient_asks"),
        (both & ((ask - bid) / bid * 100 > max_spread_pct), "wide_spread"), (both & (bid >= ask), "crossed_book"),
        (unsorted(bids, False), "unsorted_bids"), (unsorted(asks, True), "unsorted_asks")))
        .withColumn("valid", F.size("issues") == 0))


def cross_exchange_outliers(p: DataFrame, every: str = "1 hour", by=("symbol",), exchange: str = "exchange",
                            price: str = "mid_price", ts: str = "ts", max_pct: float = 3.0) -> DataFrame:
    per = _with_venue_median(venue_prices(p, every, by, exchange, price, ts), by).where(C("venues") >= 2)
    dev = F.when(C("median") > 0, F.abs((C("price") - C("median")) / C("median") * 100))
    return per.withColumn("deviation_pct", dev).where(C("deviation_pct") > max_pct)


def validate_vs_history(p: DataFrame, keys, ts: str = "ts", tie: str = "event_id", price: str = "mid_price",
                        minutes: int = 60, max_pct: float = 5.0, max_z: float = 3.0) -> DataFrame:
    """Each price against mean and sample deviation of the preceding minutes, itself excluded."""
    x = C(price)
    out = time_moments(p, keys, ts, tie, price, minutes * 60).withColumn("samples", C("samples").cast("long"))
    known = (C("mean") > 0) & (C("std") > 1e-9)
    return (out.withColumns({"z_score": F.when(known, (x - C("mean")) / C("std")),
                             "deviation_pct": F.when(known, F.abs((x - C("mean")) / C("mean") * 100))})
            .withColumn("valid", F.coalesce((C("deviation_pct") <= max_pct) & (F.abs("z_score") <= max_z), x > 0)))


def point_anomaly(df: DataFrame, keys, order, col: str, n: int = 100, least: int = 10) -> DataFrame:
    """z-score of each value against the n rows before it (population deviation)."""
    plan = plan_series(df, keys, order, depth=n + 1)

    def body(d, p):
        w = rows(p, n, end=-1)
        sd = F.stddev_pop(col).over(w)
        z = F.when(F.count(col).over(w) >= least, F.when(sd > 1e-12, (C(col) - F.avg(col).over(w)) / sd).otherwise(0.0))
        return d.withColumn("z_score", z)
    a = F.abs("z_score")
    return bounded(df, plan, n + 1, body).withColumns({
        "is_anomaly": F.coalesce(a > 3, F.lit(False)),
        "severity": F.when(a > 4, "high").when(a > 3.5, "medium").when(a > 3, "low")})


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, failing rows with their reasons)."""
    marked = df.withColumn("reasons", issues(*[(test, name) for name, test in checks.items()]))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


# Fill strategies each kind of data allows.
FILL_ALLOWED = {"price": ("linear", "forward_fill"), "funding": ("forward_fill",),
                "open_interest": ("linear", "forward_fill"), "orderbook": ("none",), "trades": ("none",)}


def interpolate(df: DataFrame, keys, every_s: int, how: str, data_type: str = "price", ts: str = "ts",
                value: str = "value") -> DataFrame:
    """Fill missing steps of a regular series between two known points.

    Each known row makes the steps up to its successor itself, so there is no grid join.
    """
    allowed = FILL_ALLOWED.get(data_type, ("linear",))
    if how not in allowed:
        raise ValueError(f"{how} is not allowed for {data_type}; allowed: {', '.join(allowed)}")
    slim = df.select(*keys, ts, value)
    if how == "none":
        return slim.withColumn("filled", F.lit(False))
    plan = plan_series(slim, keys, [ts], depth=1)
    nxt = bounded(slim, plan, 0, ahead=1, body=lambda d, p: d.withColumns({
        "_nt": F.lead(ts).over(p.window()), "_nv": F.lead(value).over(p.window())}))
    span = F.timestamp_diff("SECOND", C(ts), C("_nt"))
    count = F.coalesce((span / every_s).cast("int") - F.when(span % every_s == 0, 1).otherwise(0), F.lit(0))
    made = nxt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0)))))
    share = C("_k") * every_s / span
    filled = C(value) if how == "forward_fill" else C(value) + (C("_nv") - C(value)) * share
    kind = df.schema[ts].dataType
    return made.select(*keys, F.timestamp_add("SECOND", C("_k") * every_s, C(ts)).cast(kind).alias(ts),
                       F.when(C("_k") == 0, C(value)).otherwise(filled).alias(value), (C("_k") > 0).alias("filled"))


def rule_checks(df: DataFrame, by=(), ts: str = "ts", bid: str | None = None, ask: str | None = None,
                ohlc: bool = False, numeric=(), side: str | None = None, json_cols=(), as_of=None) -> DataFrame:
    """Counts of rule violations in one aggregation."""
    aggs = [F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.countDistinct(ts)).alias("duplicate_ts")]
    if bid and ask:
        aggs.append(count_if((C(bid) > 0) & (C(ask) > 0) & (C(bid) > C(ask))).alias("bid_above_ask"))
    if ohlc:
        aggs.append(count_if((C("high") < C("low")) | (C("high") < C("open")) | (C("high") < C("close"))
                             | (C("low") > C("open")) | (C("low") > C("close"))).alias("bad_ohlc"))
    for c in numeric:
        aggs += [count_if(C(c) < 0).alias(f"{c}_negative"), count_if(C(c) == 0).alias(f"{c}_zero"),
                 count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"{c}_nan_inf")]
    if side:
        aggs.append(count_if(~F.lower(side).isin("buy", "sell", "unknown")).alias("bad_side"))
    for c in json_cols:
        aggs.append(count_if(C(c).isNotNull() & ~json_valid(C(c))).alias(f"{c}_bad_json"))
    if as_of is not None:
        aggs.append(count_if(C(ts) > F.lit(as_of)).alias("future_ts"))
    return df.groupBy(*by).agg(*aggs)


def schema_check(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Missing columns and type differences, with the number of rows they concern."""
    found = []
    for f in expected.fields:
        if f.name not in df.columns:
            found.append((f.name, "missing", f.dataType.simpleString(), None))
        elif df.schema[f.name].dataType != f.dataType:
            found.append((f.name, "type_mismatch", f.dataType.simpleString(), df.schema[f.name].dataType.simpleString()))
    rows_of = df.agg(F.count(F.lit(1)).alias("row_count"))
    cells = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(
        ("column", "problem", "expected", "found"), r)]) for r in found]) if found else F.array().cast(
        "array<struct<column:string,problem:string,expected:string,found:string>>")
    return rows_of.select(F.explode(cells).alias("c"), "row_count").select("c.*", "row_count")


# Weight of a failed check by severity, and caps of the health deductions.
SEVERITY = {"invalid_price": "critical", "crossed_book": "critical", "price_deviation": "medium", "wide_spread": "medium",
            "insufficient_bids": "low", "insufficient_asks": "low", "unsorted_bids": "low", "unsorted_asks": "low"}


def _equals(value: str):
    return lambda x: x == value


def quality_report(checked: DataFrame, by=(), issue_col: str = "issues") -> DataFrame:
    """Issue counts per severity and the health score they leave (pass rate weighs 20 %, criticals up to 15 points)."""
    names = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    sev = F.transform(issue_col, lambda i: F.coalesce(F.try_element_at(names, i), F.lit("low")))
    per = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"), count_if(F.size(issue_col) == 0).alias("passed"),
        *[F.sum(F.size(F.filter(sev, _equals(k))).cast("long")).alias(k) for k in ("critical", "medium", "low")])
    rate = C("passed") / C("checked") * 100
    score = 100 - (100 - rate) * 0.2 - F.least(F.lit(15.0), C("critical") * 5.0)
    return per.withColumns({"pass_rate": rate, "health_score": F.greatest(F.lit(0.0), score)})


def issue_log(checked: DataFrame, keys, issue_col: str = "issues") -> DataFrame:
    """One log row per failed check."""
    names = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return (checked.select(*keys, F.explode(issue_col).alias("issue"))
            .withColumn("severity", F.coalesce(F.try_element_at(names, C("issue")), F.lit("low"))))


# Metric, lower bound (exclusive), upper bound (inclusive), action, cooldown in seconds.
TRIGGER_RULES = [
    ("gap_duration_seconds", 60.0, 300.0, "interpolate_missing_data", 60),
    ("gap_duration_seconds", 300.0, None, "request_backfill", 600),
    ("z_score", 4.0, None, "quarantine_data", 60),
    ("deviation_percent", 5.0, None, "log_quality_issue", 300),
]


def triggers(metrics: DataFrame, keys, ts: str = "ts", metric: str = "metric", value: str = "value") -> DataFrame:
    """Action rows of the metrics that break a rule, each at least the rule's cooldown after the rule last fired for the key.

    A hit after a pause of the cooldown or more fires in any case, so series are cut there. Inside such a run the firings follow
    one from the other: tasks read their runs in order, batch by batch, and keep nothing but the time of the last firing.
    """
    action = cool = None
    for name, low, high, act, secs in TRIGGER_RULES:
        test = (C(metric) == name) & (C(value) > low)
        if high is not None:
            test = test & (C(value) <= high)
        action = F.when(test, act) if action is None else action.when(test, act)
        cool = F.when(test, secs) if cool is None else cool.when(test, secs)
    hits = metrics.withColumns({"action": action, "_cool": cool.cast("long") * 1_000_000}).where(C("action").isNotNull())
    hits = hits.withColumn("_us", position(hits, ts))
    series = [*keys, "action"]
    plan = plan_series(hits, series, ["_us"], depth=1)

    def flag(d: DataFrame, p) -> DataFrame:
        before = F.lag("_us").over(p.window())
        return d.withColumn("_start", F.when(before.isNull() | (C("_us") - before >= C("_cool")), 1).otherwise(0))
    runs = running(bounded(hits, plan, 1, flag), plan, {"_run": ("sum", "_start")}).drop("_start")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = last = None
        for b in batches:
            run, us, cool_us = (b[c].to_numpy() for c in ("_id", "_us", "_cool"))
            edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            keep = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                at = lo
                if run[lo] == here:
                    at = lo + int(np.searchsorted(us[lo:hi], last + cool_us[lo]))
                while at < hi:
                    keep.append(at)
                    last = us[at]
                    at += max(1, int(np.searchsorted(us[at:hi], last + cool_us[at])))
                here = run[lo]
            yield b.take(pa.array(keep, pa.int64()))
    dealt = (runs.withColumn("_id", F.xxhash64(*series, "_run")).repartition(*series, "_run").sortWithinPartitions("_id", *series, "_run", "_us"))
    return dealt.mapInArrow(fire, dealt.schema).select(*metrics.columns, "action")
