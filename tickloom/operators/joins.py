"""Joins between market streams."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import safe_corr
from tickloom.operators.dominance import earlier_below
from tickloom.operators.series import bounded, plan_series, running

C = F.col


def oi_price_join(oi: DataFrame, prices: DataFrame, keys=("symbol", "exchange"), ts: str = "ts",
                  oi_col: str = "open_interest", price_col: str = "mid_price") -> DataFrame:
    """Open interest next to price within the same minute.

    Both sides are reduced to minutes first, so a busy minute never multiplies rows; ``pairs`` keeps
    the number of row pairs the minute stands for.
    """
    def per_minute(df, col, name):
        return (df.groupBy(*keys, F.date_trunc("minute", ts).cast(df.schema[ts].dataType).alias("minute"))
                .agg(F.count(F.lit(1)).alias(f"n_{name}"), F.avg(col).alias(f"avg_{name}")))
    return (per_minute(oi, oi_col, "oi").join(per_minute(prices, price_col, "price"), [*keys, "minute"])
            .withColumn("pairs", C("n_oi") * C("n_price")))


def compare_spot_futures(prices: DataFrame, market: str, spot: str, futures: str, keys, price: str,
                         tie: str) -> DataFrame:
    """Premium of futures over spot at equal keys (time included); the last row of each side counts.

    One conditional aggregation instead of a join of two filters of the same table.
    """
    def last(kind):
        hit = C(market) == kind
        return F.max_by(F.when(hit, C(price)), F.when(hit, C(tie)))
    return (prices.where(C(market).isin(spot, futures)).groupBy(*keys)
            .agg(last(spot).alias("spot_price"), last(futures).alias("futures_price"))
            .where(C("spot_price").isNotNull() & C("futures_price").isNotNull())
            .withColumn("premium", C("futures_price") - C("spot_price"))
            .withColumn("premium_pct", F.when(C("spot_price") > 0, C("premium") / C("spot_price") * 100)))


def exchange_pairs(latest: DataFrame, by, exchange: str = "exchange", ordered: bool = True) -> DataFrame:
    """Pairs of venues of one key; ``latest`` holds one row per (key, venue), so a key has few rows."""
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in latest.columns if c not in by]
    a = latest.select(*by, *[C(c).alias(f"{c}_a") for c in rest])
    b = latest.select(*by, *[C(c).alias(f"{c}_b") for c in rest])
    left, right = C(f"{exchange}_a"), C(f"{exchange}_b")
    return a.join(b, by).where((left != right) if ordered else (left < right))


def spread_matrix(latest: DataFrame, by="symbol", price: str = "price") -> DataFrame:
    """Buy on a, sell on b: spread in percent for every ordered pair of venues."""
    return exchange_pairs(latest, by).withColumn(
        "spread_pct", (C(f"{price}_b") - C(f"{price}_a")) / C(f"{price}_a") * 100)


def pairwise(latest: DataFrame, by="symbol", value: str = "funding_rate") -> DataFrame:
    """Unordered venue pairs with the difference of one value."""
    return exchange_pairs(latest, by, ordered=False).withColumn("diff", C(f"{value}_b") - C(f"{value}_a"))


def asof_join(left: DataFrame, right: DataFrame, by, ts: str = "ts", values=None, right_tie: str | None = None,
              tolerance_s: float | None = None, right_ts: str = "right_ts") -> DataFrame:
    """Each left row with the newest right row at or before it.

    Union of both sides and one running "last" per series: a single shuffle, no row multiplication,
    and a hot series is cut along time.
    """
    by = [by] if isinstance(by, str) else list(by)
    values = values or [c for c in right.columns if c not in (*by, ts)]
    body = [c for c in left.columns if c not in (*by, ts)]
    l_row = left.select(*by, ts, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                        F.struct(*body, F.lit(1).alias("_1")).alias("_l"))
    tie = C(right_tie).cast("long") if right_tie else F.lit(0).cast("long")
    r_row = right.select(*by, ts, F.lit(0).alias("_side"), tie.alias("_tie"),
                         F.struct(C(ts).alias(right_ts), *[C(v) for v in values]).alias("_r"))
    both = l_row.unionByName(r_row, allowMissingColumns=True)
    order = [ts, "_side", "_tie"]
    merged = running(both, plan_series(both, by, order), {"_seen": ("last", "_r")}).where(C("_side") == 1)
    out = merged.select(*by, ts, *[C("_l")[c].alias(c) for c in body], "_seen")
    if tolerance_s is not None:
        gap = F.expr(f"timestampdiff(MICROSECOND, _seen.{right_ts}, {ts})") / 1e6
        out = out.withColumn("_seen", F.when(gap <= tolerance_s, C("_seen")))
    return out.select(*by, ts, *body, C("_seen")[right_ts].alias(right_ts), *[C("_seen")[v].alias(v) for v in values])


def asof_many(left: DataFrame, lookups: dict[str, tuple[DataFrame, float]], by, ts: str = "ts",
              tie: str = "event_id") -> DataFrame:
    """Several as-of lookups in one pass: ``{name: (right, seconds)}`` adds a struct column per name.

    ``seconds`` asks for the newest right row at or before ``ts - seconds``: the right rows simply
    enter the union that much later. All lookups share one shuffle.
    """
    by = [by] if isinstance(by, str) else list(by)
    kind = left.schema[ts].dataType
    rows = [left.select(*by, ts, F.lit(1).alias("_side"), C(tie).cast("long").alias("_tie"),
                        F.struct(*[c for c in left.columns if c not in (*by, ts)]).alias("_l"))]
    for name, (right, seconds) in lookups.items():
        at = F.timestamp_add("MICROSECOND", F.lit(int(seconds * 1_000_000)).cast("long"), C(ts)).cast(kind)
        own = C(tie).cast("long") if tie in right.columns else F.lit(0).cast("long")
        rows.append(right.select(*by, at.alias(ts), F.lit(0).alias("_side"), own.alias("_tie"),
                                 F.struct(C(ts).alias("at"), *[c for c in right.columns if c not in (*by, ts, tie)]).alias(name)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    plan = plan_series(both, by, [ts, "_side", "_tie"])
    seen = running(both, plan, {f"_{n}": ("last", n) for n in lookups}).where(C("_side") == 1)
    return seen.select(*by, ts, "_l.*", *[C(f"_{n}").alias(n) for n in lookups])


def feature_cache(streams: dict[str, DataFrame], by=("symbol", "exchange"), ts: str = "ts",
                  tie: str = "event_id") -> DataFrame:
    """At every update of any stream, the newest row of each stream so far (one struct per stream)."""
    names = list(streams)
    rows = []
    for rank, (name, df) in enumerate(streams.items()):
        cols = [c for c in df.columns if c not in (*by, ts, tie)]
        rows.append(df.select(*by, ts, tie, F.lit(rank).alias("_rank"), F.lit(name).alias("updated"),
                              F.struct(*cols).alias(name)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    plan = plan_series(both, by, [ts, tie, "_rank"])
    merged = running(both, plan, {f"_{n}": ("last", n) for n in names})
    return merged.select(*by, ts, tie, "updated", *[C(f"_{n}").alias(n) for n in names])


def match_forecasts(pred: DataFrame, actual: DataFrame, by, tol_s: int = 3600, target: str = "target_ts",
                    ts: str = "ts", value: str = "value") -> DataFrame:
    """The newest actual within ``tol_s`` seconds of each target time.

    "Newest inside [t - tol, t + tol]" is the as-of row of t + tol unless older than 2 * tol.
    """
    shifted = pred.withColumn(ts, C(target) + F.expr(f"INTERVAL {tol_s} SECONDS"))
    hit = asof_join(shifted, actual.select(*by, ts, C(value).alias("actual")), by, ts, tolerance_s=2 * tol_s,
                    right_ts="actual_ts")
    return hit.where(C("actual").isNotNull()).drop(ts)


def match_levels(books: DataFrame, keys, order, side: str = "bids", within: float = 0.01) -> DataFrame:
    """Levels whose price also stood in the previous snapshot, with both sizes (no join, no shuffle of levels)."""
    plan = plan_series(books, keys, order, depth=1)

    def body(d, p):
        prev = F.lag(side).over(p.window())
        return d.withColumn("_prev", prev)
    got = bounded(books, plan, 1, body)
    pairs = F.transform(side, lambda x: F.struct(
        x["price"].alias("price"), x["qty"].alias("qty"),
        F.get(F.filter("_prev", lambda y: F.abs(y["price"] - x["price"]) < within), F.lit(0))["qty"].alias("prev_qty")))
    return (got.withColumn("matched", F.filter(pairs, lambda p: p["prev_qty"].isNotNull())).drop("_prev"))


def align_positional(a: DataFrame, b: DataFrame, keys, order, value: str = "value") -> DataFrame:
    """Join two series by their row position within the key."""
    def numbered(df, name):
        one = df.withColumn("_one", F.lit(1))
        return (running(one, plan_series(one, keys, order), {"pos": ("sum", "_one")})
                .select(*keys, "pos", C(value).alias(name)))
    return numbered(a, "a").join(numbered(b, "b"), [*keys, "pos"])


def lag_pairs(returns: DataFrame, symbol: str = "symbol", exchange: str = "exchange", index: str = "idx",
              value: str = "ret", max_lag: int = 4) -> DataFrame:
    """Correlation of each leader's return ``lag`` buckets later with each follower's, lag 0..max_lag."""
    lead = returns.select(symbol, C(exchange).alias("leader"), C(index).alias("_i"), C(value).alias("_x"))
    lead = lead.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("_i", C("_i") - C("lag"))
    follow = returns.select(symbol, C(exchange).alias("follower"), C(index).alias("_i"), C(value).alias("_y"))
    return (lead.join(follow, [symbol, "_i"]).where(C("leader") != C("follower"))
            .groupBy(symbol, "leader", "follower", "lag")
            .agg(safe_corr(C("_x"), C("_y")).alias("corr"), F.count(F.lit(1)).alias("n")))


def missing_streams(expected: DataFrame, present: DataFrame, keys) -> DataFrame:
    """Expected combinations that hold no data."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def supported_only(df: DataFrame, dim: DataFrame, keys) -> DataFrame:
    return df.join(dim.select(*keys).distinct(), list(keys), "left_semi")


def with_signal_meta(signals: DataFrame, meta: DataFrame, on: str = "signal") -> DataFrame:
    """Weights, thresholds and category of each signal (a dimension of a few rows)."""
    return signals.join(meta, on, "left")


def kendall_counts(values: np.ndarray) -> tuple[int, int, int]:
    """(rising pairs, falling pairs, tied pairs) of a sequence, by merging sorted halves."""
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1]
    falling, width, place = 0, 1, np.arange(n)
    while width < n:
        block = place // (2 * width)
        right = (place // width) % 2 == 1
        at = np.lexsort((right, ranks, block))     # equal values: left half first, so ties do not count
        b, r = block[at], right[at]
        seen = np.cumsum(r)
        start = np.searchsorted(b, b, side="left")
        base = seen[start] - r[start]
        falling += int(np.sum((seen - base)[~r]))
        width *= 2
    _, counts = np.unique(values, return_counts=True)
    tied = int(np.sum(counts * (counts - 1) // 2))
    return n * (n - 1) // 2 - falling - tied, falling, tied


def pair_series(series: DataFrame, keys, ts: str = "ts", value: str = "value") -> DataFrame:
    """Kendall pair counts per series, without forming the pairs: n, rising, falling, tied.

    Rising pairs are dominance counts summed over the rows, so a series of any length is cut into chunks of time and ranges of
    value; tied pairs come from the counts of equal values, and the rest falls. ``ts`` tells the rows of a series apart; null
    values take no part.
    """
    keys = list(keys)
    known = series.where(C(value).isNotNull())
    up = earlier_below(known.select(*keys, ts, value), keys, [ts], value, value, "_up").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_up").alias("rising"))
    same = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.sum(F.expr("_c * (_c - 1) div 2")).alias("tied"))
    both = up.unionByName(same, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", "rising", "tied")])
    return both.select(*keys, "n", "rising", (F.expr("n * (n - 1) div 2") - C("rising") - C("tied")).alias("falling"), "tied")
