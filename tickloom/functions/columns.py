"""Row-level projections and scalar expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; ``default`` where b is 0 or NULL (``None`` keeps NULL, the SQL form)."""
    return F.when(b.isNull() | (b == 0), F.lit(default).cast("double")).otherwise(a / b)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b of doubles where 0 / 0 is NaN and x / 0 infinite with the sign of x, as in SQL engines that keep to IEEE 754."""
    by_zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, by_zero).otherwise(a / b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalize(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), 0.5 for an empty range."""
    return F.when(low == high, 0.5).otherwise((x - low) / (high - low))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std.isNull() | (std == 0), 0.0).otherwise((x - mean) / std)


def zscore_to_percentile(z: Column) -> Column:
    return (F.when(z >= 3, 99.9).when(z >= 2, 97.7).when(z >= 1, 84.1)
            .when(z >= -1, 50 + z * 34.1).when(z >= -2, 2.3).otherwise(0.1))


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Population correlation of the rows where both are known; NULL without spread on either side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sa, sb = [p.over(over) if over is not None else p for p in parts]
    return F.when((sa > 1e-12) & (sb > 1e-12), cov / (sa * sb))


def label_by(x: Column, rules: list[tuple[float, str]], default: str, strict: bool = True) -> Column:
    """First label whose threshold x exceeds (rules from the highest threshold down)."""
    out = None
    for threshold, label in rules:
        test = x > threshold if strict else x >= threshold
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def annualize(rate: Column, per_day: int = 3) -> Column:
    """8-hour rate to a yearly fraction."""
    return rate * per_day * 365


def to_bps(x: Column) -> Column:
    return x * 10000


def fix_rate_unit(rate: Column) -> Column:
    """Rates beyond +-1 were quoted in basis points."""
    return F.when(F.abs(rate) > 1, rate / 10000).otherwise(rate)


def bucket(ts: Column | str, every: str) -> Column:
    """Start of the time bucket; weeks begin on Monday."""
    if every.split()[1].startswith("week") or every == "7 days":
        return F.window(ts, "7 days", startTime="4 days").start
    return F.window(ts, every).start


def countdown_secs(ts: Column, every_hours: int = 8) -> Column:
    """Seconds to the next funding time (00:00, 08:00, 16:00)."""
    step = every_hours * 3600
    day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.lit(step) - F.pmod(day, F.lit(step))


# Spellings of the two sides.
BUY_WORDS, SELL_WORDS = ("buy", "b", "bid"), ("sell", "s", "ask")


def norm_side(side: Column, is_buyer_maker: Column | None = None) -> Column:
    """'buy' / 'sell' from any spelling, else from the maker flag, else NULL."""
    low = F.lower(side)
    out = F.when(low.isin(*BUY_WORDS), "buy").when(low.isin(*SELL_WORDS), "sell")
    if is_buyer_maker is not None:
        out = out.when(is_buyer_maker.isNotNull(), F.when(is_buyer_maker, "sell").otherwise("buy"))
    return out


def split_instrument(name: Column) -> Column:
    """COIN-EXPIRY-STRIKE-TYPE to its parts."""
    p = F.split(name, "-")
    return F.struct(F.get(p, 0).alias("coin"), F.get(p, 1).alias("expiry"),
                    F.get(p, 2).cast("double").alias("strike"),
                    F.when(F.get(p, F.size(p) - 1) == "C", "call").otherwise("put").alias("kind"))


def make_signal(kind: Column, strength: Column, text: Column, metadata: Column | None = None) -> Column:
    meta = metadata if metadata is not None else F.create_map().cast("map<string,double>")
    return F.struct(kind.alias("type"), clip(strength, 0.0, 1.0).alias("strength"), text.alias("description"),
                    meta.alias("metadata"))


# ---- order-book arrays: array<struct<price,qty>>, best level first ----

def fold(arr: Column, fn) -> Column:
    return F.aggregate(arr, F.lit(0.0), fn)


def qty_sum(levels: Column) -> Column:
    return fold(levels, lambda acc, x: acc + x["qty"])


def depth_n(levels: Column, n: int) -> Column:
    return qty_sum(F.slice(levels, 1, n))


def imbalance(bid: Column, ask: Column) -> Column:
    return safe_div(bid - ask, bid + ask)


def hhi(*sides: Column, n: int = 10) -> Column:
    """Sum of squared quantity shares over the first n levels of each side."""
    q = F.concat(*[F.slice(s, 1, n) for s in sides])
    total = qty_sum(q)
    return safe_div(fold(q, lambda acc, x: acc + x["qty"] * x["qty"]), total * total)


def level_vwap(*sides: Column, n: int = 10) -> Column:
    q = F.concat(*[F.slice(s, 1, n) for s in sides])
    return safe_div(fold(q, lambda acc, x: acc + x["price"] * x["qty"]), qty_sum(q))


def array_slope(xs: Column, ys: Column) -> Column:
    """Least-squares slope of ys on xs (0 when undefined)."""
    n = F.size(xs).cast("double")
    sx, sy = fold(xs, lambda a, x: a + x), fold(ys, lambda a, x: a + x)
    sxy = fold(F.zip_with(xs, ys, lambda x, y: x * y), lambda a, x: a + x)
    sxx = fold(xs, lambda a, x: a + x * x)
    return F.when(n < 2, 0.0).otherwise(safe_div(n * sxy - sx * sy, n * sxx - sx * sx))


def cumulative_qty(levels: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(levels)), lambda i: qty_sum(F.slice(levels, F.lit(1), i)))


def array_mean(arr: Column) -> Column:
    return safe_div(fold(arr, lambda a, x: a + x), F.size(arr).cast("double"))


def array_std_pop(arr: Column) -> Column:
    m = array_mean(arr)
    return F.sqrt(safe_div(fold(arr, lambda a, x: a + (x - m) * (x - m)), F.size(arr).cast("double")))


def json_levels(text: Column) -> Column:
    """[[price, qty], ...] JSON to levels; NULL when malformed."""
    raw = F.from_json(text, T.ArrayType(T.ArrayType(T.DoubleType())))
    return F.transform(raw, lambda p: F.struct(F.get(p, 0).alias("price"), F.get(p, 1).alias("qty")))


def json_valid(text: Column) -> Column:
    return F.coalesce(F.size(F.from_json(text, T.ArrayType(T.StringType()))) >= 0, F.lit(False)) & text.isNotNull()


# ---- derived columns of the raw streams ----

def with_spread(df: DataFrame, bid: str = "bid_price", ask: str = "ask_price") -> DataFrame:
    mid = (C(bid) + C(ask)) / 2
    return df.withColumns({"mid": mid, "spread": C(ask) - C(bid),
                           "spread_bps": F.when(mid > 0, (C(ask) - C(bid)) / mid * 10000).otherwise(0.0)})


def with_quote_value(df: DataFrame, price: str = "price", qty: str = "quantity", out: str = "quote_value") -> DataFrame:
    return df.withColumn(out, C(price) * C(qty))


def with_basis(df: DataFrame, mark: str = "mark_price", index: str = "index_price") -> DataFrame:
    return df.withColumns({"basis": F.coalesce(C(mark) - C(index), F.lit(0.0)),
                           "basis_pct": F.when(C(index) > 0, (C(mark) - C(index)) / C(index) * 100).otherwise(0.0)})


def with_funding_pct(df: DataFrame, rate: str = "funding_rate") -> DataFrame:
    return df.withColumns({"funding_pct": C(rate) * 100, "annualized_pct": C(rate) * 3 * 365 * 100})


def with_taker_pct(df: DataFrame, taker: str = "taker_buy_volume", volume: str = "volume") -> DataFrame:
    return df.withColumn("taker_buy_pct", F.when((C(volume) > 0) & (C(taker) != 0), C(taker) / C(volume) * 100))


def with_book_totals(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    b, a = C(bids)[0]["price"], C(asks)[0]["price"]
    mid = (a + b) / 2
    out = df.withColumns({"total_bid_depth": qty_sum(C(bids)), "total_ask_depth": qty_sum(C(asks))})
    return out.withColumns({"bid_ask_ratio": safe_div(C("total_bid_depth"), C("total_ask_depth")),
                            "spread": a - b, "mid_price": mid, "spread_pct": safe_div(a - b, mid) * 100})


def with_value_usd(df: DataFrame, price: str = "price", qty: str = "quantity") -> DataFrame:
    return with_quote_value(df, price, qty, "value_usd")


def with_est_profit(df: DataFrame, spread_pct: str = "spread_pct") -> DataFrame:
    """Profit per 10 000 USD traded."""
    return df.withColumn("est_profit_usd", C(spread_pct) * 100)


# Field names used by two venues for price and ticker messages.
FIELD_NAMES = {
    ("binance", "price"): {"p": "price", "q": "quantity", "T": "timestamp"},
    ("binance", "ticker"): {"c": "close", "h": "high", "l": "low", "v": "volume"},
    ("bybit", "price"): {"price": "price", "size": "quantity", "time": "timestamp"},
    ("bybit", "ticker"): {"lastPrice": "close", "highPrice24h": "high", "lowPrice24h": "low"},
}


def normalize_fields(df: DataFrame, exchange: str, data_type: str) -> DataFrame:
    names = FIELD_NAMES.get((exchange, data_type), {})
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def normalize_symbol(df: DataFrame, mapping: DataFrame, symbol: str = "symbol", exchange: str = "exchange") -> DataFrame:
    """Venue spelling of each symbol from a (exchange, symbol, venue_symbol) dimension."""
    return (df.join(mapping.withColumnsRenamed({"symbol": symbol, "exchange": exchange}), [exchange, symbol], "left")
            .withColumn("venue_symbol", F.coalesce("venue_symbol", symbol)))


# ---- filters ----

def lookback(df: DataFrame, ts: str, interval: str, as_of=None) -> DataFrame:
    """Rows of the last ``interval`` up to ``as_of`` (default: the newest row, as a scalar subquery)."""
    now = F.lit(as_of) if as_of is not None else df.select(F.max(ts)).scalar()
    out = df.where(C(ts) >= now - F.expr(f"INTERVAL {interval}"))
    return out.where(C(ts) <= F.lit(as_of)) if as_of is not None else out


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.where(C(ts).between(F.lit(start), F.lit(end)))


def filter_side(df: DataFrame, side: str | None, column: str = "side") -> DataFrame:
    return df if side is None else df.where(F.lower(column) == side.lower())


def min_value(df: DataFrame, column: str, least: float) -> DataFrame:
    return df.where(C(column) >= least)


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(C(column) > 0)


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def by_market(df: DataFrame, market: str, column: str = "market_type") -> DataFrame:
    return df.where(C(column) == market)
