"""Small hand-made inputs with results worked out by hand or with numpy."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as K
from tickloom.operators import aggregates as A
from tickloom.operators import detectors as D
from tickloom.operators import joins as J
from tickloom.operators import quality as Q
from tickloom.operators import windows as W
from tickloom.plans import composites as P
from tickloom.plans import features as B
from tickloom.plans import institutional as I
from tickloom.sources import schemas, store

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def only(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_buffer_of_ten(spark):
    df = frame(spark, [("a", i, float(i)) for i in range(15)], "k string, i long, x double")
    last = W.buffer_stats(df, ["k"], ["i"], "x", n=10, periods=5).where("i = 14").first()
    assert last["mean"] == 9.5
    assert last["velocity"] == pytest.approx(0.8)
    assert last["percentile"] == 90.0            # nine of 5..14 lie below 14
    assert last["std"] == pytest.approx(np.std(np.arange(5, 15)))


QUOTES = [(50000, 50010, 1.5, 1.2), (50005, 50015, 2.0, 1.0), (50010, 50020, 1.8, 1.5), (50008, 50018, 1.3, 1.8), (50012, 50022, 2.5, 0.8)]


def test_quotes(spark):
    rows = [("s", "e", i, (b + a) / 2, float(b), float(a), bq, aq) for i, (b, a, bq, aq) in enumerate(QUOTES)]
    df = frame(spark, rows, "symbol string, exchange string, event_id long, mid_price double, bid_price double, ask_price double, bid_qty double, ask_qty double")
    r = I.inst_prices(df, order=("event_id",)).where("event_id = 4").first()
    assert r["spread"] == 10 and r["pressure_ratio"] == 1.0
    assert r["microprice"] == pytest.approx((50022 * 2.5 + 50012 * 0.8) / 3.3)
    assert r["bid_pressure"] == 0.5 and r["hurst_exponent"] == 0.5 and r["mid_price_entropy"] == 0.0


def book(spark, bids, asks):
    lv = "array<struct<price:double,qty:double>>"
    return frame(spark, [("s", 1, [(float(p), float(q)) for p, q in bids], [(float(p), float(q)) for p, q in asks])], f"symbol string, ts long, bids {lv}, asks {lv}")


def test_depth_imbalance(spark):
    bids = [(50000 - i, q) for i, q in enumerate([1.0, 2.0, 3.0, 2.5, 1.5, 1, 1, 1, 1, 1])]
    asks = [(50010 + i, q) for i, q in enumerate([1.2, 1.8, 2.3, 1.5, 1.5, 1, 1, 1, 1, 1])]
    r = only(I.inst_orderbook(book(spark, bids, asks)))
    assert r["bid_depth_5"] == 10.0 and r["ask_depth_5"] == pytest.approx(8.3)
    assert r["depth_imbalance_5"] == pytest.approx(1.7 / 18.3)
    assert r["add_cancel_ratio"] == 1.0 and r["absorption_ratio"] == 0.0


def test_trade_delta(spark):
    sizes = [(0.5, "buy"), (1.0, "buy"), (0.3, "sell"), (0.8, "buy"), (2.0, "buy"), (0.4, "sell"), (0.6, "sell"), (5.0, "buy")]
    rows = [("s", "e", i, T0 + timedelta(seconds=i), 100.0 + i, q, s, None) for i, (q, s) in enumerate(sizes)]
    df = frame(spark, rows, "symbol string, exchange string, trade_id long, ts timestamp_ntz, price double, quantity double, side string, is_buyer_maker boolean")
    r = only(I.inst_trades(df))
    assert r["buy_volume"] == pytest.approx(9.3) and r["sell_volume"] == pytest.approx(1.3)
    assert r["cvd"] == pytest.approx(8.0) and r["sweep_detected"] is True


def test_funding_carry(spark):
    rates = [0.0001, 0.00015, 0.0002, 0.00025, 0.0003]
    df = frame(spark, [("s", "e", i, at(i), r) for i, r in enumerate(rates)], "symbol string, exchange string, event_id long, ts timestamp_ntz, funding_rate double")
    r = I.inst_funding(df, ["e"]).where("event_id = 4").first()
    assert r["funding_carry_yield"] == pytest.approx(0.3285)
    assert r["funding_regime"] == "positive"


def test_position_intent(spark):
    seq = [(100000, 50000), (102000, 50200), (105000, 49800), (103000, 49500), (101000, 50000)]
    df = frame(spark, [("s", "e", i, at(i), float(o), float(p), 1.0) for i, (o, p) in enumerate(seq)],
               "symbol string, exchange string, event_id long, ts timestamp_ntz, open_interest double, price double, long_short_ratio double")
    got = [r["position_intent"] for r in I.inst_oi(df).orderBy("event_id").collect()]
    assert got == ["neutral", "long_accumulation", "short_accumulation", "long_liquidation", "short_liquidation"]


def test_price_validation(spark):
    rows = [("s", "a", at(0), 50000.0), ("s", "b", at(1), 50010.0), ("s", "c", at(2), -100.0)]
    df = frame(spark, rows, "symbol string, exchange string, ts timestamp_ntz, mid_price double")
    got = {r["exchange"]: (r["valid"], r["issues"]) for r in Q.validate_prices(df).collect()}
    assert got["a"] == (True, []) and got["c"] == (False, ["invalid_price", "price_deviation"])


@pytest.mark.parametrize("bids,asks,issues", [
    ([(50000, 1), (49999, 1), (49998, 1)], [(50001, 1), (50002, 1), (50003, 1)], []),
    ([(50002, 1), (49999, 1), (49998, 1)], [(50001, 1), (50002, 1), (50003, 1)], ["crossed_book"]),
    ([(50000, 1), (50001, 1)], [(50002, 1), (50003, 1), (50004, 1)], ["insufficient_bids", "unsorted_bids"])])
def test_book_validation(spark, bids, asks, issues):
    assert only(Q.validate_books(book(spark, bids, asks)))["issues"] == issues


def test_cross_exchange_consistent(spark):
    df = frame(spark, [("s", e, at(0), p) for e, p in zip("abc", (50000.0, 50010.0, 49990.0))], "symbol string, exchange string, ts timestamp_ntz, mid_price double")
    assert Q.cross_exchange_outliers(df).count() == 0


@pytest.mark.parametrize("value,expected", [(100.0, False), (150.0, True)])
def test_point_anomaly(spark, value, expected):
    xs = [100.0, 101.0, 99.0, 100.5, 99.5] * 2 + [value]
    df = frame(spark, [("a", i, x) for i, x in enumerate(xs)], "k string, i long, x double")
    r = Q.point_anomaly(df, ["k"], ["i"], "x").where("i = 10").first()
    assert r["is_anomaly"] is expected


def test_conversion_rules():
    assert A.check_conversion("1m", "5m") == 5
    with pytest.raises(ValueError):
        A.check_conversion("1h", "5m")


def test_fill_rules(spark):
    df = frame(spark, [("a", at(0), 1.0), ("a", at(3), 4.0)], "k string, ts timestamp_ntz, value double")
    with pytest.raises(ValueError):
        Q.interpolate(df, ["k"], 60, "linear", "trades")
    got = [(r["value"], r["filled"]) for r in Q.interpolate(df, ["k"], 60, "linear").orderBy("ts").collect()]
    assert got == [(1.0, False), (2.0, True), (3.0, True), (4.0, False)]
    flat = [r["value"] for r in Q.interpolate(df, ["k"], 60, "forward_fill").orderBy("ts").collect()]
    assert flat == [1.0, 1.0, 1.0, 4.0]


def test_cascade_gap_is_inclusive(spark):
    times = [T0, T0 + timedelta(minutes=5), T0 + timedelta(minutes=9, seconds=59)]
    df = frame(spark, [("s", t, 10.0, "long", 1.0) for t in times], "symbol string, ts timestamp_ntz, value_usd double, side string, price double")
    assert only(W.cascades(df, ["symbol"]))["liquidation_count"] == 3


def test_cusum_recursion(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    x[120:] += 1.5
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, value double")
    got = [(r["cusum_pos"], r["cusum_neg"]) for r in D.anomalies_cusum(df, ["k"], ["i"], drift=0.2).orderBy("i").collect()]
    z = (x - x.mean()) / x.std(ddof=1)
    p = n = 0.0
    for i in range(200):
        if i:
            p, n = max(0.0, p + z[i] - 0.2), max(0.0, n - z[i] - 0.2)
        assert got[i] == pytest.approx((p, n), abs=1e-9)


def test_weeks_start_on_monday(spark):
    df = frame(spark, [(datetime(2024, 1, 2),)], "ts timestamp_ntz")
    assert only(df.select(K.bucket("ts", "7 days").alias("w")))["w"] == datetime(2024, 1, 1)


def test_asof_ties_and_tolerance(spark):
    left = frame(spark, [("s", at(10), 1), ("s", at(20), 2)], "symbol string, ts timestamp_ntz, id long")
    right = frame(spark, [("s", at(10), 5.0), ("s", at(12), 6.0)], "symbol string, ts timestamp_ntz, v double")
    got = {r["id"]: r["v"] for r in J.asof_join(left, right, "symbol").collect()}
    assert got == {1: 5.0, 2: 6.0}
    near = {r["id"]: r["v"] for r in J.asof_join(left, right, "symbol", tolerance_s=60).collect()}
    assert near == {1: 5.0, 2: None}


def test_kendall_counts_match_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 133):
        x = rng.integers(0, 9, n).astype(float)
        d = np.sign(x[None, :] - x[:, None])[np.triu_indices(n, 1)]
        assert J.kendall_counts(x) == ((d > 0).sum(), (d < 0).sum(), (d == 0).sum())


def test_signal_weights_and_missing_inputs(spark):
    df = frame(spark, [(1, (0.5,), (0.4, 0.2))], "id int, orderbook struct<absorption_ratio:double>, trades struct<flow_toxicity:double,cvd_price_divergence:double>")
    f = P.Feed(df)
    s = only(f.finish(s=P.smart_money_index(f)))["s"]
    # whale activity counts as 0 when nothing is known of it, as a known part
    assert s["value"] == pytest.approx(0.5 * 0.25 + 0.0 * 0.3 + 0.4 * 0.2 + 0.2 * 0.25) and s["confidence"] == 1.0
    none = frame(spark, [(1, (None,))], "id int, orderbook struct<absorption_ratio:double>")
    f = P.Feed(none)
    assert only(f.finish(s=P.squeeze_probability(f)))["s"] is None
    for w in (P.SMART_MONEY, P.SQUEEZE, P.MARKET_MAKER, P.CASCADE, B.SIGNAL_WEIGHTS):
        assert sum(w.values()) == pytest.approx(1.0)


def test_quarantine_halves_are_the_input(spark):
    df = frame(spark, [(i, float(i % 7)) for i in range(50)], "id long, x double")
    good, bad = Q.quarantine(df, {"low": F.col("x") < 2, "high": F.col("x") > 5})
    assert good.count() + bad.count() == 50 and good.join(bad, "id").count() == 0


def test_ten_level_books_round_trip(spark):
    b = book(spark, [(99999 - 10 * i, 1 + 0.1 * i) for i in range(10)], [(100001 + 10 * i, 1.0) for i in range(10)])
    again = only(store.cols_to_book(store.book_to_cols(b)))
    assert [tuple(x) for x in again["bids"]] == [tuple(x) for x in only(b)["bids"]]


def test_schemas_cover_all_streams(spark, tmp_path):
    assert len(schemas.raw_schemas()) == 10 and len(schemas.feature_schemas()) == 9
    made = store.create_tables(spark, str(tmp_path), {"candles": schemas.raw_schemas()["candles"]}, prefix="t_")
    assert made == ["t_candles"] and spark.table("t_candles").count() == 0
    spark.sql("DROP TABLE t_candles")


def test_table_names():
    assert store.resolve("btcusdt_binance_futures_open_interest")["stream"] == "open_interest"
    with pytest.raises(ValueError):
        store.resolve("btcusdt")
