"""Values that a former shortcut got wrong."""
import itertools
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import detectors as D
from tickloom.operators import models as M
from tickloom.operators import quality as Q
from tickloom.operators import windows as W
from tickloom.plans import layers as L

C = F.col

T0 = datetime(2024, 1, 1)


def metrics(spark, seconds, z=5.0, key="a"):
    return spark.createDataFrame([(key, T0 + timedelta(seconds=s), "z_score", float(z)) for s in seconds], "symbol string, ts timestamp_ntz, metric string, value double")


@pytest.mark.parametrize("max_rows", [None, "7"])
def test_cooldown_counts_from_the_last_firing(spark, max_rows):
    steady = list(range(0, 600, 30))
    jumpy = [0, 59, 60, 61, 119, 121, 300, 359, 361, 420.5, 1000]
    if max_rows:
        spark.conf.set("tickloom.series.maxRows", max_rows)
    try:
        both = metrics(spark, steady).union(metrics(spark, jumpy, key="b"))
        got = Q.triggers(both, ["symbol"]).toPandas()
    finally:
        spark.conf.unset("tickloom.series.maxRows")
    at = {k: sorted((g.ts - pd.Timestamp(T0)).dt.total_seconds()) for k, g in got.groupby("symbol")}
    assert at["a"] == list(range(0, 600, 60))
    want, last = [], None
    for s in jumpy:
        if last is None or s - last >= 60:
            want.append(s)
            last = s
    assert at["b"] == want and set(got.action) == {"quarantine_data"}


def test_time_windows_forget_what_has_left(spark):
    x = [1.0] * 40
    x[5], x[15] = np.inf, 1e17
    rows = [("a", T0 + timedelta(minutes=10 * i), i, v) for i, v in enumerate(x)] + [("b", T0 + timedelta(minutes=10 * i), i, 1.0) for i in range(3)] + [("b", T0, 9, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double")
    got = W.time_sums(df, ["k"], "ts", "id", {"s": "v"}, {"w": 900.0}).orderBy("k", "ts", "id").toPandas()
    a = got[got.k == "a"].s_w.tolist()
    want = [x[i] + (x[i - 1] if i else 0) for i in range(40)]
    assert a == want
    assert got[got.k == "b"].s_w.tolist() == [1.0, 1.0, 2.0, 2.0]


def test_deviation_of_large_prices_keeps_its_digits(spark):
    r = np.random.default_rng(3)
    price = 5e8 + r.normal(0, 1e-3, 400)
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=20 * i), i, float(p)) for i, p in enumerate(price)], "symbol string, ts timestamp_ntz, event_id long, mid_price double")
    got = Q.validate_vs_history(df, ["symbol"], minutes=60).orderBy("event_id").toPandas()
    for i in (50, 200, 399):
        past = price[max(0, i - 180):i]
        assert got["std"][i] == pytest.approx(np.std(past, ddof=1), rel=1e-5) and got.samples[i] == len(past)


def test_regime_looks_at_all_of_the_history(spark):
    r = np.random.default_rng(9)
    n = 900
    ret = r.normal(0, 1, n) * np.where(np.arange(n) < 450, 0.03, 0.001)
    value = 100 * np.exp(np.cumsum(ret))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(value)], "series string, ts long, value double")
    got = D.series_regime(df, ["series"], ["ts"]).orderBy("ts").toPandas().set_index("ts")
    s = pd.Series(value)
    change = s.pct_change().dropna()
    rolling = change.rolling(20).std() * np.sqrt(252)
    for i in (50, 300, 500, 899):
        vol = change.iloc[i - 50:i].std() * np.sqrt(252)
        assert got.vol_percentile[i] == pytest.approx((rolling.iloc[:i] < vol).mean(), abs=1e-12)
    assert got.regime[899] != "HIGH_VOLATILITY" and got.vol_percentile[899] < 0.55



@pytest.mark.parametrize("scale", [1e-14, 1.0, 1e12])
@pytest.mark.parametrize("n", [60, 61])
def test_long_series_have_exact_slopes_at_every_scale(scale, n):
    r = np.random.default_rng(n)
    x = (np.arange(n) * 0.3 + r.normal(0, 1, n)) * scale
    s = sorted((x[j] - x[i]) / (j - i) for i, j in itertools.combinations(range(n), 2))
    direct, searched = M.sen_slope(x, 5000.0), M.sen_slope(x, 5000.0, direct=0)
    assert direct == pytest.approx(searched, rel=1e-9)
    c = 1.959963984540054 * np.sqrt(5000.0)
    assert direct[1:] == pytest.approx((s[int((len(s) - c) / 2)], s[int((len(s) + c) / 2)]))
    line = np.arange(4000) * 1e-14
    assert M.median_slope(line) == pytest.approx(1e-14, rel=1e-6)


def test_levels_are_ranked_by_venue_first(spark):
    def book(venue, i):
        side = lambda base: [(base + 0.1 * j, 10.0 + (j if venue == "x" else 3 * j) * (i % 2)) for j in range(7)]
        return "s", venue, i, side(99.0), side(101.0)
    rows = [book(v, i) for v in "xyz" for i in range(8)] + [book("few", i) for i in range(4)]
    level = "array<struct<price double, qty double>>"
    df = spark.createDataFrame(rows, f"symbol string, exchange string, ts long, bids {level}, asks {level}")
    got = L.orderbook_persistence(df).toPandas()
    assert got.groupby("zone").size().tolist() == [10, 10] and set(got.exchange) == {"x", "y", "z"}
    assert got.groupby(["zone", "exchange"]).size().max() == 5
    assert got.overall_score.nunique() == 1 and got.overall_score[0] == pytest.approx(got.reliability.mean())


def test_scratch_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from tickloom import session

    class Context:
        applicationId, master = "x", "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default
    with pytest.raises(RuntimeError):
        session.scratch_dir(Fake())


def test_signals_read_what_calculators_produce(spark, tiny):
    from tickloom.checks.composites import raw_streams
    from tickloom.checks.institutional import VENUES
    from tickloom.checks.streams import Tables
    from tickloom.plans import composites as P
    seen = P.market_features(raw_streams(Tables(spark, tiny)), every="6 hours", venues=VENUES, cluster_ms=7_200_000)
    assert {s: sorted(seen.schema[s].dataType.fieldNames()) for s in P.FIELDS} == {s: sorted(f) for s, f in P.FIELDS.items()}
    out = P.all_signals(seen, by=["symbol"]).select(
        "symbol", "ts", "event_id", C("orderbook.bid_wall_detected").alias("wall"), C("trades.iceberg_detected").alias("berg"), C("trades.trade_clustering_index").alias("packed"),
        C("orderbook.spread").alias("spread"), C("ticker.volume").alias("volume"), C("smart_money_flow.volume_estimate").alias("estimate"),
        C("arbitrage_opportunity.components.execution_feasibility").alias("feasible"), C("execution_quality.components.low_impact").alias("impact")).toPandas()
    assert not out.duplicated(["symbol", "ts", "event_id"]).any() and len(out) >= 1000
    assert out.spread.dropna().gt(0).all() and out.volume.dropna().gt(0).all() and out.packed.dropna().between(0, 1).all() and out.packed.nunique() > 10
    assert out.estimate.gt(0).any() and out.feasible.eq(1).any() and out.impact.nunique() > 10 and out.wall.notna().any() and out.berg.notna().any()
    with pytest.raises(KeyError):
        P.Feed(seen)("trades.no_such_field")
    assert seen.where(F.col("ticker").isNull()).count() < seen.count()


def test_retention_removes_whole_days_and_upserts_keep_the_first(spark, tmp_path):
    from datetime import date

    from tickloom.sources import store
    rows = [("s", f"2024-01-0{d}", i) for d in range(1, 6) for i in range(3)]
    spark.createDataFrame(rows, "symbol string, day string, v int").write.partitionBy("day").parquet(str(tmp_path / "trades"))
    assert store.retain(spark, str(tmp_path), "trades", date(2024, 1, 3)) == ["2024-01-01", "2024-01-02"]
    left = spark.read.parquet(str(tmp_path / "trades"))
    assert left.count() == 9 and left.agg(F.min("day").cast("string")).first()[0] == "2024-01-03"
    new = spark.createDataFrame([(1, "2024-01-03", 9, 5), (1, "2024-01-03", 2, 7), (2, "2024-01-04", 1, 1), (3, "2024-01-09", 4, 4)], "id int, day string, ts int, v int")
    old = spark.createDataFrame([(2, "2024-01-04"), (8, "2024-01-05")], "id int, day string")
    got = store.upsert_ignore(new, old, ["id", "day"], ["ts"], ["day"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "2024-01-03", 2, 7), (3, "2024-01-09", 4, 4)]
