"""Values and sizes that a former version failed on."""
import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.checks import queries
from tickloom.streaming import jobs as X

T0 = datetime(2024, 1, 1)


def events(folder, rows):
    """A table of events (minutes, user, type, value) as the queries read it."""
    made = [(i, T0 + timedelta(minutes=m), u, kind, float(v), '{"k": 3}') for i, (m, u, kind, v) in enumerate(rows)]
    pdf = pd.DataFrame(made, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"})
    pdf.to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.fixture
def with_zeros(tmp_path):
    """Venue b's price is 0 within the first six hours and its last one of the second six."""
    rows = [(1, 0, "a", 50), (2, 0, "b", 0), (3, 0, "b", 40), (400, 0, "a", 50), (410, 0, "b", 0), (800, 0, "a", 50), (810, 0, "b", 51), (5000, 0, "a", 1)]
    return events(tmp_path, rows)


def test_basis_arb_with_a_price_of_zero(spark, with_zeros):
    got = {r.bucket.hour: r for r in queries()["i10_basis_arb"](spark, with_zeros).collect()}
    assert set(got) == {0, 6, 12} and math.isnan(got[6].basis_spread) and got[6].long_basis_exchange == "b" and got[6].arbitrage_opportunity
    assert not math.isnan(got[0].basis_spread) and not math.isnan(got[12].basis_spread)


def test_basis_history_with_a_price_of_zero(spark, with_zeros):
    [got] = queries()["l31_basis_history"](spark, with_zeros).collect()
    assert got.data_points == 8 and math.isnan(got.avg_basis_rate_pct) and not math.isnan(got.current_basis_rate_pct) and math.isfinite(got.avg_basis)


def test_divergence_with_a_price_of_zero(spark, with_zeros):
    got = {r.bucket.hour: r.divergence_pct for r in queries()["x13_stream_divergence"](spark, with_zeros).collect()}
    assert got[0] == math.inf and got[6] == math.inf and abs(got[13] - 2) < 1e-9


def test_stream_join_keeps_times_apart(spark, tmp_path):
    """Pairs at most a minute apart, both ends included; a key of the state holds the rows of one minute, not all of a venue."""
    at = [0, 59, 60, 61, 120, 121, 300, 359, 360, 420, *range(1000, 9000, 37)]
    pdf = pd.DataFrame({"event_id": range(len(at)), "ts": [T0 + timedelta(seconds=s) for s in at], "exchange": "a"}).astype({"ts": "datetime64[us]"})
    (folder := tmp_path / "in").mkdir()
    pdf.to_parquet(folder / "x.parquet", index=False)
    source = lambda: X.stream_source(spark, str(folder), spark.read.parquet(str(folder)).schema)
    left = X.with_watermark(source(), delay="1 day")
    right = X.with_watermark(source().select("exchange", F.col("ts").alias("other_ts"), F.col("event_id").alias("other")), "other_ts", "1 day")
    joined, cp = X.stream_join(left, right, ["exchange"], "ts", "other_ts", 60), str(tmp_path / "cp")
    X.run_once(joined, str(tmp_path / "out"), checkpoint=cp)
    got = [(r.event_id, r.other) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if abs(a - b) <= 60]
    held = spark.read.format("statestore").option("path", cp).option("joinSide", "right").load()
    assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 4
