"""Registered queries against their SQL at the smallest scale (all of them: python tests/parity.py)."""
import pytest

from tests.parity import compare
from tickloom import checks

SAMPLE = ["s1_read_stream", "p12_book_totals", "j5_asof_join", "j7_match_forecasts", "a7_ohlc", "a15_liquidation_heatmap", "a21_oi_price_divergence",
          "w6_time_sums", "w9_cascades", "t6_large_trades", "b1_price_features", "b8_volatility_features", "i4_inst_trades", "i11_inst_ticker",
          "c7_cascade_risk", "c21_recommend", "l4_trade_aggression", "l17_institutional_pressure", "m6_anomaly_job", "m28_drift_psi",
          "q4_validate_vs_history", "x3_stream_candles", "x9_stream_join"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, tiny, name):
    status, note, _ = compare(spark, tiny, name, checks.queries()[name], checks.oracle_sql()[name])
    assert status == "ok", note


def test_signals_to_recommendations(spark, tiny):
    """All fifteen signals side by side, ranked and turned into one recommendation per update."""
    from tickloom.checks.composites import cache
    from tickloom.checks.streams import Tables
    from tickloom.plans import composites as P
    rows = P.signal_rows(P.all_signals(cache(Tables(spark, tiny))))
    out = P.recommend(P.correlation_penalty(P.rank_signals(rows))).select("market_bias", "bias_confidence", "strength", "entry_bias").collect()
    assert len(out) == 1000
    assert all(0 <= r["bias_confidence"] <= 1 and r["entry_bias"] in ("wait", "conservative", "aggressive") for r in out)


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).columns == ["exchange", "bucket", "open", "high", "low", "close", "ticks"]


def test_names_are_unique_and_sql_belongs_to_queries():
    assert set(checks.oracle_sql()) <= set(checks.queries())
    assert len(checks.queries()) > 250
