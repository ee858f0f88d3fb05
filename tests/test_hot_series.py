"""Results must not change when every series is cut into chunks, or when nothing may be broadcast."""
import pytest

from tests.parity import canon, rows
from tickloom import checks

CUT = ["j5_asof_join", "j6_feature_cache", "j8_match_levels", "a5_quartiles", "a12_funding_cumulative", "a33_volume_analysis",
       "w1_lag_change", "w3_rolling", "w4_buffer_stats", "w5_ewma", "w6_time_sums", "w9_cascades", "w10_streak_stats", "w12_arb_windows",
       "q5_point_anomaly", "q7_interpolate", "b1_price_features", "b6_funding_features", "b7_oi_features", "i1_inst_prices", "i2_inst_orderbook",
       "i5_inst_funding", "i7_inst_oi", "i8_inst_liquidations", "m3_cusum", "m4_mad_rolling", "m14_decompose", "m27_drift_ks", "c14_regime_transition"]


def values(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("name", CUT)
def test_cut_series_give_the_same_rows(spark, tiny, name):
    fn = checks.queries()[name]
    plain = values(fn(spark, tiny))
    spark.conf.set("tickloom.series.maxRows", "12")
    try:
        cut = values(fn(spark, tiny))
    finally:
        spark.conf.unset("tickloom.series.maxRows")
    assert len(plain) == len(cut) and plain
    bad = [(a, b) for a, b in zip(plain, cut) if a != b]
    assert not bad, bad[:2]


@pytest.mark.parametrize("name", ["a15_liquidation_heatmap", "t6_large_trades", "w13_final_pct_rank", "m1_zscore_global", "b2_trade_features"])
def test_statistics_join_without_broadcast(spark, tiny, name):
    fn = checks.queries()[name]
    plain = values(fn(spark, tiny))
    spark.conf.set("tickloom.broadcast.maxRows", "0")
    spark.conf.set("tickloom.series.maxRows", "30")
    try:
        wide = values(fn(spark, tiny))
    finally:
        spark.conf.unset("tickloom.broadcast.maxRows")
        spark.conf.unset("tickloom.series.maxRows")
    assert plain == wide and plain


def test_canon_handles_nested_values():
    assert canon([1.5, None, {"a": True}]) == "[1.5,~,{a:True}]"
