"""Times the headline queries: warm median of three runs each, one JSON line."""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom import checks  # noqa: E402
from tickloom.session import build_session  # noqa: E402

HEADLINE = [
    "a1_trade_summary", "a5_quartiles", "a7_ohlc", "a8_trade_candles", "a10_volume_profile", "a15_liquidation_heatmap", "a20_vwap", "a21_oi_price_divergence",
    "a26_feature_statistics", "a27_feature_correlation", "j5_asof_join", "j6_feature_cache", "j7_match_forecasts", "j10_lag_pairs", "w2_running_sum", "w4_buffer_stats",
    "w6_time_sums", "w9_cascades", "t2_latest_n_per", "t6_large_trades", "b1_price_features", "b2_trade_features", "b3_flow_features", "b6_funding_features",
    "b9_momentum_features", "i1_inst_prices", "i2_inst_orderbook", "i4_inst_trades", "i7_inst_oi", "i11_inst_ticker", "c1_smart_money_index", "c7_cascade_risk",
    "c14_regime_transition", "c21_recommend", "l4_trade_aggression", "l10_price_leadership", "l21_market_intelligence", "m2_iqr_global", "m3_cusum", "m6_anomaly_job",
    "m8_changepoints_binseg", "m14_decompose", "m19_forecast", "m27_drift_ks", "m28_drift_psi", "q1_validate_prices", "q4_validate_vs_history", "q7_interpolate",
    "x3_stream_candles", "x7_stream_cvd"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cores}]", int(cores), **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = checks.queries(), {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
