"""Schemas of the raw market streams and of the stored feature tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = "symbol string, exchange string, market_type string"
LEVELS = "array<struct<price:double,qty:double>>"


def _stream(columns: str, time: str = "ts timestamp_ntz") -> T.StructType:
    return T._parse_datatype_string(f"{KEYS}, {time}, {columns}")


def _doubles(names: str) -> str:
    return ", ".join(f"{n} double" for n in names.split())


def raw_schemas() -> dict[str, T.StructType]:
    return {
        "prices": _stream(_doubles("mid_price bid_price ask_price spread spread_bps")),
        "orderbooks": _stream(f"bids {LEVELS}, asks {LEVELS}, " + _doubles(
            "total_bid_depth total_ask_depth bid_ask_ratio spread spread_pct mid_price")),
        "trades": _stream("trade_id string, " + _doubles("price quantity quote_value")
                          + ", side string, is_buyer_maker boolean"),
        "mark_prices": _stream(_doubles("mark_price index_price basis basis_pct funding_rate annualized_rate")),
        "funding_rates": _stream(_doubles("funding_rate funding_pct annualized_pct")
                                 + ", next_funding_time timestamp_ntz, countdown_secs int"),
        "open_interest": _stream(_doubles("open_interest open_interest_usd oi_change_1h oi_change_pct_1h")),
        "ticker_24h": _stream(_doubles("volume_24h quote_volume_24h") + ", trade_count_24h int, " + _doubles(
            "high_24h low_24h open_24h last_price price_change price_change_pct vwap_24h")),
        "candles": _stream("close_time timestamp_ntz, interval string, " + _doubles(
            "open high low close volume quote_volume") + ", trade_count int, " + _doubles(
            "taker_buy_volume taker_buy_quote taker_buy_pct"), "open_time timestamp_ntz"),
        "liquidations": _stream("side string, " + _doubles("price quantity value_usd") + ", is_large boolean"),
        "arbitrage_opportunities": T._parse_datatype_string(
            "symbol string, ts timestamp_ntz, buy_exchange string, sell_exchange string, "
            + _doubles("buy_price sell_price spread_pct est_profit_usd")),
    }


FEATURE_COLUMNS = {
    "price": "mid_price last_price bid_price ask_price spread spread_bps microprice weighted_mid_price "
             "bid_depth_5 bid_depth_10 ask_depth_5 ask_depth_10 total_depth_10 depth_imbalance_5 "
             "depth_imbalance_10 weighted_imbalance price_change_1m price_change_5m",
    "trade": "trade_count_1m trade_count_5m volume_1m volume_5m quote_volume_1m quote_volume_5m buy_volume_1m "
             "sell_volume_1m buy_volume_5m sell_volume_5m volume_delta_1m volume_delta_5m cvd_1m cvd_5m cvd_15m "
             "vwap_1m vwap_5m avg_trade_size large_trade_count large_trade_volume",
    "flow": "buy_sell_ratio taker_buy_ratio taker_sell_ratio aggressive_buy_volume aggressive_sell_volume "
            "net_aggressive_flow flow_imbalance flow_toxicity absorption_ratio sweep_detected iceberg_detected "
            "momentum_flow",
    "funding": "funding_rate funding_rate_pct annualized_rate funding_rate_8h_avg funding_rate_24h_avg "
               "funding_rate_7d_avg funding_rate_change funding_rate_zscore funding_premium next_funding_time",
    "oi": "open_interest open_interest_usd oi_change_1h oi_change_4h oi_change_24h oi_change_pct_1h "
          "oi_change_pct_24h oi_delta oi_momentum oi_price_divergence leverage_ratio long_short_ratio",
    "volatility": "volatility_1m volatility_5m volatility_15m volatility_1h volatility_24h realized_volatility "
                  "garman_klass_vol parkinson_vol atr_14 volatility_percentile volatility_zscore "
                  "volatility_regime",
    "momentum": "momentum_1m momentum_5m momentum_15m momentum_1h momentum_4h momentum_24h rsi_14 rsi_divergence "
                "macd_line macd_signal macd_histogram stoch_k stoch_d williams_r cci roc",
    "signals": "trend_signal momentum_signal flow_signal funding_signal oi_signal volatility_signal "
               "composite_score signal_confidence market_regime bias",
    "cross_exchange": "max_price_spread avg_price_spread funding_spread_max funding_spread_avg "
                      "arbitrage_opportunity exchange_flow_divergence lead_lag_score",
}
_TEXT = {"volatility_regime", "market_regime", "bias"}
_TIME = {"next_funding_time"}
_FLAG = {"sweep_detected", "iceberg_detected"}


def feature_schemas() -> dict[str, T.StructType]:
    def typed(name: str) -> str:
        return f"{name} {'string' if name in _TEXT else 'boolean' if name in _FLAG else 'timestamp_ntz' if name in _TIME else 'double'}"
    return {cat: _stream(", ".join(typed(n) for n in names.split())) for cat, names in FEATURE_COLUMNS.items()}


# Which venues list which kind of market, and which streams each kind has.
STREAMS_BY_MARKET = {
    "futures": ["prices", "orderbooks", "trades", "mark_prices", "funding_rates", "open_interest",
                "ticker_24h", "candles", "liquidations"],
    "spot": ["prices", "orderbooks", "trades", "ticker_24h", "candles"],
}
