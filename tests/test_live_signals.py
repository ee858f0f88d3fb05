"""All fifteen signals live: the rows of the batch operator, however the stream was cut, and no state for silent keys."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.checks.composites import INPUTS
from tickloom.operators.joins import feature_cache
from tickloom.plans import composites as P
from tickloom.streaming import jobs as X
from tickloom.streaming.live import look_back, stream_signals

SECONDS, DELAY = 3600, 600
WORDS = {"funding_regime", "position_intent"}


def raw(n=480, seed=3):
    """Updates of one stream each; some fields of some updates are unknown."""
    r = np.random.default_rng(seed)
    return pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime(np.sort(r.integers(0, SECONDS, n)), unit="s").astype("datetime64[us]"), "symbol": "s",
                         "exchange": np.where(r.random(n) < .8, "hot", "b"), "value": r.uniform(0, 100, n), "k": r.integers(0, 101, n),
                         "stream": r.choice(list(INPUTS), n), "unknown": r.random(n) < .1})


def features(df):
    """One struct per stream, NULL in the rows of the others; the first field is unknown in some."""
    def field(i, name, text):
        return (F.when(~F.col("unknown"), F.expr(text)) if i == 0 else F.expr(text)).alias(name)
    return df.select("symbol", "exchange", "ts", "event_id", *[F.when(F.col("stream") == s, F.struct(*[field(i, n, e) for i, (n, e) in enumerate(fs.items())])).alias(s)
                                                              for s, fs in INPUTS.items()])


def stream(spark, folder, pdf, pieces):
    folder.mkdir()
    order = np.argsort(pdf.ts.astype("int64") / 1e6 + np.random.default_rng(0).uniform(0, DELAY / 2, len(pdf))) if pieces > 1 else np.random.default_rng(1).permutation(len(pdf))
    for i, part in enumerate(np.array_split(order, pieces)):
        pdf.iloc[part].to_parquet(folder / f"part-{i}.parquet", index=False)
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return X.with_watermark(X.stream_source(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1), delay=f"{DELAY} seconds")


def rows(df, names):
    """event_id -> the signals' fields, doubles rounded."""
    def plain(v):
        return tuple(map(plain, v)) if isinstance(v, tuple) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return {r[0]: plain(tuple(r[1:])) for r in df.select("event_id", *names).collect()}


@pytest.fixture(scope="module")
def batch(spark):
    """The batch operator's rows that the watermark reaches."""
    pdf = raw()
    made = features(spark.createDataFrame(pdf))
    apart = {s: made.where(F.col(s).isNotNull()).select("symbol", "exchange", "ts", "event_id", f"{s}.*") for s in INPUTS}
    due = set(pdf.event_id[pdf.ts <= pdf.ts.max() - pd.Timedelta(seconds=DELAY)])
    return {k: v for k, v in rows(P.all_signals(feature_cache(apart)), [m[0] for m in P.SIGNAL_META]).items() if k in due}


@pytest.mark.parametrize("pieces", [1, 3, 10])
def test_live_signals_equal_the_batch_operator(spark, tmp_path, batch, pieces):
    pdf, names, want = raw(), [m[0] for m in P.SIGNAL_META], batch
    live = stream_signals(features(stream(spark, tmp_path / "in", pdf, pieces)))
    X.run_once(live, str(tmp_path / "out"))
    got = rows(spark.read.schema(live.schema).parquet(str(tmp_path / "out")), names)
    assert got == want and len(names) == 15
    assert all(any(v[i] is not None for v in got.values()) for i in range(15))


def test_a_silent_key_leaves_both_states(spark, tmp_path):
    """Key b is silent for half an hour, then everything about it is unknown again; at the end only a is held."""
    at = [("b", t) for t in range(0, 600, 60)] + [("a", t) for t in range(0, 4000, 100)] + [("b", 3000), ("b", 3060), ("a", 9000), ("a", 9060)]
    pdf = pd.DataFrame([(i, pd.Timestamp(t + 86400, unit="s"), "s", k, 70.0, 30 + i % 5, "oi" if i % 2 or k == "b" and t >= 3000 else "prices", False) for i, (k, t) in enumerate(at)],
                       columns=["event_id", "ts", "symbol", "exchange", "value", "k", "stream", "unknown"]).astype({"ts": "datetime64[us]"}).sort_values("ts", ignore_index=True)
    folder, cp = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), 6)):
        pdf.iloc[part].to_parquet(folder / f"part-{i}.parquet", index=False)
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    src = X.with_watermark(X.stream_source(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1), delay="30 seconds")
    live = stream_signals(features(src), idle="20 minutes").select("exchange", "ts", F.col("prices").alias("p"), F.col("composite_risk.components.squeeze_risk").alias("sq"))
    X.run_once(live, str(tmp_path / "out"), checkpoint=cp)
    got = spark.read.schema(live.schema).parquet(str(tmp_path / "out")).where("exchange = 'b'").orderBy("ts").collect()
    assert len(got) == 12
    assert all(r["p"]["mid_zscore"] is not None and r["sq"] is not None for r in got[2:10])
    assert all(r["p"]["mid_zscore"] is None for r in got[10:])
    for operator, name in ((1, "state"), (0, "recent")):
        held = spark.read.format("statestore").option("path", cp).option("operatorId", operator).option("stateVarName", name).load()
        assert {r.k for r in held.select(F.col("key.exchange").alias("k")).collect()} == {"a"}


def test_look_back_equals_a_loop():
    r = np.random.default_rng(2)
    x = [np.where(r.random(60) < .15, np.nan, r.random(60)) for _ in range(4)]
    for cuts in ([60], [1, 4, 20, 60], list(range(1, 61))):
        state, parts, start = None, [], 0
        for end in cuts:
            state, more = look_back(state, *[c[start:end] for c in x])
            parts.append(more)
            start = end
        got = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        for i in range(60):
            known = x[0][:i + 1][~np.isnan(x[0][:i + 1])]
            q, m = x[2][max(0, i - 10):i + 1], x[3][max(0, i - 9):i + 1]
            full, n = len(q) == 11 and not np.isnan(q).any(), np.count_nonzero(~np.isnan(m))
            want = {"last_squeeze": known[-1] if len(known) else np.nan, "weakening": q[1:6].mean() - q[6:].mean() if full else 0.0,
                    "baseline": m.mean() if n == 10 else .3 if n > 5 else np.nan}
            assert all(np.isclose(got[c][i], v, equal_nan=True) for c, v in want.items())
