"""Keyed state in event order: the batches a stream is cut into leave no trace, and silent keys leave the state."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import windows as W
from tickloom.operators.models import adwin, page_hinkley
from tickloom.streaming import jobs as X

#: An hour of events of two keys in seconds; those of the last ten minutes wait for the watermark.
SECONDS, DELAY = 3600, 600


def events(n=600, seed=4):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime(np.sort(r.integers(0, SECONDS, n)), unit="s").astype("datetime64[us]"), "symbol": "s",
                         "exchange": np.where(r.random(n) < .8, "hot", "b"), "mid_price": r.normal(0, 1, n) + (np.arange(n) > 300) * 4,
                         "side": np.where(r.random(n) < .5, "buy", "sell"), "quantity": r.integers(1, 9, n).astype(float)})


def stream(spark, folder, pdf, pieces, seed=0):
    """The rows in ``pieces`` files, each batch holding rows of times up to five minutes apart from its own."""
    folder.mkdir()
    shuffled = pdf.iloc[np.argsort(pdf.ts.astype("int64") / 1e6 + np.random.default_rng(seed).uniform(0, DELAY / 2, len(pdf)))] if pieces > 1 else pdf.sample(frac=1, random_state=1)
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), pieces)):
        shuffled.iloc[part].to_parquet(folder / f"part-{i}.parquet", index=False)
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = X.stream_source(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1)
    return X.with_watermark(s, delay=f"{DELAY} seconds")


def ran(spark, df, path, checkpoint=None):
    X.run_once(df, str(path), checkpoint=checkpoint)
    return spark.read.schema(df.schema).parquet(str(path)).toPandas()


@pytest.mark.parametrize("pieces", [1, 3, 10])
def test_batches_leave_no_trace(spark, tmp_path, pieces):
    pdf = events()
    due = set(pdf.event_id[pdf.ts <= pdf.ts.max() - pd.Timedelta(seconds=DELAY)])
    d = spark.createDataFrame(pdf)
    signed = d.withColumn("v", F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")))
    want = {r["event_id"]: r["cvd"] for r in W.running_sum(signed, ["symbol", "exchange"], ["ts", "event_id"], "v", "cvd").collect() if r["event_id"] in due}
    s = stream(spark, tmp_path / "in", pdf, pieces).withColumn("trade_id", F.col("event_id"))
    got = ran(spark, X.stream_cvd(s), tmp_path / "cvd")
    assert dict(zip(got.trade_id, got.cvd)) == want and len(got) == len(want)
    want = {r["event_id"]: r for r in W.buffer_stats(d, ["symbol", "exchange"], ["ts", "event_id"], "mid_price", n=20).collect()}
    got = ran(spark, X.stream_buffer_features(s, n=20), tmp_path / "buffer")
    assert set(got.event_id) == due and len(got) == len(due)
    assert all(abs(r.mean - want[r.event_id]["mean"]) < 1e-9 and abs(r.velocity - want[r.event_id]["velocity"]) < 1e-9 for r in got.itertuples(index=False))
    got = ran(spark, X.stream_drift(s, value="mid_price", threshold=50.0), tmp_path / "drift").set_index("event_id")
    for _, one in pdf.groupby("exchange"):
        x = one.mid_price.to_numpy()
        for i, a, b in zip(one.event_id, page_hinkley(x, threshold=50.0), adwin(x)):
            assert i not in due or (got.page_hinkley[i], got.adwin[i]) == (bool(a), bool(b))


def test_a_silent_key_starts_anew_and_a_restart_goes_on(spark, tmp_path):
    """Key b is silent for half an hour; its sum starts anew with a short idle time and goes on with a long one."""
    at = [("b", 0, 1.0), ("b", 60, 2.0), *[("a", t, 1.0) for t in range(0, 4000, 100)], ("b", 3000, 4.0), ("b", 3060, 8.0), ("a", 9000, 1.0)]
    pdf = pd.DataFrame([(i, pd.Timestamp(t + 86400, unit="s"), "s", k, "buy", q) for i, (k, t, q) in enumerate(at)], columns=["trade_id", "ts", "symbol", "exchange", "side", "quantity"]).astype({"ts": "datetime64[us]"})
    folder = tmp_path / "in"
    folder.mkdir()
    first = pdf[pdf.ts < pd.Timestamp(2500 + 86400, unit="s")]
    for i, part in enumerate((first, pdf.drop(first.index))):
        part.to_parquet(folder / f"part-{i}.parquet", index=False)
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    for idle, want in (("20 minutes", [1.0, 3.0, 4.0, 12.0]), ("2 hours", [1.0, 3.0, 7.0, 15.0])):
        out, cp = tmp_path / f"out-{len(idle)}", str(tmp_path / f"cp-{len(idle)}")
        for turn in range(2):      # the second run starts from the checkpoint and adds nothing
            s = X.with_watermark(X.stream_source(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1), delay="30 seconds")
            got = ran(spark, X.stream_cvd(s, idle=idle), out, cp)
        assert got[got.exchange == "b"].sort_values("trade_id").cvd.tolist() == want
        rows = spark.read.format("statestore").option("path", cp).option("stateVarName", "state").load()
        assert {r.k for r in rows.select(F.col("key.exchange").alias("k")).collect()} == ({"a"} if idle == "20 minutes" else {"a", "b"})


def test_last_n_stats_equal_a_loop():
    r = np.random.default_rng(1)
    for n, past, new in ((20, 0, 50), (20, 7, 3), (20, 19, 40), (5, 4, 1), (1, 0, 6), (3, 0, 8)):
        x = r.normal(0, 1, past + new)
        got = X.last_n_stats(x[:past], x[past:], n, 5)
        for k in range(new):
            w = x[max(0, past + k - n + 1):past + k + 1]
            sd = w.std() if len(w) > 1 else 0.0
            want = (w.mean(), sd, (w[-1] - w.mean()) / sd if sd >= 1e-12 else 0.0, (w[-1] - w[-5]) / 5 if len(w) >= 5 else 0.0, (w < w[-1]).mean() * 100)
            assert np.allclose([got[c][k] for c in ("mean", "std", "zscore", "velocity", "percentile")], want)



class Held:
    """State variables of one key, held in dictionaries."""

    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, HeldMap())

    def getValueState(self, name, schema):
        return HeldValue()

    def registerTimer(self, ms):
        self.timers.append(ms)


class HeldMap(dict):
    getValue, containsKey, updateValue, removeKey = dict.__getitem__, dict.__contains__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(self.items())


class HeldValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_fold_takes_a_backlog_in_pieces(monkeypatch):
    """A day of one key in one batch, in any order: no fold sees more rows than it takes at once, no chunk holds more than a slice, nothing is lost."""
    from pyspark.sql import types as T

    from tickloom.streaming import ordered
    monkeypatch.setattr(ordered, "ROWS", 100)
    monkeypatch.setattr(ordered, "BUFFER", 700)
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"event_id": np.arange(3000), ordered.AT: r.integers(0, 86400, 3000) * 1_000_000})
    sizes, seen = [], []

    def fold(key, state, rows):
        sizes.append(len(rows))
        seen.extend(zip(rows[ordered.AT], rows.event_id))
        return (len(seen),), rows
    waiting = T.StructType([T.StructField("event_id", T.LongType()), T.StructField(ordered.AT, T.LongType())])
    processor = ordered.EventOrder(waiting, T.StructType([]), ["event_id"], fold, 10 ** 9)
    processor.init(held := Held())
    list(processor.handleInputRows(("a",), iter([pdf[i:i + 300] for i in range(0, 3000, 300)]), None))
    per_hour = np.bincount(pdf[ordered.AT] // 3_600_000_000)
    assert max(len(c[0]) for c in held.maps["waiting"].values()) <= per_hour.max()
    want = sorted(zip(pdf[ordered.AT], pdf.event_id))
    for mark in (43_000, 43_000, 90_000):
        list(processor.handleExpiredTimer(("a",), Clock(mark * 1000), None))
        assert seen == [x for x in want if x[0] <= mark * 1_000_000] and max(sizes) <= 100
        assert sum(len(c[0]) for c in held.maps["waiting"].values()) == len(want) - len(seen)
    assert not held.maps["slices"] and processor.state.get() == (3000, want[-1][0])
