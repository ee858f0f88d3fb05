"""Rows that wait in a state are packed chunks, and a batch of any length passes the second state of the live signals in order."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from tests.test_event_order import Held
from tickloom.streaming import live, ordered


def made(n=4000):
    r = np.random.default_rng(7)
    some = lambda x, share: np.where(r.random(n) < share, x, None)
    return pd.DataFrame({ordered.AT: r.integers(0, 40_000, n) * 1_000_000, "event_id": r.integers(0, 3, n) * 10 + 2 ** 60,
                         **{f"d{i}": np.where(r.random(n) < .1, r.random(n), np.nan) for i in range(40)}, "flag": some(r.random(n) < .5, .3), "word": some("long", .2)})


SCHEMA = T.StructType([T.StructField(ordered.AT, T.LongType()), T.StructField("event_id", T.LongType()), *[T.StructField(f"d{i}", T.DoubleType()) for i in range(40)],
                       T.StructField("flag", T.BooleanType()), T.StructField("word", T.StringType())])


def plain(df):
    return [tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False)]


@pytest.mark.parametrize("buffer", [300, 50_000])
def test_packed_rows_come_back_in_order(monkeypatch, buffer):
    monkeypatch.setattr(ordered, "BUFFER", buffer)
    monkeypatch.setattr(ordered, "ROWS", 500)
    pdf = made()
    waiting = ordered.Waiting(held := Held(), SCHEMA, ["event_id"])
    assert waiting.add(iter([pdf[i:i + 250] for i in range(0, len(pdf), 250)])) == pdf[ordered.AT].min()
    chunks = list(held.maps["waiting"].values())
    assert sum(len(c[0]) for c in chunks) == len(pdf) and all(isinstance(c[2], bytes) for c in chunks)
    if buffer > len(pdf):       # a tenth of the values is known, and so much is kept
        assert sum(len(c[2]) for c in chunks) < .5 * len(pdf) * 42 * 8
    want = pdf.sort_values([ordered.AT, "event_id"], kind="stable")
    later = []
    first = list(waiting.due(20_000_000_000, later))
    assert later == [want[ordered.AT][want[ordered.AT] > 20_000_000_000].min()] and max(map(len, first)) <= 500
    got = pd.concat([*first, *waiting.due(None, [])])
    assert plain(got) == plain(want) and not held.maps["waiting"] and not held.maps["slices"]


@pytest.mark.parametrize("buffer", [200, 50_000])
def test_a_long_batch_passes_the_second_state_in_order(monkeypatch, buffer):
    """Shuffled rows of one key, in memory or through the state: the same as a fold over the sorted rows, with the key's end among them."""
    monkeypatch.setattr(live, "BUFFER", buffer)
    r = np.random.default_rng(8)
    n = 1000
    pdf = pd.DataFrame({ordered.AT: r.permutation(n) * 1_000_000, "event_id": np.arange(n), live.RANK: 0, **{c: r.random(n) for c in live.NOW}, live.GONE: False})
    pdf = pd.concat([pdf, pdf[:1].assign(**{ordered.AT: 2_000_000_000, live.GONE: True})])
    kinds = {ordered.AT: T.LongType(), "event_id": T.LongType(), live.RANK: T.IntegerType(), **dict.fromkeys(live.NOW, T.DoubleType()), live.GONE: T.BooleanType()}
    processor = live.Recent(["symbol"], T.StructType([T.StructField(c, k) for c, k in kinds.items()]), ["event_id", live.RANK], 10 ** 12)
    processor.init(held := Held())
    got = pd.concat(list(processor.handleInputRows(("s",), iter([pdf[i:i + 90] for i in range(0, len(pdf), 90)]), None)))
    want = pdf[~pdf[live.GONE]].sort_values(ordered.AT)
    _, more = live.look_back(None, *(want[c].to_numpy(float) for c in live.NOW))
    assert got[ordered.AT].tolist() == want[ordered.AT].tolist() and (got.symbol == "s").all() and not processor.state.exists()
    assert all(np.allclose(got[c].to_numpy(float), v, equal_nan=True) for c, v in more.items()) and not held.maps["waiting"]
