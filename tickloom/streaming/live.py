"""Composite signals live: the newest features of every stream and the history that signals look back at, in event order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tickloom.plans import composites as P
from tickloom.streaming.ordered import AT, BUFFER, LAST, Waiting, _plain, idle_micros, in_event_order, stretches

C = F.col
RANK, GONE = "stream_rank", "key_gone"
#: What a row brings to the history, and what it gets from it.
NOW = {"now_squeeze": "squeeze_probability", "now_hunt": "stop_hunt_probability", "now_quality": "momentum_quality", "now_money": "smart_money_index"}
SEEN = {"last_squeeze": "_sq", "last_hunt": "_sh", "weakening": "_weak", "baseline": "_base"}


def _flat(stream: str, field: str) -> str:
    return f"{stream}__{field}"


def _kept(column: np.ndarray, before) -> np.ndarray:
    """The newest known value at every row, ``before`` at first."""
    at = np.maximum.accumulate(np.where(np.isnan(column), 0, np.arange(1, len(column) + 1)))
    return np.concatenate([[np.nan if before is None else before], column])[at]


def look_back(state: tuple | None, squeeze: np.ndarray, hunt: np.ndarray, quality: np.ndarray, money: np.ndarray) -> tuple[tuple, dict]:
    """Newest known squeeze and stop-hunt values, fall of the momentum quality and mean of the money index, at every row.

    The state holds the two values and the last ten of the two series; unknown values are NaN.
    """
    sq, sh, mq, sm = state or (None, None, [], [])
    sq, sh = _kept(squeeze, sq), _kept(hunt, sh)
    pad = lambda past, new: np.concatenate([np.full(10 - len(past), np.nan), np.array(past, dtype=float), new])
    q, m = pad(mq, quality), pad(sm, money)
    eleven = np.lib.stride_tricks.sliding_window_view(q, 11)
    weak = np.where(np.isnan(eleven).any(axis=1), 0.0, eleven[:, 1:6].mean(axis=1) - eleven[:, 6:].mean(axis=1))
    ten = np.lib.stride_tricks.sliding_window_view(m, 10)[1:]
    known = np.count_nonzero(~np.isnan(ten), axis=1)
    base = np.where(known >= 10, ten.mean(axis=1), np.where(known > 5, 0.3, np.nan))
    listed = lambda x: _plain(pd.Series(x[-10:]))
    return ((*_plain(pd.Series([sq[-1], sh[-1]])), listed(q), listed(m)),
            {"last_squeeze": sq, "last_hunt": sh, "weakening": weak, "baseline": base})


class Recent(StatefulProcessor):
    """History of a key. Its rows come from ``in_event_order``, batch after batch in event order, so no row has to wait here.

    A row with ``key_gone`` tells that the key has left the state before; it leaves this one too.
    """

    SCHEMA = T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("squeeze", "hunt")],
                           *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("quality", "money")], T.StructField(LAST, T.LongType())])

    def __init__(self, keys: list[str], rows: T.StructType, order: list[str], idle_us: int):
        self.keys, self.rows, self.order, self.idle_us = keys, rows, order, idle_us

    def init(self, handle) -> None:
        self.state = handle.getValueState("recent", self.SCHEMA)
        self.waiting = Waiting(handle, self.rows, self.order)

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows of the batch by time, tie and rank. Up to BUFFER of them are sorted in memory; more pass the state, slice by slice."""
        held = []
        for pdf in rows:
            held.append(pdf)
            if sum(map(len, held)) > BUFFER:
                self.waiting.add(chain(held, rows))
                return self.waiting.due(None, [])
        return self.waiting.sorted(pa.concat_tables([self.waiting.table(pdf) for pdf in held]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gone, taken = None, False
        held = tuple(self.state.get()) if self.state.exists() else None
        state, last = (held[:-1], held[-1]) if held else (None, None)
        for pdf in self._in_order(rows):
            left = pdf[GONE].to_numpy(bool)
            if left.any():
                gone = int(pdf[AT][left].max())
                pdf = pdf[~left]
            for part in stretches(pdf, self.idle_us) if len(pdf) else ():
                if last is not None and int(part[AT].iloc[0]) - last > self.idle_us:
                    state = None
                state, more = look_back(state, *(part[c].to_numpy(float) for c in NOW))
                last, taken = int(part[AT].iloc[-1]), True
                yield part.drop(columns=[*NOW, GONE]).assign(**dict(zip(self.keys, key)), **more)
        if gone is not None and (last is None or gone > last):
            self.state.clear()
        elif taken:
            self.state.update((*state, last))


def stream_cache(updates: DataFrame, keys=("symbol", "exchange"), ts: str = "ts", tie: str = "event_id", idle: str = "7 days") -> DataFrame:
    """The newest features of every stream at each update, flat (``stream__field``, flags as 0 and 1), with the update's time in ``at_micros``.

    See ``stream_signals``. A key that leaves the state puts out one row with ``key_gone`` and no features.
    """
    kinds = {f.name: {g.name: g.dataType for g in f.dataType.fields} for f in updates.schema.fields if f.name in P.FIELDS}
    # flags travel as numbers: a column of them with unknown ones would be Python objects
    flat = {_flat(s, n): "string" if k == T.StringType() else "double" for s, fs in kinds.items() for n, k in fs.items()}
    brings = {s: f"{s}__brought" for s in kinds}
    rank = F.coalesce(*[F.when(C(s).isNotNull(), i) for i, s in enumerate(kinds)], F.lit(len(kinds)))
    rows = updates.select(*keys, ts, C(tie).cast("long").alias(tie), rank.alias(RANK), *[C(s).isNotNull().alias(b) for s, b in brings.items()],
                          *[C(f"{s}.{n}").cast(flat[_flat(s, n)]).alias(_flat(s, n)) for s, fs in kinds.items() for n in fs])

    def named(key, n: int, columns: dict, gone: bool) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key)}, **columns, GONE: [gone] * n})

    def newest(key, state, pdf):
        held = dict(zip(flat, state)) if state else dict.fromkeys(flat)
        place, out = np.arange(1, len(pdf) + 1), {AT: pdf[AT].to_numpy(), tie: pdf[tie].to_numpy(), RANK: pdf[RANK].to_numpy()}
        for s, fs in kinds.items():
            at = np.maximum.accumulate(np.where(pdf[brings[s]].astype(bool), place, 0))
            for name in (_flat(s, n) for n in fs):
                out[name] = (np.concatenate([[np.nan if held[name] is None else held[name]], pdf[name].to_numpy(float)]) if flat[name] == "double"
                             else np.array([held[name], *_plain(pdf[name])], dtype=object))[at]
        return tuple(_plain(pd.Series([out[name][-1]]))[0] for name in flat), named(key, len(pdf), out, False)

    def left(key, micros):
        return named(key, 1, {AT: [micros], tie: [0], RANK: [0], **{name: [None] for name in flat}}, True)
    ks = ", ".join(f"{k} {updates.schema[k].dataType.simpleString()}" for k in keys)
    columns = ", ".join(f"{n} {k}" for n, k in flat.items())
    return in_event_order(rows, keys, ts, [tie, RANK], newest, columns, f"{ks}, {AT} long, {tie} long, {RANK} int, {columns}, {GONE} boolean", idle, left)


def _wide(df: DataFrame, keep, flags: set[str]) -> DataFrame:
    """One struct per stream again, with ``flags`` as booleans."""
    streams = {s: [c for c in df.columns if c.startswith(f"{s}__")] for s in P.FIELDS}
    field = lambda s, c: (C(c).cast("boolean") if c in flags else C(c)).alias(c[len(s) + 2:])
    return df.select(*keep, *[F.struct(*[field(s, c) for c in cs]).alias(s) for s, cs in streams.items() if cs])


def stream_signals(updates: DataFrame, keys=("symbol", "exchange"), ts: str = "ts", tie: str = "event_id", names=None, idle: str = "7 days") -> DataFrame:
    """All fifteen composite signals (or ``names`` and what they look back at) at every update, live.

    ``updates`` is a stream with a watermark on ``ts`` and one struct column per stream of ``composites.FIELDS``; a struct is NULL in
    rows that bring nothing of its stream, so separate streams are put together by ``unionByName(..., allowMissingColumns=True)``.
    A struct that is there replaces all fields of its stream, NULL ones too; NaN counts as NULL. Updates of a key are taken by time,
    ``tie`` and then by stream; rows that agree in all three have no order. A key starts anew after ``idle`` of silence and then holds no
    state. Rows come out once the watermark has reached them, the same ones however the stream was cut into batches.

    Two keyed states, in sequence: the newest features by time, and behind it the last ten values that three signals need. Between and
    behind them all signals are column expressions, the same as in ``composites.all_signals``.
    """
    wanted = P.wanted_signals(names)
    flags = {_flat(f.name, g.name) for f in updates.schema.fields if f.name in P.FIELDS for g in f.dataType.fields if g.dataType == T.BooleanType()}
    flat = stream_cache(updates, keys, ts, tie, idle)
    if wanted & set(P.NEEDS):
        look = [n for n in NOW.values() if n in wanted]
        f = P.Feed(_wide(flat, flat.columns, flags))
        seen = f.finish(**{n: P.OWN[n](f) for n in look})
        seen = seen.select(*flat.columns, *[(C(f"{n}.value") if n in look else F.lit(None).cast("double")).alias(c) for c, n in NOW.items()])
        kept = [fd for fd in flat.schema.fields if fd.name != GONE]
        out = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in SEEN]])
        flat = seen.groupBy(*keys).transformWithStateInPandas(Recent(list(keys), T.StructType([x for x in seen.schema.fields if x.name not in keys]), [tie, RANK], idle_micros(idle)), out, "append", "None")
    else:
        flat = flat.where(~C(GONE)).withColumns({c: F.lit(None).cast("double") for c in SEEN})
    f = P.Feed(_wide(flat, [*keys, F.timestamp_micros(AT).alias(ts), tie, *[C(c).alias(n) for c, n in SEEN.items()]], flags))
    own = f.finish(**{n: fn(f) for n, fn in P.OWN.items() if n in wanted})
    return P.late_signals(P.Feed(own), wanted).drop(*SEEN.values())
