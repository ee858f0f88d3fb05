"""Keyed state in event order: rows wait for the watermark, so results do not depend on how a stream was cut into batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

#: Event time of a row in microseconds, and of the newest row that a key's state has taken in (no leading underscore: Python rows lack such names).
AT, LAST = "at_micros", "last_micros"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Microseconds of a slice of event time, rows held before they are put into their slices, and rows that a fold takes in at once.
SLICE, BUFFER, ROWS = 3_600_000_000, 50_000, 10_000

#: (key, state or None, rows in event order) -> (state, output rows)
Fold = Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]
#: (key, microseconds at which its idle time is over) -> rows to put out when a key leaves the state
Farewell = Callable[[tuple, int], pd.DataFrame]


class Waiting:
    """Rows of a key in typed state, by slices of event time; a slice is a row of packed chunks, so a value costs no Python object.

    A chunk has the times of its rows and their columns as one compressed Arrow batch.
    """

    def __init__(self, handle, schema: T.StructType, order: list[str]):
        self.order, self.columns = order, to_arrow_schema(schema)
        self.slices = handle.getMapState("slices", "slice long", "chunks int, oldest long")
        self.chunks = handle.getMapState("waiting", "slice long, chunk int", "times array<long>, size long, rows binary")

    def table(self, pdf: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(pdf[self.columns.names], schema=self.columns, preserve_index=False)

    def add(self, parts: Iterator[pd.DataFrame]) -> int | None:
        """Takes rows in, BUFFER rows at a time; the time of the oldest one."""
        held, size, seen = [], 0, {}
        for pdf in parts:
            held, size = [*held, self.table(pdf)], size + len(pdf)
            if size >= BUFFER:
                self._put(pa.concat_tables(held), seen)
                held, size = [], 0
        if size:
            self._put(pa.concat_tables(held), seen)
        for n, (chunks, first) in seen.items():
            self.slices.updateValue((n,), (chunks, first))
        return min((first for _, first in seen.values()), default=None)

    def _put(self, rows: pa.Table, seen: dict[int, tuple[int, int]]) -> None:
        """Rows as a chunk of each slice they lie in; ``seen``: chunks and oldest row of the slices met so far."""
        times = rows[AT].to_numpy()
        order = np.argsort(times // SLICE, kind="stable")
        times, rows = times[order], rows.take(pa.array(order)).combine_chunks()
        number = times // SLICE
        ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), len(times)]
        for i, j in zip([0, *ends], ends):
            n = int(number[i])
            if n not in seen:
                seen[n] = tuple(self.slices.getValue((n,))) if self.slices.containsKey((n,)) else (0, int(times[i]))
            chunks, first = seen[n]
            plain = rows.slice(i, j - i).to_batches()[0].serialize()
            self.chunks.updateValue((n, chunks), (times[i:j].tolist(), plain.size, pa.compress(plain, codec="lz4", asbytes=True)))
            seen[n] = chunks + 1, min(first, int(times[i:j].min()))

    def _take(self, n: int, chunks: int) -> pa.Table:
        """All rows of a slice, which leave the state."""
        got = []
        for i in range(chunks):
            _, size, packed = self.chunks.getValue((n, i))
            got.append(pa.ipc.read_record_batch(pa.decompress(bytes(packed), decompressed_size=size, codec="lz4"), self.columns))
            self.chunks.removeKey((n, i))
        self.slices.removeKey((n,))
        return pa.Table.from_batches(got, self.columns)

    def due(self, mark: int | None, later: list[int]) -> Iterator[pd.DataFrame]:
        """The rows that are due, in order; ``later`` gets the time of the oldest row that is not. Without a mark all are."""
        held, size = [], 0
        for n, (chunks, first) in sorted((k[0], tuple(v)) for k, v in self.slices.iterator()):
            if mark is not None and first > mark:
                later.append(first)
                break
            rows = self._take(n, chunks)
            wait = np.zeros(len(rows), bool) if mark is None else rows[AT].to_numpy() > mark
            if wait.any():
                seen = {}
                self._put(rows.filter(pa.array(wait)), seen)
                self.slices.updateValue((n,), seen[n])
                later.append(seen[n][1])
                rows = rows.filter(pa.array(~wait))
            held, size = [*held, rows], size + len(rows)
            if size >= ROWS:
                yield from self.sorted(pa.concat_tables(held))
                held, size = [], 0
            if later:
                break
        if size:
            yield from self.sorted(pa.concat_tables(held))

    def sorted(self, rows: pa.Table) -> Iterator[pd.DataFrame]:
        by = [AT, *self.order]
        place = rows.select(by).to_pandas().sort_values(by, kind="stable").index.to_numpy()
        rows = rows.take(pa.array(place))
        return (rows.slice(i, ROWS).to_pandas() for i in range(0, len(rows), ROWS))


class EventOrder(StatefulProcessor):
    """Typed state of a key: rows that wait, by slices of event time, and one value of the fold, which a key that falls silent leaves.

    A row waits until the watermark has reached its time; then nothing older can come, and the fold takes in all rows that are due
    by time and tie. A timer stands at the oldest waiting row, or, if none waits, at the end of the idle time after the newest.
    Slices are taken up in order, some ROWS rows at a time, so a long backlog never lies in memory: one slice of one key does.
    """

    def __init__(self, waiting: T.StructType, state: T.StructType, order: list[str], fold: Fold, idle_ms: int, farewell: Farewell | None = None):
        self.waiting_schema, self.state_schema, self.order, self.fold, self.idle_ms = waiting, state, order, fold, idle_ms
        self.farewell = farewell

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, self.waiting_schema, self.order)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = self.waiting.add(rows)
        if oldest is not None:
            self._wake(oldest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get() if self.state.exists() else None
        value, last = (None, None) if held is None else (tuple(held)[:-1], held[-1])
        later, taken = [], False
        for pdf in self.waiting.due(mark, later):
            taken = True
            for part in stretches(pdf, self.idle_ms * 1000):
                if last is not None and int(part[AT].iloc[0]) - last > self.idle_ms * 1000:
                    value = None
                value, out = self.fold(key, value, part)
                last = int(part[AT].iloc[-1])
                yield out
        if taken and later:
            self.state.update((*value, last))
        elif not later and (taken or held is not None):
            yield from self._rest(key, value, last, mark)
        if later:
            self._wake(later[0])

    def _rest(self, key: tuple, value: tuple, last: int, mark: int) -> Iterator[pd.DataFrame]:
        """No row waits: the state stays until the idle time is over."""
        gone = last + self.idle_ms * 1000
        if gone <= mark:
            self.state.clear()
            if self.farewell:
                yield self.farewell(key, gone)
        else:
            self.state.update((*value, last))
            self._wake(gone)

    def _wake(self, micros: int) -> None:
        """A timer fires once the watermark is past it."""
        self.handle.registerTimer(-(-micros // 1000))


def stretches(pdf: pd.DataFrame, idle_us: int) -> Iterator[pd.DataFrame]:
    """Rows between silences, which part a key's rows wherever the batches are cut."""
    ends = [*(np.flatnonzero(np.diff(pdf[AT].to_numpy()) > idle_us) + 1).tolist(), len(pdf)]
    return (pdf if j - i == len(pdf) else pdf.iloc[i:j] for i, j in zip([0, *ends], ends))


def _plain(column: pd.Series) -> list:
    return [None if v is None or v != v else v for v in column.tolist()]


def idle_micros(idle: str) -> int:
    n, unit = idle.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


def in_event_order(df: DataFrame, keys, ts: str, order, fold: Fold, state: str, output: str, idle: str = "7 days",
                   farewell: Farewell | None = None) -> DataFrame:
    """``fold`` over each key's rows in the order of ``ts`` and ``order``, whatever the micro-batches are.

    ``df`` is a stream with a watermark on ``ts``; rows that come later than it allows are dropped, as everywhere. Rows appear in
    the output once the watermark has reached them. ``state`` is the schema of the fold's value, which a key keeps until it has
    been silent for ``idle`` of event time; after that it starts anew. The state of a key is what arrives within the watermark's delay
    and one value; a task's memory is what one key brings within a slice of event time, however much waits. ``farewell`` may put out rows when a key leaves, for a step behind this one. Needs the RocksDB state store, which is set for the session.
    """
    session = df.sparkSession
    if session.conf.get(PROVIDER) != ROCKSDB:
        session.conf.set(PROVIDER, ROCKSDB)
    rows = df.withColumn(AT, F.unix_micros(ts))
    waiting = T.StructType([f for f in rows.schema.fields if f.name not in (*keys, ts)])
    held = T.StructType([*T.StructType.fromDDL(state).fields, T.StructField(LAST, T.LongType())])
    processor = EventOrder(waiting, held, list(order), fold, idle_micros(idle) // 1000, farewell)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "EventTime")
