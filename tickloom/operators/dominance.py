"""How many earlier rows of a series lie below each row: dominance counts that stay balanced when a series is hot.

A series above the limit of rows is cut twice, into chunks of time and into ranges of value. What lies before and below a row is
then the cells of earlier chunks and lower ranges (counted once and cumulated), the rows of earlier chunks inside the row's own
range, and the rows of its own chunk. The last two are counted exactly, each range and each chunk in a task of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import CHUNK, HOT, plan_series, running

C = F.col
_ROW, _P, _Q, _T, _N = "_row", "_p", "_q", "_t", "_n"


def dominated(time: np.ndarray, value: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For every entry that ``asks``, the weight of the others at an earlier time (an integer from 0) with a lower value.

    Two times differ first in one bit: there the earlier one has 0 and the later one 1. So one pass per bit, with the entries of
    each pair of halves in order of value, counts every pair of entries once.
    """
    first = np.lexsort((~asks, value))                    # at equal values those that ask come first: equal is not lower
    t, w, ask = time[first], np.where(asks, 0, weight)[first], asks[first]
    total = np.zeros(len(t), np.int64)
    for bit in range(int(t.max(initial=0)).bit_length()):
        pair = t >> (bit + 1)
        o = np.argsort(pair, kind="stable")
        later = (t[o] >> bit) & 1 == 1
        upto = np.cumsum(np.where(later, 0, w[o]))
        starts = np.flatnonzero(np.diff(pair[o], prepend=-1))
        before = np.concatenate([[0], upto])[starts]
        hit = later & ask[o]
        total[o[hit]] += (upto - np.repeat(before, np.diff(np.append(starts, len(o)))))[hit]
    out = np.zeros(len(t), np.int64)
    out[first] = total
    return out


def _same(a: DataFrame, b: DataFrame, names) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def _attach(df: DataFrame, counts: DataFrame, names, value: str, out: str) -> DataFrame:
    """Left join on columns that may be null; no count is 0."""
    right = counts.select(*[C(n).alias(f"_r_{n}") for n in names], C(value).alias(f"_r_{out}"))
    on = reduce(lambda x, y: x & y, [df[n].eqNullSafe(right[f"_r_{n}"]) for n in names])
    return df.join(right, on, "left").withColumn(out, F.coalesce(C(f"_r_{out}"), F.lit(0).cast("long"))).drop(*right.columns)


def earlier_below(df: DataFrame, keys, order, point: str, query: str, out: str, itself: bool = True) -> DataFrame:
    """``out``: how many rows of the key up to this one (``itself`` included or not) have ``point`` < this row's ``query``.

    ``order`` must tell the rows of a key apart. Null points count for nothing and null queries get 0. Only the key, the row's
    number and the two numbers travel to Python; a row that asks meets the other columns again by key and number.
    """
    keys = list(keys)
    plan = plan_series(df, keys, order)
    base = running(df.withColumn("_one", F.lit(1)), plan, {_ROW: ("sum", "_one")}).drop("_one")
    slim = base.select(*keys, _ROW, *order, C(point).cast("double").alias(_P), C(query).cast("double").alias(_Q))
    placed = plan.assign(slim).withColumnRenamed(CHUNK, _T) if plan.hot else slim.withColumns({_T: F.lit(0), HOT: F.lit(False)})
    kinds = dict(slim.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def chunk(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        p, q, at = (g[c].to_numpy().astype(float) for c in (_P, _Q, _ROW))
        at = np.unique(at, return_inverse=True)[1].astype(np.int64)
        is_p, is_q = ~np.isnan(p), ~np.isnan(q)
        time = np.concatenate([2 * at[is_p], 2 * at[is_q] + bool(itself)])
        asks = np.repeat([False, True], [is_p.sum(), is_q.sum()])
        n = dominated(time, np.concatenate([p[is_p], q[is_q]]), np.ones(len(time), np.int64), asks)
        return g.filter(pa.array(is_q)).select([*keys, _ROW]).append_column(_N, pa.array(n[asks]))

    inside = placed.select(*keys, _T, _ROW, _P, _Q).groupBy(*keys, _T).applyInArrow(chunk, f"{named}, {_ROW} {kinds[_ROW]}, {_N} long")
    if not plan.hot:
        return _attach(base, inside, [*keys, _ROW], _N, out).drop(_ROW)

    # hot series: equal points of a chunk are one entry, so a value that fills a third of the rows is a few entries
    hot = placed.where(HOT)
    points = hot.where(C(_P).isNotNull() & ~F.isnan(_P)).groupBy(*keys, _T, _P).agg(F.count(F.lit(1)).alias(_N))
    asked = hot.where(C(_Q).isNotNull() & ~F.isnan(_Q)).groupBy(*keys, _T, C(_Q).alias(_P)).agg(F.lit(0).cast("long").alias(_N))
    ranges = plan_series(points, keys, [_P])
    entries = points.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)))
    entries = ranges.assign(entries).drop(HOT).withColumnRenamed(CHUNK, "_v") if ranges.hot else entries.withColumn("_v", F.lit(0))

    def value_range(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        asks = g["_asks"].to_numpy(zero_copy_only=False).astype(bool)
        n = dominated(g[_T].to_numpy().astype(np.int64), g[_P].to_numpy(), g[_N].to_numpy(), asks)
        g = g.drop_columns([_N]).append_column(_N, pa.array(n))
        return g.filter(pa.array(asks)).select([*keys, _T, "_v", _P, _N])

    beside = entries.select(*keys, _T, "_v", _P, _N, "_asks").groupBy(*keys, "_v").applyInArrow(value_range, f"{named}, {_T} int, _v int, {_P} double, {_N} long")
    cells = entries.groupBy(*keys, _T, "_v").agg(F.sum(_N).alias("_c"))
    # every (chunk, range) that asks needs the cells before and below, also where no point lies
    grid = cells.select(*keys, _T).distinct().join(cells.select(*[C(k).alias(f"_g_{k}") for k in keys], "_v").distinct(),
                                                   reduce(lambda x, y: x & y, [C(k).eqNullSafe(C(f"_g_{k}")) for k in keys], F.lit(True))).select(*keys, _T, "_v")
    full = _attach(grid, cells, [*keys, _T, "_v"], "_c", "_c")
    lower = F.sum("_c").over(Window.partitionBy(*keys, _T).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("_l").over(Window.partitionBy(*keys, "_v").orderBy(_T).rowsBetween(Window.unboundedPreceding, -1))
    summed = full.withColumn("_l", F.coalesce(lower, F.lit(0))).withColumn("_b", F.coalesce(before, F.lit(0)))
    outside = _attach(beside, summed, [*keys, _T, "_v"], "_b", "_b").select(*keys, _T, _P, (C(_N) + C("_b")).alias(_N))

    far = _attach(hot.select(*keys, _T, _ROW, C(_Q).alias(_P)), outside, [*keys, _T, _P], _N, "_f")
    both = _attach(_attach(base, inside, [*keys, _ROW], _N, "_i_n"), far, [*keys, _ROW], "_f", "_o_n")
    return both.withColumn(out, C("_i_n") + C("_o_n")).drop(_ROW, "_i_n", "_o_n")
