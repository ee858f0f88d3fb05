"""Ordered work over keyed series that stays balanced when one key is hot.

A window partitioned by key sends a whole series to one task. Here a series with more than
``tickloom.series.maxRows`` rows is cut along its order into chunks of about equal size and the
window is partitioned by (key, chunk):

* ``bounded``  – frames of at most ``depth`` rows: each chunk gets the last rows of the one before.
* ``running``  – unbounded prefixes: each chunk gets the aggregate of all chunks before it.

Series below the limit keep the plain one-shuffle window. The cut points come from quantiles of the
order column, so they are a pure function of the data and survive recomputation.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import pin

CHUNK, HALO, HOT = "_chunk", "_halo", "_hot"
_SERIAL = count()
DEFAULT_MAX_ROWS = 2_000_000
MAX_CHUNKS = 10_000          # bound of every table of cut points and carries
MAX_BROADCAST_ROWS = 200_000


def max_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tickloom.series.maxRows", str(DEFAULT_MAX_ROWS)))


@dataclass(frozen=True)
class SeriesPlan:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None = field(default=None, compare=False)

    @property
    def hot(self) -> bool:
        return self.cuts is not None

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.hot else list(self.keys)

    def window(self, *, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.parts).orderBy(*order)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the chunk number of each row (0 for series that are not cut)."""
        tag = f"_{next(_SERIAL)}"          # fresh names: a lineage may pass here several times
        cuts = self.cuts.toDF(*[c + tag for c in self.cuts.columns])
        pos = position(df, self.order[0])
        found = F.col("_cuts" + tag)
        joined = df.join(F.broadcast(cuts), _same_keys(self.keys, tag), "left")
        return joined.select(*df.columns, F.coalesce(_count_cuts(found, pos), F.lit(0)).alias(CHUNK), found.isNotNull().alias(HOT))


def position(df: DataFrame, name: str) -> Column:
    """The leading order column as a number: microseconds for times."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long")
    return F.col(name).cast("double") if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) \
        else F.col(name).cast("long")


def _same_keys(keys, tag: str = "") -> Column:
    """Null-safe equality of key columns with the columns _k0, _k1, ... of a small table."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}{tag}")) for i, k in enumerate(keys)], F.lit(True))


def _count_cuts(cuts: Column, pos: Column) -> Column:
    """How many cut points are <= pos, by halving steps (the array is sorted)."""
    steps = F.array(*[F.lit(1 << b) for b in range(MAX_CHUNKS.bit_length(), -1, -1)])
    return F.when(cuts.isNotNull(), F.aggregate(
        steps, F.lit(0),
        lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) <= pos), at + s).otherwise(at)))


#: Sources in which no series was hot. Columns and windows added on the way are pruned from what names a source, so the steps of
#: a job share one look at it. Only this answer is kept: if the source grows meanwhile, work is less even and results the same.
_CALM: OrderedDict = OrderedDict()


def _source(df: DataFrame, keys, order, limit: int):
    plan = df.select(*keys, order[0])._jdf.queryExecution().optimizedPlan()
    return df.sparkSession.sparkContext.applicationId, plan.semanticHash(), tuple(keys), order[0], limit


def plan_series(df: DataFrame, keys, order, depth: int = 0) -> SeriesPlan:
    """Look for hot series; ``depth`` is the longest row look-back a later ``bounded`` will use."""
    keys, order = tuple(keys), tuple(order)
    limit = max_rows(df)
    source = _source(df, keys, order, limit)
    if source in _CALM:
        return SeriesPlan(keys, order)
    counts = (df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > limit).orderBy(F.col("n").desc()).limit(MAX_CHUNKS).collect())
    if not counts:
        _CALM[source] = True
        while len(_CALM) > 1000:
            _CALM.popitem(last=False)
        return SeriesPlan(keys, order)
    target = max(limit, depth + 1, sum(r["n"] for r in counts) // MAX_CHUNKS)
    spark = df.sparkSession
    kfields = [T.StructField(f"_k{i}", df.schema[k].dataType, True) for i, k in enumerate(keys)]
    pieces = max(-(-r["n"] // target) for r in counts)
    hot = spark.createDataFrame([tuple(r[k] for k in keys) + (r["n"],) for r in counts],
                                T.StructType([*kfields, T.StructField("_n", T.LongType())]))
    base = df.select(*keys, position(df, order[0]).alias("_pos"))
    hot_rows = base.join(F.broadcast(hot), _same_keys(keys), "inner")
    probs = [i / pieces for i in range(1, pieces)]
    names = [f"_k{i}" for i in range(len(keys))]
    found = (hot_rows.groupBy(*names).agg(
        F.percentile_approx("_pos", probs, max(10_000, 20 * pieces)).alias("_cuts")).collect()) if probs else []
    grid = {tuple(r[n] for n in names): sorted(set(r["_cuts"])) for r in found}
    pos_type = T.ArrayType(hot_rows.schema["_pos"].dataType)
    rough = spark.createDataFrame([(*k, v) for k, v in grid.items()],
                                  T.StructType([*kfields, T.StructField("_cuts", pos_type)]))
    placed = base.join(F.broadcast(rough), _same_keys(keys), "inner")
    sizes = (placed.select(*names, _count_cuts(F.col("_cuts"), F.col("_pos")).alias(CHUNK))
             .groupBy(*names, CHUNK).count().collect())
    filled: dict[tuple, dict[int, int]] = {}
    for r in sizes:
        filled.setdefault(tuple(r[x] for x in names), {})[r[CHUNK]] = r["count"]
    final = []
    for key, cuts in grid.items():
        n = filled.get(key, {})
        final.append((*key, _merge(cuts, [n.get(i, 0) for i in range(len(cuts) + 1)], max(depth, target // 2))))
    cuts = spark.createDataFrame(final, rough.schema)
    return SeriesPlan(keys, order, cuts)


# Seconds per unit of a bucket width.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def bucket_plan(df: DataFrame, keys, order, every: str | None, depth: int = 0) -> SeriesPlan:
    """Plan for series that hold one row per time bucket.

    With buckets of a minute or more the length of a series is bounded by time (half a million rows a
    year), so no pass over the data is needed to know that no series is hot.
    """
    if every is not None:
        n, unit = every.split()
        if float(n) * UNIT_SECONDS[unit.rstrip("s")] >= 60:
            return SeriesPlan(tuple(keys), tuple(order))
    return plan_series(df, keys, order, depth)


def _merge(cuts: list, sizes: list[int], least: int) -> list:
    """Drop cut points until every chunk holds at least ``least`` rows."""
    kept, acc = [], 0
    for cut, size in zip(cuts, sizes):
        acc += size
        if acc >= least:
            kept.append(cut)
            acc = 0
    tail = acc + sizes[-1]
    if kept and tail < least:
        kept.pop()
    return kept


def bounded(df: DataFrame, plan: SeriesPlan, depth: int, body: Callable[[DataFrame, SeriesPlan], DataFrame],
            ahead: int = 0) -> DataFrame:
    """Run ``body`` whose windows look back ``depth`` rows (and ``ahead`` rows forward) in all.

    ``body`` receives the plan to build its windows from and must keep unknown columns.
    """
    if not plan.hot:
        return body(df, plan)
    placed = plan.assign(df)
    halos = []
    for rows, step, desc in ((depth, 1, True), (ahead, -1, False)):
        if rows:
            halos.append(placed.where(HOT).withColumn("_place", F.row_number().over(plan.window(descending=desc)))
                         .where(F.col("_place") <= rows).drop("_place")
                         .withColumn(CHUNK, F.col(CHUNK) + step).withColumn(HALO, F.lit(True)))
    full = reduce(DataFrame.unionByName, halos, placed.withColumn(HALO, F.lit(False)))
    return body(full, plan).where(~F.col(HALO)).drop(HALO, CHUNK, HOT)


_RUN = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
        "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}


def running(df: DataFrame, plan: SeriesPlan, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Prefix aggregates up to and including each row: ``{out: (kind, column)}``."""
    span = (Window.unboundedPreceding, 0)
    if not plan.hot:
        w = plan.window().rowsBetween(*span)
        return df.withColumns({out: _RUN[kind](F.col(c)).over(w) for out, (kind, c) in specs.items()})
    placed = plan.assign(df)
    when = F.struct(*plan.order)
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
             "last": lambda c: F.max_by(c, F.when(c.isNotNull(), when)),
             "first": lambda c: F.min_by(c, F.when(c.isNotNull(), when))}
    per = placed.where(HOT).groupBy(*plan.parts).agg(
        *[whole[kind](F.col(c)).alias(f"_v_{out}") for out, (kind, c) in specs.items()])
    before = Window.partitionBy(*plan.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    merge = {**_RUN, "count": F.sum}
    carry = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(plan.keys)],
                       F.col(CHUNK).alias("_kc"),
                       *[merge[kind](F.col(f"_v_{out}")).over(before).alias(f"_c_{out}")
                         for out, (kind, c) in specs.items()])
    w = plan.window().rowsBetween(*span)
    local = placed.withColumns({f"_o_{out}": _RUN[kind](F.col(c)).over(w) for out, (kind, c) in specs.items()})
    # at most MAX_CHUNKS cut points exist, hence at most 2 * MAX_CHUNKS carry rows
    joined = local.join(F.broadcast(carry), _same_keys(plan.keys) & (F.col(CHUNK) == F.col("_kc")), "left")
    out_cols = {}
    for out, (kind, _) in specs.items():
        mine, prev = F.col(f"_o_{out}"), F.col(f"_c_{out}")
        out_cols[out] = {
            "sum": lambda: F.coalesce(mine + prev, mine, prev), "count": lambda: mine + F.coalesce(prev, F.lit(0)),
            "min": lambda: F.least(mine, prev), "max": lambda: F.greatest(mine, prev),
            "last": lambda: F.coalesce(mine, prev), "first": lambda: F.coalesce(prev, mine)}[kind]()
    return joined.select(*[c for c in df.columns if c not in specs], *[c.alias(o) for o, c in out_cols.items()])


def attach(df: DataFrame, stats: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join per-key statistics back to rows.

    The statistics are computed once. Up to ``MAX_BROADCAST_ROWS`` rows of them are broadcast. Beyond
    that only the keys with more rows than the series limit (at most ``MAX_CHUNKS``) are broadcast, so
    a hot key never meets the shuffle, and the other keys are joined by shuffle.
    """
    keys = list(keys)
    if not keys:      # one row of totals becomes constants
        row = stats.first()
        return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema.fields})
    stats = pin(stats)
    if stats.count() <= broadcast_rows(df):
        return df.join(F.broadcast(stats), keys, how)
    limit = max_rows(df)
    hot = pin(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
              .orderBy(F.col("_n").desc()).limit(MAX_CHUNKS).select(*keys))
    few = F.broadcast(stats.join(F.broadcast(hot), keys, "left_semi"))
    heavy = df.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return heavy.unionByName(df.join(F.broadcast(hot), keys, "left_anti").join(stats, keys, how))


def broadcast_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tickloom.broadcast.maxRows", str(MAX_BROADCAST_ROWS)))


def quantiles(df: DataFrame, keys, col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    Groups up to the series limit use the built-in ``percentile``; larger ones are ranked through
    (key, value) counts so that no group is held in one task.
    """
    keys = list(keys)
    plan = plan_series(df, keys, [col])
    if not plan.hot:
        got = df.groupBy(*keys).agg(F.percentile(col, list(probs.values())).alias("_q"))
        return got.select(*keys, *[F.get("_q", i).alias(n) for i, n in enumerate(probs)])
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, plan_series(counts, keys, [col]), {"_cum": ("sum", "_n")})
    total = counts.groupBy(*keys).agg((F.sum("_n") - 1).cast("double").alias("_last"))
    aggs = []
    for name, p in probs.items():
        at = F.col("_last") * p
        lo = F.min(F.when(F.col("_cum") > F.floor(at), F.col(col)))
        hi = F.min(F.when(F.col("_cum") > F.ceil(at), F.col(col)))
        aggs.append((lo + (hi - lo) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return attach(ranked, total, keys).groupBy(*keys).agg(*aggs)


def order_value(df: DataFrame, keys, col: str, out: str, index: Callable[[Column], Column]) -> DataFrame:
    """Per key, the value at 0-based ascending position ``index(n)`` of its n non-null values."""
    keys = list(keys)
    if not plan_series(df, keys, [col]).hot:      # at most the series limit of values per key
        got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias("_v"))
        return got.select(*keys, F.get("_v", index(F.size("_v")).cast("int")).alias(out))
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, plan_series(counts, keys, [col]), {"_cum": ("sum", "_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    return attach(ranked, total, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") > index(F.col("_all")), F.col(col))).alias(out))


def islands(df: DataFrame, keys, order, starts: Callable[[Callable[[str], Column]], Column],
            out: str = "island", every: str | None = None) -> DataFrame:
    """Number the runs of each series; ``starts(prev)`` says whether a row opens a new run.

    ``prev(name)`` is the previous row's value of a column (NULL on the first row).
    """
    plan = bucket_plan(df, keys, order, every, depth=1)

    def flag(d: DataFrame, p: SeriesPlan) -> DataFrame:
        w = p.window()
        return d.withColumn("_new", F.when(F.coalesce(starts(lambda c: F.lag(c).over(w)), F.lit(False)), 1).otherwise(0))
    return running(bounded(df, plan, 1, flag), plan, {out: ("sum", "_new")}).drop("_new")
