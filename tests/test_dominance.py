"""Dominance counts against a double loop, whole and with the series cut along time and value."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import checks
from tickloom.operators.dominance import dominated, earlier_below
from tickloom.operators.windows import expanding_pct_rank, final_pct_rank


def test_dominated_equals_a_double_loop():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 17, 120):
        time, value, weight, asks = r.integers(0, 40, n), r.integers(0, 9, n).astype(float), r.integers(1, 4, n), r.random(n) < .5
        want = [sum(weight[j] for j in range(n) if not asks[j] and time[j] < time[i] and value[j] < value[i]) if asks[i] else 0 for i in range(n)]
        got = dominated(time, value, weight, asks)
        assert np.where(asks, got, 0).tolist() == want


def series(spark):
    r = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None if i % 2 else "b", i, None if i % 17 == 5 else float(v), None if i % 13 == 2 else float(q))
            for i, (v, q) in enumerate(zip(np.where(r.random(500) < .4, 5, r.integers(0, 60, 500)), r.integers(0, 60, 500)))]
    return rows, spark.createDataFrame(rows, "k string, at long, p double, q double").withColumn("payload", F.lit("x")).repartition(4)


@pytest.mark.parametrize("limit", [2_000_000, 150, 12])
def test_counts_do_not_depend_on_the_cuts(spark, limit):
    rows, df = series(spark)
    spark.conf.set("tickloom.series.maxRows", str(limit))
    try:
        for itself in (True, False):
            got = {r.at: (r.n, r.k, r.p, r.q, r.payload) for r in earlier_below(df, ["k"], ["at"], "p", "q", "n", itself).collect()}
            for k, at, p, q in rows:
                want = sum(b[0] == k and (b[1] < at or itself and b[1] == at) and b[2] is not None and q is not None and b[2] < q for b in rows)
                assert got[at] == (want, k, p, q, "x")
            assert len(got) == len(rows)
        ranks = {r.at: r.pct_rank for r in expanding_pct_rank(df, ["k"], ["at"], "p").collect()}
        for k, at, p, _ in rows:
            past = [b[2] for b in rows if b[0] == k and b[1] <= at and b[2] is not None]
            assert ranks[at] == (None if p is None else pytest.approx(sum(x < p for x in past) / len(past) * 100))
    finally:
        spark.conf.unset("tickloom.series.maxRows")
    known = df.where("p IS NOT NULL AND k IS NOT NULL")
    last = {r.k: r.pct_rank for r in final_pct_rank(known, ["k"], "at", "p").collect()}
    newest = {r.k: r.at for r in known.groupBy("k").agg(F.max("at").alias("at")).collect()}
    assert all(ranks[newest[k]] == pytest.approx(v) for k, v in last.items())


@pytest.mark.parametrize("name", ["w13_expanding_pct_rank", "m15_series_regime"])
def test_queries_with_every_series_cut(spark, tiny, name):
    fn = checks.queries()[name]
    plain = sorted(map(str, fn(spark, tiny).collect()))
    spark.conf.set("tickloom.series.maxRows", "12")
    try:
        cut = sorted(map(str, fn(spark, tiny).collect()))
    finally:
        spark.conf.unset("tickloom.series.maxRows")
    assert plain == cut and plain


@pytest.mark.parametrize("limit", [2_000_000, 12])
def test_pair_counts_of_a_cut_series(spark, limit):
    from tickloom.operators.joins import kendall_counts, pair_series
    rows, df = series(spark)
    spark.conf.set("tickloom.series.maxRows", str(limit))
    try:
        got = {r.k: (r.n, r.rising, r.falling, r.tied) for r in pair_series(df, ["k"], "at", "p").collect()}
    finally:
        spark.conf.unset("tickloom.series.maxRows")
    for k in ("hot", "b", None):
        x = np.array([b[2] for b in rows if b[0] == k and b[2] is not None])
        assert got[k] == (len(x), *kendall_counts(x))
