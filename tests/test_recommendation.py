"""Penalties and the recommendation of an update come from one shuffle of its signals."""
from tickloom.checks.streams import Tables
from tickloom.plans import composites as P

NAMES = [m[0] for m in P.SIGNAL_META]


def ranked(spark):
    rows = [("s", None if u == 3 else u, u, n, P.SIGNAL_META[i][1], (7 * u + 3 * i) % 10 / 10, .5 + i % 2 / 4, ["bullish", "bearish", "neutral"][(u + i) % 3], (u + i * 5) % 8 / 4)
            for u in range(6) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "symbol string, ts long, event_id long, signal string, category string, value double, confidence double, direction string, rank_score double")


def test_signals_of_an_update_travel_once(spark):
    out = P.recommend(P.correlation_penalty(ranked(spark), ["symbol"]), ["symbol"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    facts = {r.event_id: r for r in out.collect()}
    assert set(facts) == {0, 1, 2, 4, 5}        # an update without a time has no recommendation
    sides = {r.event_id: r for r in P.market_bias(P.correlation_penalty(ranked(spark), ["symbol"]), ["symbol"]).collect()}
    for u, r in facts.items():
        assert (r.market_bias, r.conflict_severity) == (sides[u].market_bias, sides[u].conflict_severity) and abs(r.bias_confidence - sides[u].bias_confidence) < 1e-12


def test_penalties_equal_a_loop(spark):
    got = {(r.event_id, r.signal): r.rank_score for r in P.correlation_penalty(ranked(spark), ["symbol"]).collect()}
    first = {(r.event_id, r.signal): r.rank_score for r in ranked(spark).collect()}
    for u in range(6):
        want = {n: first[u, n] for n in NAMES}
        for g in ("flow", "momentum", "risk", "structure", "timing"):
            best = sorted((n for n in NAMES if n in P.SIGNAL_GROUPS[g]), key=lambda n: (-want[n], NAMES.index(n)))
            want |= {n: want[n] * max(.5, 1 - .1 * k) for k, n in enumerate(best)}
        assert all(abs(got[u, n] - v) < 1e-12 for n, v in want.items())


def test_parsed_events_are_the_events(spark, tiny):
    t = Tables(spark, tiny)
    p = t.parsed()
    assert p.ev.schema == t.ev.schema and p.ev.count() == t.ev.count() and p.ev.exceptAll(t.ev).isEmpty()
    assert "get_json_object" not in p.oi._jdf.queryExecution().optimizedPlan().toString()
