"""The first tick after an instant, against a plain search, and how many rows are made for it."""

import random

import pytest

from tidemark.operators import asof

TICK = "instrument string, ts long, bid double, ask double, source string, seq long"


def rows_made(plan):
    """The most rows that a node of a plan that has run gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
    metrics = plan.metrics()
    own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    return max([own, *map(rows_made, below)])


@pytest.mark.parametrize("strict", [False, True])
def test_first_ticks_are_those_of_a_plain_search(spark, strict):
    rng, span, wide = random.Random(4), 400, 40
    ticks = [(rng.choice(["E", "G", None]), rng.choice([None, *range(-span, span)]), float(b := rng.randint(0, 5)), float(b + rng.choice([-1, 0, 1, 1])), "a", rng.choice([k, k, k, None])) for k in range(250)]
    ticks += [("E", t, 1.0, None, "a", 9000 + t) for t in range(5)] + [("E", span - 1, 3.0, 4.0, "a", s) for s in (7003, 7001, 7002)]
    asks = [(k, rng.choice(["E", "E", "G", "X", None]), rng.choice([None, *range(-span - wide, span + wide)])) for k in range(500)]

    def first(instrument, at):
        if instrument is None or at is None:
            return (None,) * 4
        clean = [t for t in ticks if t[0] == instrument and None not in (t[1], t[2], t[3]) and t[2] <= t[3] and at + strict <= t[1] <= at + wide]
        t = min(clean, key=lambda t: (t[1], t[5] is not None, t[5] or 0), default=None)
        return (None,) * 4 if t is None else (t[1], t[5], t[2], t[3])

    # an instant without a number at most once, so that the first is one tick
    ticks = list({(t[0], t[1], t[5]): t for t in ticks}.values())
    found = asof.forward_asof(spark.createDataFrame(asks, "ask_id long, instrument string, ask_at long"), spark.createDataFrame(ticks, TICK), wide, strict)
    assert found.columns == ["ask_id", "instrument", "ask_at", "ts", "seq", "bid", "ask"]
    wanted = sorted(((*a, *first(a[1], a[2])) for a in asks), key=repr)
    assert sum(w[3] is not None for w in wanted) > 200 and sorted(map(tuple, found.collect()), key=repr) == wanted


def test_asks_of_a_dense_bucket_are_not_paired_with_all_its_ticks(spark):
    n = 1500
    ticks = spark.createDataFrame([("E", k, 1.0, 2.0, "a", k) for k in range(n)], TICK)
    asks = ticks.selectExpr("seq AS ask_id", "instrument", "ts + 1 AS ask_at")
    found = asof.forward_asof(asks, ticks, 10 * n)
    assert sorted((r.ask_id, r.ts) for r in found.collect()) == [(k, k + 1 if k + 1 < n else None) for k in range(n)]
    assert n <= rows_made(found._jdf.queryExecution().executedPlan()) <= 3 * n
