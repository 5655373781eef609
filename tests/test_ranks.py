"""Ranks, percentiles and false discovery rates against numpy and plain loops, with ties, nulls, signs and empty tables."""

from __future__ import annotations

import math
import random

import numpy as np

from quillon.operators.ranks import discovery_rates, percentiles, positions


def test_positions(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.5, -7.25, 1e12, 3e-9, round(rng.gauss(0, 1000), 1)]) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(400, None)], "id long, v double")
    for descending in (True, False):
        rows = sorted(positions(df, "v", ["id"], descending).collect(), key=lambda r: r.pos)
        want = sorted(range(400), key=lambda i: (-values[i] if descending else values[i], i))
        want = [*want, 400] if descending else [400, *want]
        assert [r.id for r in rows] == want and [r.pos for r in rows] == list(range(1, 402))
        run = 0.0
        for r in rows:
            run += r.v or 0.0
            assert math.isclose(r.run, run, rel_tol=1e-9, abs_tol=1e-2)
            assert r.rnk == min(x.pos for x in rows if x.v == r.v)
    assert positions(df.where("false"), "v", ["id"]).count() == 0


def test_percentiles(spark):
    rng = random.Random(5)
    data = {g: [rng.choice([2.0, -2.0, None, rng.expovariate(1e-3)]) for _ in range(n)] for g, n in (("a", 300), (None, 77), ("one", 1), ("b", 2))}
    data["none"] = [None, None]
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    rows = {r.g: r for r in percentiles(df, ["g"], "v", {"lo": 0.0, "q": 0.3, "hi": 1.0}).collect()}
    assert set(rows) == set(data)
    for g, vs in data.items():
        known = [v for v in vs if v is not None]
        for c, p in (("lo", 0), ("q", 30), ("hi", 100)):
            assert rows[g][c] is None if not known else math.isclose(rows[g][c], np.percentile(known, p), rel_tol=1e-9)
    (whole,) = percentiles(df, [], "v", {"m": 0.5}).collect()
    assert math.isclose(whole.m, np.percentile([v for vs in data.values() for v in vs if v is not None], 50), rel_tol=1e-9)


def test_discovery_rates(spark):
    rng = random.Random(7)
    ps = [rng.choice([0.0, 1.0, 0.5, rng.random() ** 4]) for _ in range(200)]
    rows = discovery_rates(spark.createDataFrame(list(enumerate(ps)), "id long, p double"), "p", ["id"]).collect()
    order = sorted(range(200), key=lambda i: (ps[i], i))
    for r in rows:
        at = order.index(r.id)
        assert math.isclose(r.q, min(1.0, min(ps[order[k]] * 200 / (k + 1) for k in range(at, 200))), rel_tol=1e-12, abs_tol=1e-15)


def test_percentiles_of_few_groups_move_wanted_steps_only(spark):
    """The same percentiles, without a shuffle of all values: rows of other steps than the wanted ones are dropped by a broadcast."""
    rng = random.Random(6)
    rows = [(g, rng.choice([2.0, -2.0, None, rng.expovariate(1e-3)])) for g, n in (("a", 300), (None, 77), ("one", 1), ("b", 2)) for _ in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"lo": 0.0, "q": 0.3, "hi": 1.0}
    plain = {r.g: tuple(r) for r in percentiles(df, ["g"], "v", shares).collect()}
    assert {r.g: tuple(r) for r in percentiles(df, ["g"], "v", shares, few=True).collect()} == plain and len(plain) == 5
    assert percentiles(df.where("false"), ["g"], "v", shares, few=True).count() == 0
    plan = lambda **few: percentiles(df, ["g"], "v", shares, **few)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few=True) and "LeftSemi" in plan(few=True) and "LeftSemi" not in plan()
