"""Lead research and master operators against plain versions, on small tables with nulls, ties, gaps and repeated rows."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from quillon.operators import leads, masters


def test_rank_correlations(spark):
    rng = random.Random(2)
    data = {"ties": [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(40)], "free": [(rng.random(), -rng.random()) for _ in range(25)], "flat": [(1.0, rng.random()) for _ in range(20)], "few": [(1.0, 2.0), (2.0, 1.0)]}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, rows in data.items() for a, b in rows], "k string, a double, b double")
    got = {r.k: r for r in leads.rank_correlations(df, ["k"], 12).collect()}
    for k, rows in data.items():
        x = pd.DataFrame(rows, columns=["a", "b"]).rank()
        want = None if k in ("flat", "few") else x.a.corr(x.b)
        assert got[k].n == len(rows)
        assert got[k].corr is None if want is None else math.isclose(got[k].corr, want, abs_tol=5.01e-4)


def test_returns_research_measures_series_row_by_row(spark, monkeypatch):
    """Gaps, nulls, ties and flat series, as the long way over every pair has them, without a row a pair and lag."""
    rng = random.Random(9)
    months = [y * 100 + m for y in (2020, 2021, 2022, 2023) for m in range(1, 13)]
    signal = [(c, s, ym, float(rng.randint(-3, 3)) if s == "ties" else 1.0 if s == "flat" else rng.gauss(0, 1)) for c in "abc" for s in ("ties", "free", "flat") for ym in months if rng.random() < 0.9]
    returns = [(c, ym, rng.choice([None, 0.0, rng.gauss(0, 1)])) for c in "abd" for ym in months if rng.random() < 0.9]
    s = spark.createDataFrame(signal, "code string, signal string, ym int, value double").cache()
    t = spark.createDataFrame(returns, "code string, ym int, target double").where("target IS NOT NULL").cache()
    pairs = {(r.code, r.signal, r.lag): r for r in leads.rank_correlations(leads.lead_pairs(s, t.join(s.select("code", "signal").distinct(), "code"), ["code", "signal"], "ym", 6), ["code", "signal", "lag"], 12).collect()}
    monkeypatch.setattr(leads, "lead_pairs", None)
    rows = leads.returns_research(s, t).collect()
    assert {(r.code, r.signal) for r in rows} == {(c, k) for c in "ab" for k in ("ties", "free")}
    for r in rows:
        want = pairs[(r.code, r.signal, r.lag)]
        assert (r.full, r.n) == (want["corr"], want.n) and abs(r.hit - want.hit) < 0.011
    assert leads.returns_research(s, t.where("code = 'd'")).count() == 0


def test_returns_research_finds_the_planted_lead(spark):
    rng = random.Random(4)
    signal, returns = [], []
    for code in range(6):
        x = [rng.gauss(0, 1) for _ in range(80)]
        for i, v in enumerate(x):
            signal.append((str(code), "s", i, v if i % 17 else None))
            if i >= 3:
                returns.append((str(code), i, x[i - 3] + rng.gauss(0, 0.2) if code < 3 else rng.gauss(0, 1)))
    s = spark.createDataFrame(signal, "code string, signal string, ym int, value double")
    t = spark.createDataFrame(returns, "code string, ym int, target double")
    rows = {r.code: r for r in leads.returns_research(s, t).collect()}
    assert all(rows[str(c)].lag == 3 and rows[str(c)].oos > 0.8 and rows[str(c)].confidence == "high" for c in range(3))
    assert all(rows[str(c)].q >= 0.01 for c in range(3, 6) if str(c) in rows)
    assert leads.returns_research(s.where("false"), t).count() == 0
    assert leads.returns_research(s.where("ym < 15"), t).count() == 0


def test_representative_brands(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    curated = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("z", "w", 1)], "k string, brand string, place int")
    recommended = spark.createDataFrame([("a", "x", 1), ("a", "v", 2), ("a", "u", 3), ("b", "q", 1), ("b", "q", 1)], "k string, brand string, place int")
    got = [tuple(r) for r in masters.representative_brands(keys, curated, recommended, "k", 3).orderBy("k", "slot").collect()]
    assert got == [("a", 1, "y", "curated"), ("a", 2, "x", "curated"), ("a", 3, "v", "recommended"), ("b", 1, "q", "recommended"), ("b", 2, "", "none"), ("b", 3, "", "none"), ("c", 1, "", "none"), ("c", 2, "", "none"), ("c", 3, "", "none")]


def test_numbers_marks_and_rates(spark):
    raw = spark.createDataFrame([("123-45-67890",), ("42",), ("12345678901",), ("none",), (None,)], "x string")
    assert [r[0] for r in raw.select(masters.business_number(F.col("x"))).collect()] == ["1234567890", "0000000042", None, None, None]
    marks = spark.sql("SELECT * FROM VALUES (map('a', true, 'b', true)), (map('a', true, 'b', false)), (map('a', true)), (cast(NULL AS map<string, boolean>)) t(m)")
    assert [r[0] for r in marks.select(masters.signed_off(F.col("m"), F.array(F.lit("a"), F.lit("b")))).collect()] == [True, False, False, False]
    trades = spark.createDataFrame([("p", 1, 10.0, 20.0), ("p", 1, 10.0, 40.0), ("p", 3, 20.0, 20.0), ("q", 2, 0.0, 5.0)], "k string, d int, paid double, got double")
    got = {(r.k, r.d): r.rate for r in masters.cumulative_rate(trades, "k", "d", "paid", "got").collect()}
    assert got == {("p", 1): 3.0, ("p", 2): 3.0, ("p", 3): 2.0, ("q", 2): None, ("q", 3): None}


def test_share_matrix_fills_with_zero(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, None), ("b", 1, 1.0)], "k string, m int, x double")
    assert {(r.k, r.m): r.share for r in masters.share_matrix(df, "k", "m", "x").collect()} == {("a", 1): 75.0, ("a", 2): 0.0, ("b", 1): 25.0, ("b", 2): 0.0}


def test_rank_correlations_of_very_many_pairs(spark):
    n = 70_000
    pairs = spark.range(n).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("a"), ((F.col("id") * 3) % n).cast("double").alias("b"))
    row = leads.rank_correlations(pairs, ["k"], 5, None).first()
    a, b = list(range(n)), [3 * i % n for i in range(n)]
    assert row.n == n and math.isclose(row["corr"], (n * sum(map(int.__mul__, a, b)) - sum(a) * sum(b)) / (n * sum(x * x for x in a) - sum(a) ** 2), rel_tol=1e-9)


def test_rank_correlation_grid(spark):
    """Every column against every other as ``rank_correlations`` has their pairs: ties, nulls, signed zeros, flat columns, few rows, a group without a key."""
    rng = random.Random(4)
    cell = lambda kind: None if rng.random() < 0.2 else {"ties": float(rng.randint(-1, 1)), "free": rng.gauss(0, 1), "flat": 1.0, "zero": rng.choice([0.0, -0.0, 1.0])}[kind]
    rows = [(k, *(cell(c) for c in ("ties", "free", "flat", "zero")), *(cell(c) for c in ("free", "ties"))) for k, n in ((1, 60), (2, 9), (3, 4), (None, 30)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k int, ties double, free double, flat double, zero double, y1 double, y2 double")
    left, right = ["ties", "free", "flat", "zero"], ["y1", "y2"]
    got = {(r.k, r.x, r.y): (r.n, r["corr"]) for r in leads.rank_correlation_grid(df, ["k"], left, right, 5).collect()}
    want = {}
    for x in left:
        for y in right:
            pairs = df.select("k", F.col(x).alias("a"), F.col(y).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
            want |= {(r.k, x, y): (r.n, r["corr"]) for r in leads.rank_correlations(pairs, ["k"], 5, None).where("corr IS NOT NULL").collect()}
    assert len(want) > 10 and got == want
    assert leads.rank_correlation_grid(df.limit(0), ["k"], left, right, 5).count() == 0
