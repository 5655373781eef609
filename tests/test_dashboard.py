"""Anomalies, demand, scores and checks of rows on odd panels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import dashboard as d

PANEL = "company string, period int, sales double, tx long"


def _panel(spark, **companies):
    return spark.createDataFrame([(c, i, None if s is None else float(s), t) for c, rows in companies.items() for i, (s, t) in enumerate(rows)], PANEL)


def test_anomalies(spark):
    steady = [(100 + i % 3, 10) for i in range(12)]
    jump = [*steady, (500, 10), (101, None)]
    panel = _panel(spark, jump=jump, flat=[(5, 5)] * 9, two=[(1, 1), (900, 1)], nulls=[(None, None)] * 5)
    got = {(r.company, r.period, r.metric): r for r in d.anomalies(panel, "z", 2.5, window=12).collect()}
    assert set(got) == {("jump", 12, "sales")}
    event = got["jump", 12, "sales"]
    assert (event.kind, event.actual, event.severity) == ("rise", 500.0, "medium") and event.z > 3 and event.deviation == round(100 * (500 - event.expected) / event.expected, 1)
    assert {(r.company, r.period) for r in d.anomalies(panel, "iqr", window=12).collect()} == {("jump", 12)}
    assert {(r.company, r.period) for r in d.anomalies(panel, "both", 0.9, window=3).where("metric = 'sales'").collect()} >= {("jump", 12)}
    assert d.anomalies(panel, "both", 9.0, window=2).count() == 0 == d.anomalies(panel.limit(0)).count()
    with pytest.raises(ValueError):
        d.anomalies(panel, "other")


def test_demand_drivers_and_score(spark):
    panel = _panel(spark, volume=[(100, 10), (200, 20)], price=[(100, 10), (150, 10)], both=[(100, 10), (169, 13)], falls=[(100, 10), (40, 8)], fewer=[(100, 10), (90, 8)], cheaper=[(100, 10), (90, 12)], same=[(100, 10), (100, 10)], zero=[(0, 0), (50, 5)], one=[(7, 1)])
    rows = d.demand(panel).collect()
    last = {r.company: r for r in rows if r.period == 1 or r.company == "one"}
    assert {c: r.driver for c, r in last.items()} == {"volume": "volume", "price": "price", "both": "volume and price", "falls": "both fall", "fewer": "volume falls", "cheaper": "price falls", "same": "", "zero": "", "one": ""}
    assert last["one"].demand_score == 50.0 and last["zero"].sales_chg is None
    assert last["price"].demand_score == round(0.3 * 100 + 0.25 * 50 + 0.2 * 100 + 0.25 * 50, 1)
    assert len(rows) == 17 and d.demand(panel.limit(0)).count() == 0


def test_points_and_bands(spark):
    rows = [(30.0, 100.0, 0, 0, 0), (-90.0, 0.0, 3, 0, 0), (None, None, 0, 0, 0), (0.0, 50.0, 1, 1, 2), (10.0, 60.0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "mom double, demand double, c int, h int, m int")
    points = [r.p for r in df.select(d.alpha_points(*map(F.col, df.columns)).alias("p")).collect()]
    assert points == [100.0, 0.0, 62.5, 43.5, 70.7]
    assert [r.p for r in df.select(d.alpha_points(*map(F.col, df.columns), analyses=1).alias("p")).collect()] == [80.0, 20.0, 57.5, 46.1, 62.4]
    bands = spark.createDataFrame([(x,) for x in (100.0, 75.0, 74.9, 60.0, 45.0, 30.0, 29.9, 0.0)], "x double").select(d.band(F.col("x")).alias("b")).collect()
    assert [r.b for r in bands] == ["strong buy", "strong buy", "buy", "buy", "neutral", "caution", "risk", "risk"]


def test_points_that_end_in_a_half(spark):
    """91 times 0.35 and 25 are 56.85; by way of 50 and back it was 56.849999999999994."""
    df = spark.createDataFrame([(-72.1, 91.0), (-6.3, 53.0), (-34.0, 81.0)], "mom double, demand double")
    none = F.lit(0)
    assert [r.p for r in df.select(d.alpha_points(F.col("mom"), F.col("demand"), none, none, none).alias("p")).collect()] == [56.9, 59.4, 53.4]


def test_dashboard_has_every_company(spark):
    panel = _panel(spark, calm=[(100 + i, 10 + i) for i in range(8)], wild=[(100, 10)] * 8 + [(900, 10)], new=[(5, 1)])
    got = {r.company: r for r in d.dashboard(panel, threshold=2.0, window=9).collect()}
    assert set(got) == {"calm", "wild", "new"} and got["wild"].events == 1 and got["calm"].events == 0
    assert (got["new"].mom, got["new"].score, got["new"].band) == (None, 62.5, "buy") and got["wild"].trend == "accelerates"
    assert d.dashboard(panel.limit(0)).count() == 0


def test_quality_of_rows(spark):
    rows = [("2024-01-01", float(i), i) for i in range(1, 21)] + [("2024-01-02", 0.0, 1)] * 3 + [(None, -5.0, None), ("2024-01-03", None, 2), ("2024-01-04", 900.0, 3)]
    df = spark.createDataFrame(rows, "d string, s double, t int")
    got = {r.check: (r.severity, r.n, r.cut) for r in d.data_quality(df, "d", "s", "t").collect()}
    assert got == {
        "no_date": ("error", 1, 1), "no_sales": ("error", 1, 1), "no_tx": ("warning", 1, 0), "repeated": ("warning", 2, 10), "negative": ("warning", 1, 5), "zero": ("info", 3, 5), "outliers": ("info", 1, 0), "usable_rows": ("warning", 24, 15),
    }
    assert {r.score for r in d.data_quality(df, "d", "s", "t").collect()} == {100 - sum(c for *_, c in got.values())}
    empty = {r.check: (r.n, r.cut, r.score) for r in d.data_quality(df.limit(0), "d", "s").collect()}
    assert empty["usable_rows"] == (0, 30, 70) and "no_tx" not in empty and len(empty) == 7


def test_plans_take_parameters(spark):
    import datetime as dt

    from quillon import plans
    from quillon.sources import bind_roles

    rows = [("2024-01-10", "A", "x1", 10.0, 1.0, "PROMO"), ("2024-02-10", "A", "x2", 30.0, 1.0, "OLD"), ("2024-03-10", "A", "x1", 20.0, 4.0, "SMALL")]
    df = spark.createDataFrame(rows, "day string, company string, brand string, amt double, qty double, cat string")
    f = bind_roles(df, {"dt": "day", "company": "company", "code": "company", "brand": "brand", "amt": "amt", "qty": "qty", "cat1": "cat", "sku": F.lit(1)})
    assert [r.ym for r in plans.run(spark, "pit_latest", f, as_of=dt.date(2024, 3, 20)).collect()] == [202402]
    assert [r.ym for r in plans.run(spark, "pit_latest", f, as_of=dt.date(2024, 3, 5), lag_days=6).collect()] == [202401]
    assert {r.ym for r in plans.run(spark, "category_category_filter", f, category="OLD", pattern="SM%").collect()} == {202402, 202403}
    assert {r.cat1: r.covered_pct for r in plans.run(spark, "sales_coverage", f, covered="1$").collect()} == {"PROMO": 100.0, "OLD": 0.0, "SMALL": 100.0}
    assert {r.ym for r in plans.run(spark, "asp_outliers", f, least=6, most=29).collect()} == {202402, 202403}
    with pytest.raises(ValueError):
        plans.run(spark, "pit_latest", f, day=1)
