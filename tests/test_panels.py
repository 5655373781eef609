"""Field parsing and panel operators on odd tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, panels, text
from quillon.sources import bind_roles
from quillon.sources.roles import facts, parse_day, parse_number
from quillon.sources.sinks import write_csv


def test_days_and_numbers(spark):
    forms = {"20240105": 5, " 2024-01-05 ": 5, "2024/1/5": 5, "2024.01.05": 5, "20240105.0": 5, "20241305": None, "2024": None, "": None, "soon": None, None: None}
    rows = spark.createDataFrame([(x,) for x in forms], "x string").select("x", parse_day(F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in rows} == {x: d and dt.date(2024, 1, d) for x, d in forms.items()}
    numbers = {"1,234": 1234.0, " 1 234.5": 1234.5, "-7": -7.0, "x": None, "": None, None: None}
    rows = spark.createDataFrame([(x,) for x in numbers], "x string").select("x", parse_number(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == numbers


def test_roles_of_a_raw_sales_table(spark):
    raw = spark.createDataFrame([(20240105, "12,500", "880"), (20240229, None, None), (20230229, "x", "1")], "ymd int, amount string, item string")
    got = [tuple(r) for r in bind_roles(raw, {"dt": "ymd", "amt": "amount", "sku": "item"}).select("dt", "ym", "amt", "sku", "company").collect()]
    assert got == [(dt.date(2024, 1, 5), 202401, 12500.0, 880, None), (dt.date(2024, 2, 29), 202402, None, None, None), (None, None, None, 1, None)]


def test_facts_join_only_what_is_asked(spark, sf):
    plan = facts(spark, sf, {"ym"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and facts(spark, sf, {"sector"})._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_asof_keeps_repeated_rows(spark):
    day = lambda n: dt.date(2024, 1, n)
    left = spark.createDataFrame([("a", day(1))] * 3 + [("b", day(1))], "k string, d date")
    right = spark.createDataFrame([("a", day(4), 1.0), ("a", day(3), 2.0), ("b", day(20), 3.0)], "k string, e date, x double")
    assert [(r.k, r.e, r.x) for r in joins.asof_forward(left, right, ["k"], "d", "e", 10).collect()] == [("a", day(3), 2.0)] * 3


def test_stock_codes(spark):
    want = {"KR7005930003": "005930", "A005930": "005930", "005930": "005930", "1005930001": "005930", "00-59 30": "005930", "5930": None, "": None, None: None}
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", text.stock_code(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in rows} == want


def test_csv_starts_with_a_mark(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "out"))
    parts = [p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*")]
    assert all(p.startswith("\ufeffa,b\n") for p in parts) and sum(p.endswith("1,é\n") for p in parts) == 1


def test_panels_of_odd_tables(spark):
    t = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, None), (None, 1, 4.0), (" ", 1, 1.0)], "k string, o int, x double")
    one = panels.min_max(t.where("x = 4"), "x", "y")
    assert {r.y for r in one.collect()} == {0.5} and panels.min_max(t.limit(0), "x", "y").count() == 0
    assert sorted(r.y for r in panels.min_max(t, "x", "y").collect()) == pytest.approx([0, 0, 1 / 3, 1, 1])
    assert {(r.k, r.o): r.sector_rep for r in panels.representativeness(t, "k", [F.desc("x"), F.col("o")]).collect()} == {("a", 2): 1.0, ("a", 1): 0.5, ("a", 3): 1 / 3, (None, 1): 0.3, (" ", 1): 0.3}
    assert panels.bucket_mean_removed(t, "x", ["k"], "y").count() == 5
    codes = spark.createDataFrame([("123456",), ("129999",), ("9",), (None,), ("123456",)], "code string")
    prefixes = spark.createDataFrame([("12", "wide"), ("1234", "fine")], "prefix string, value string")
    assert sorted((str(r.code), r.value) for r in panels.prefix_lookup(codes, "code", prefixes).collect()) == [("123456", "fine"), ("123456", "fine"), ("129999", "wide"), ("9", ""), ("None", "")]
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    assert {(r.k, r.change) for r in panels.change_log(old, new, "k").collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    won = spark.createDataFrame([(2.0, "억원"), (2.0, "원"), (2.0, "?"), (2.0, None)], "x double, u string").select(panels.to_won(F.col("x"), F.col("u")).alias("w"))
    assert [r.w for r in won.collect()] == [2e8, 2.0, 2.0, 2.0]
