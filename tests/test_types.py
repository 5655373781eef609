"""Types of text columns, and dates and numbers in the forms that files have."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.sources import types
from quillon.sources.roles import parse_day


DAYS = {"yyyyMMdd": "20240229", "yyyyMM": "202402", "yyyy-MM-dd": "2024-02-29", "yyyy/MM/dd": "2024/02/29", "yyyy.MM.dd": "2024.02.29", "yyyy-MM": "2024-02"}


def _types(spark, columns: dict[str, list], **kw) -> dict[str, tuple]:
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    return {t.column: (t.kind, t.form, t.nulls, t.unread) for t in types.infer_types(df, **kw)}


def test_lattice(spark):
    got = _types(spark, {
        "a.b": ["1", "-20", None], "grouped": ["1,234", "12", " "], "float": ["1.5", "2e3", "3"], "code": ["007", "123", "9"], "ymd": ["20240105", "20231231.0", "19000101"],
        "not a day": ["20240132", "20240105", "20240101"], "ym": ["202401", "199912", "190001"], "late": ["210112", "202401", "1"], "iso": ["2024-02-29", None, None], "no leap": ["2023-02-29", None, None],
        "slash": ["2024/01/05", "2020/12/31", ""], "dot": ["2024.01.05", "2020.12.31", ""], "dash month": ["2024-01", "2020-12", ""], "two forms": ["2024-01-05", "20240106", "2024/01/07"],
        "flag": ["Y", "no", "TRUE"], "words": ["a", "1", "2"], "nulls": [None, "", "  "], "big": ["99999999999999999999", "1", "2"], "comma": ["1,23", "4", "5"],
    })
    assert got == {
        "a.b": ("long", None, 1, 0), "grouped": ("long", None, 1, 0), "float": ("double", None, 0, 0), "code": ("string", None, 0, 0), "ymd": ("date", "yyyyMMdd", 0, 0),
        "not a day": ("long", None, 0, 0), "ym": ("date", "yyyyMM", 0, 0), "late": ("long", None, 0, 0), "iso": ("date", "yyyy-MM-dd", 2, 0), "no leap": ("string", None, 2, 0),
        "slash": ("date", "yyyy/MM/dd", 1, 0), "dot": ("date", "yyyy.MM.dd", 1, 0), "dash month": ("date", "yyyy-MM", 1, 0), "two forms": ("string", None, 0, 0),
        "flag": ("boolean", None, 0, 0), "words": ("string", None, 0, 0), "nulls": ("string", None, 3, 0), "big": ("double", None, 0, 0), "comma": ("string", None, 0, 0),
    }


def test_tolerance_sample_and_empty_tables(spark):
    values = ["20240101"] * 9 + ["bad"]
    assert _types(spark, {"d": values}) == {"d": ("string", None, 0, 0)}
    assert _types(spark, {"d": values}, tolerance=0.1) == {"d": ("date", "yyyyMMdd", 0, 1)}
    assert _types(spark, {"d": values}, sample_rows=3) == {"d": ("date", "yyyyMMdd", 0, 0)}
    assert _types(spark, {"d": ["x"]}, sample_rows=0) == {"d": ("string", None, 0, 0)}
    df = spark.createDataFrame([(v,) for v in values], "d string")
    out = types.typed(df.withColumn("other", F.lit(1)), types.infer_types(df, tolerance=0.1))
    assert out.dtypes == [("d", "date"), ("other", "int")] and out.where("d IS NULL").count() == 1
    assert types.infer_types(df.limit(0))[0].kind == "string"


def test_a_wide_table_takes_no_aggregate_per_column_and_type(spark):
    """Up to round 3 one aggregate a column and type was planned: 50 seconds for the 150,000 orders of sf0.1."""
    odd = {"plus": ["+5", "-0", "+1,000"], "point": [".5", "-.5", "1."], "power": ["e5", "1e5", "2"], "line": ["12\n", "20240105\n", "3"], "no": ["F", "t", "False"], "long no": ["falsey", "no", "n"], "zeros": ["5.0", "1.00", "7"]}
    assert _types(spark, odd) == {
        "plus": ("long", None, 0, 0), "point": ("string", None, 0, 0), "power": ("string", None, 0, 0), "line": ("long", None, 0, 0), "no": ("boolean", None, 0, 0), "long no": ("string", None, 0, 0), "zeros": ("double", None, 0, 0),
    }
    planned = []
    df = spark.range(3).select(*(F.col("id").cast("string").alias(f"c{i}") for i in range(30)))
    agg = type(df).agg
    type(df).agg = lambda self, *exprs: planned.append(len(exprs)) or agg(self, *exprs)
    try:
        assert {(t.kind, t.rows, t.unread) for t in types.infer_types(df)} == {("long", 3, 0)}
    finally:
        type(df).agg = agg
    assert sum(planned) < 30


def test_readings_of_wide_rows_are_not_one_method(spark):
    """Up to round 3 all columns' readings were one method of generated code, too long for the JVM to compile."""
    values = {"long": ["1,234", "x"], "double": ["1.5", "."], "boolean": ["Y", "?"], "string": [" a ", " "], **{f: [day, "2023" + day[4:]] for f, day in DAYS.items()}}
    kinds = [types.ColumnType(c, "date" if c in DAYS else c, c if c in DAYS else None, 2, 0, 0) for c in values]
    out = types.typed(spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"`{c}` string" for c in values)), kinds)
    leap, month = dt.date(2024, 2, 29), dt.date(2024, 2, 1)
    assert [tuple(r) for r in out.collect()] == [
        (1234, 1.5, True, "a", *(leap if "d" in f else month for f in DAYS)), (None, None, None, None, *(None if "d" in f else dt.date(2023, 2, 1) for f in DAYS)),
    ]
    readings = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "RLIKE" in x]
    assert readings and not [x for x in readings if "*(" in x]


def test_files_with_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿day,code,amount,note\n20240105,0012,\"1,200\",x\n20240106,0013,,\n", "utf-8")
    (tmp_path / "b.csv").write_text("day;code;amount;note\n20240107;0014;7.5;한글\n", "cp949")
    out = types.read_typed_table(spark, f"file://{tmp_path}")
    assert dict(out.dtypes) == {"day": "date", "code": "string", "amount": "double", "note": "string"}
    assert {(r.day, r.code, r.amount, r.note) for r in out.collect()} == {(dt.date(2024, 1, 5), "0012", 1200.0, "x"), (dt.date(2024, 1, 6), "0013", None, None), (dt.date(2024, 1, 7), "0014", 7.5, "한글")}


@pytest.mark.parametrize(("value", "kind", "day"), [
    (20240105, "int", dt.date(2024, 1, 5)), (20240105.0, "double", dt.date(2024, 1, 5)), (202401.0, "double", dt.date(2024, 1, 1)), (202401, "long", dt.date(2024, 1, 1)), ("202113", "string", None),
    ("20240105.0", "string", dt.date(2024, 1, 5)), ("2021-10", "string", dt.date(2021, 10, 1)), ("2021/6/5", "string", dt.date(2021, 6, 5)), ("not_a_date", "string", None), (None, "string", None), (123456, "int", None), (float("nan"), "double", None),
])
def test_days(spark, value, kind, day):
    assert spark.createDataFrame([(value,)], f"x {kind}").select(parse_day(F.col("x")).alias("d")).first().d == day
