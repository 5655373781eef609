from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators.selection import apply_filters
from quillon.sources import bind_roles, detect_encoding, latest_parquet, read_text_table, sniff_separator, write_delivery
from quillon.streaming import drain, tumbling_totals


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름;값\n가;1\n나;2\n".encode("cp949"))
    rows = read_text_table(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("가", "1"), ("나", "2")]
    assert detect_encoding("é".encode()) == "utf-8" and sniff_separator("a|b|c") == "|"


def test_roles(spark):
    df = spark.createDataFrame([("2024-01-05", "x", "7.5"), ("2024-02-05", "y", "bad")], "d string, n string, v string")
    rows = bind_roles(df, {"dt": "d", "company": "n", "amt": "v"}).select("ym", "amt", "brand").collect()
    assert [tuple(r) for r in rows] == [(202401, 7.5, None), (202402, None, None)]
    with pytest.raises(ValueError):
        bind_roles(df, {"dt": "d"})


def test_delivery_and_latest(spark, tmp_path):
    t = spark.range(3)
    assert write_delivery({"t": t}, f"file://{tmp_path}/out").count() == 1
    t.coalesce(1).write.parquet(f"file://{tmp_path}/p")
    assert latest_parquet(spark, f"{tmp_path}/p").count() == 3


def test_range_filter_and_nulls(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert apply_filters(df, ranges={"x": (1, 5)}).count() == 3
    assert apply_filters(df, ranges={"x": (2, 5)}).count() == 1


def test_stream_is_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in drain(tumbling_totals(stream)).collect()}
    assert got == {tuple(r) for r in tumbling_totals(events).collect()}


def test_every_file_in_its_own_form(spark, tmp_path):
    from quillon.sources import peek_columns

    late = "x,y\n" + "1,a\n" * 30_000  # the only line that isn't UTF-8 comes after 64 KB
    (tmp_path / "a b+c.csv").write_bytes(late.encode() + "2,가\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("﻿z;x\nü;3\n".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.xlsx").write_bytes(b"PK\x00")
    rows = read_text_table(spark, str(tmp_path))
    assert sorted(rows.columns) == ["x", "y", "z"] and rows.count() == 30_002
    assert {tuple(r) for r in rows.where("x > 1").select("x", "y", "z").collect()} == {("2", "가", None), ("3", None, "ü")}
    assert peek_columns(spark, str(tmp_path / "b.csv")) == ["z", "x"]
    with pytest.raises(ValueError):
        read_text_table(spark, str(tmp_path / "c.txt"))


def test_range_filter_runs_nothing_itself(spark):
    df = spark.range(3).select(F.raise_error(F.lit("ran")).cast("int").alias("x"))
    assert apply_filters(df, ranges={"x": (1, 5)}).columns == ["x"]
    empty = spark.createDataFrame([(None,)], "x int")
    assert apply_filters(empty, ranges={"x": (1, 5)}).count() == 1 and apply_filters(empty.limit(0), ranges={"x": (1, 5)}).count() == 0
