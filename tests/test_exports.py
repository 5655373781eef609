"""Masters under any header, enriched rows, templates and small views on odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import exports as x


def test_user_master_by_any_header(spark):
    df = spark.createDataFrame([(" A ", 5930, "KR1", "later", "K"), (None, None, None, "x", None), ("B", 1234567, "", "y", "")], "Company_Name string, `종목코드` long, ISU_CD string, brand string, `시장` string")
    got = [tuple(r) for r in x.user_master(df).orderBy("name").collect()]
    assert x.user_master(df).columns == list(x.MASTER_COLUMNS)
    assert got == [("", "", "", "", "", "", ""), ("KR1", "005930", "A", "A", "", "K", ""), ("", "1234567", "B", "B", "", "", "")]
    for bad in ("brandless string, code string", "name string, other string"):
        with pytest.raises(ValueError):
            x.user_master(spark.createDataFrame([], bad))
    assert x.user_master(df.limit(0)).count() == 0


def test_enriched_daily_falls_back_to_names(spark):
    daily = spark.createDataFrame([(20240131, "r1", "1", "a", "b", None), (20240131, "r9", "7", "a", "a", "z"), (None, None, None, None, None, None)], "date int, region string, barcode string, cat_l1 string, cat_l2 string, cat_l3 string")
    keys = spark.createDataFrame([(1, "sku b"), (1, "sku a"), (None, "none")], "barcode long, sku_id string")
    regions = spark.createDataFrame([("r1", "One"), ("r1", "Uno"), (None, "Null")], "region string, region_en string")
    categories = spark.createDataFrame([("a", "Alpha"), ("z", None)], "category string, category_en string")
    rows = {r.barcode: r for r in x.enriched_daily(daily, keys, regions, categories, 1).collect()}
    assert len(rows) == 3 and (rows["1"].available_date, rows["1"].sku_id, rows["1"].region_en, rows["1"].cat_l1_en, rows["1"].cat_l2_en, rows["1"].cat_l3_en) == ("2024-02-01", "sku a", "One", "Alpha", "b", None)
    assert (rows["7"].sku_id, rows["7"].region_en, rows["7"].cat_l2_en, rows["7"].cat_l3_en) == (None, "r9", "Alpha", "z") and rows[None].available_date is None


def test_templates(spark):
    plan = x.template_plan({"데이터 사전": ["a", "b"], "TR_BASIC_1": ["거래일", "거래금액", "거래금액", "모름", " "], "회사정보 list": ["ISIN", "회사명"], "other": ["x"], "empty": []})
    assert [(p["sheet"], p["kind"]) for p in plan] == [("TR_BASIC_1", "TR_BASIC"), ("회사정보 list", "List"), ("other", "OTHER")]
    assert [c["from"] for c in plan[0]["columns"]] == ["date", "sales_amount", "sales_amount", ""] and [c["from"] for c in plan[1]["columns"]] == ["isin", "company_name_en"]
    sales = spark.createDataFrame([("2024-01-01", 5.0)], "date string, sales_amount double")
    out = x.by_template({"TR_BASIC": sales}, plan)
    assert list(out) == ["TR_BASIC_1"] and out["TR_BASIC_1"].columns == ["거래일", "거래금액", "거래금액_2", "모름"] and tuple(out["TR_BASIC_1"].first()) == ("2024-01-01", 5.0, 5.0, "")
    assert x.sheet_kind("기본매출") == "TR_BASIC" and x.sheet_kind("Dictionary of lists") is None


def test_rows_signals_and_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), (None, 2.0), (" ", 4.0), ("a", 3.0)], "k string, v double")
    assert {(r.k, r.v) for r in x.with_required(df, ["v", "k"]).collect()} == {("a", 1.0), (" ", 4.0), ("a", 3.0)} and x.with_required(df, []).count() == 6
    known = df.where("NOT isnan(v)")
    assert [tuple(r) for r in x.top_by_sales(known, "k", "v", 1).collect()] == [("a", 4.0, 40.0)] and x.top_by_sales(known.limit(0), "k", "v", 1).count() == 0
    pairs = [(5.0, 5.0), (5.0, -6.0), (9.0, 0.0), (-6.0, 5.0), (0.0, 5.0), (-6.0, -6.0), (-6.0, -5.0), (4.9, -6.0), (-5.0, 4.9), (None, 5.0)]
    got = [r.s for r in spark.createDataFrame(pairs, "v double, p double").select(x.demand_signal(F.col("v"), F.col("p")).alias("s")).collect()]
    assert got == ["volume and price", "volume, price falls", "volume", "price, volume falls", "price", "both fall", "volume falls", "price falls", "steady", "unknown"]
    days = spark.createDataFrame([("20230101",), ("20221231",), (None,)], "d string")
    assert [r.n for r in days.select(x.new_products(days, "d").alias("n")).collect()] == [True, False, False]


def test_universe_and_earnings(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    one, two = t([("1", "a"), ("2", "b"), (None, "n")], "code string, name string"), t([("2", "other"), ("3", "c")], "code string, name string")
    caps = t([("1", 5.0), ("1", 7.0), ("3", None), ("9", 1.0)], "code string, cap double")
    assert {tuple(r) for r in x.market_universe({"K": one, "Q": two}, caps).collect()} == {("1", "a", "K", 7.0), ("2", "b", "K", None), ("3", "c", "Q", None)}
    assert [r.code for r in x.market_universe({"K": one, "Q": two}, caps, 2).collect()] == ["1", "2"]
    quarters = t([("A", q, float(s)) for q, s in ((20231, 10), (20232, 0), (20233, 5), (20234, 8), (20241, 20))] + [("B", 20241, 10.0)], "company string, quarter int, sales double")
    said = t([("B", 20241, 3.0, "r2"), ("A", 20241, 4.0, None), ("A", 20199, 1.0, "old")], "company string, quarter int, disclosed double, report string")
    got = {r.quarter: tuple(r)[1:] for r in x.all_company_earnings(quarters, said).collect()}
    assert set(got) == {20231, 20232, 20233, 20234, 20241} and got[20241] == (30.0, 275.0, 200.0, 7.0, "r2") and got[20233][1] is None
    returns = t([(1, 2.0), (2, 3.0)], "day int, ret double")
    assert {tuple(r) for r in x.excess_returns(returns, t([(1, 0.5)], "day int, ret double"), "day").collect()} == {(1, 2.0, 0.5, 1.5), (2, 3.0, None, None)}
