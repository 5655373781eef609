"""Products, registry, universe and market operators on odd tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import factors, market, products, registry, universe
from quillon.sources import capabilities

REGISTRY = "code string, isin string, corp string, name_kr string, name_en string, reg_name string, stock string, listed boolean, modified int"


def _registry(spark):
    rows = [
        ("005930", "KR7005930003", "00126380", "삼성전자", "SamsungElec Co., Ltd.", "삼성전자(주)", "005930", True, 20240101),
        ("000660", "KR7000660001", "00164779", "SK하이닉스", "SK hynix Inc.", "SK하이닉스", "000660", True, 20230101),
        ("105930", None, None, None, None, "삼성", None, False, None),
        ("012345", None, None, "", "Alpha Beta Gamma", "삼성전자서비스", None, False, 20250101),
    ]
    return spark.createDataFrame(rows, REGISTRY)


def test_identify(spark):
    want = {
        "005930 KS Equity": ("005930", "ticker"), "000660.kq": ("000660", "ric"), "kr7005930003": ("005930", "isin"), "KR7005930009": ("005930", "isin_fixed"), "00126380": ("005930", "corp"),
        "660": ("000660", "code"), "345": ("012345", "code_end"), "930": (None, None), "삼성 전자": ("005930", "name"), "samsung electronics": ("005930", "spelling"), "SK-HYNIX": ("000660", "spelling"),
        "gamma alpha": ("012345", "words"), "beta": ("012345", "word"), "beta delta": (None, None), "co ltd": (None, None), "": (None, None), "  ": (None, None), None: (None, None),
    }
    asked = spark.createDataFrame([(q,) for q in want for _ in (0, 1)], "q string")
    rows = registry.identify(asked, "q", _registry(spark)).collect()
    assert len(rows) == 2 * len(want) and all((r.code, r.how) == want[r.q] for r in rows), rows
    assert registry.identify(asked, "q", _registry(spark).limit(0)).where("code IS NOT NULL").count() == 0


def test_candidates_and_matches(spark):
    asked = spark.createDataFrame([("㈜삼성전자", None), ("삼성", "A000660"), ("하이닉", None), ("nobody", "  "), (None, None)], "name string, stock_text string")
    got = {}
    for r in registry.candidates(asked, "name", _registry(spark)).orderBy("name", "rank").collect():
        got.setdefault(r.name, []).append((r.code, r.how))
    assert got == {
        "㈜삼성전자": [("005930", "exact"), ("012345", "partial"), ("105930", "partial")],
        "삼성": [("005930", "partial"), ("012345", "partial"), ("105930", "exact")],
        "하이닉": [("000660", "partial")] if 3 / 6 >= 0.5 else [],
    }
    how = {r.name: (r.code, r.how) for r in registry.match_registry(asked, "name", "stock_text", _registry(spark)).collect()}
    assert how == {"㈜삼성전자": ("005930", "exact"), "삼성": ("000660", "anchor"), "하이닉": ("000660", "partial"), "nobody": (None, "none"), None: (None, "none")}


def test_search_and_owners(spark):
    r = _registry(spark)
    assert [x.code for x in registry.search(r, ["name_kr", "name_en", "code"], "S K").collect()] == ["000660"]
    assert registry.search(r, ["name_kr"], " - ").count() == 0
    brands = spark.createDataFrame([("A", "Tea", "차"), ("B", "Tea", None), ("C", "A", " ")], "company string, en string, kr string")
    words = spark.createDataFrame([("Tea",), ("차",), ("A",), ("B",), ("x",), (None,)], "w string")
    got = {x.w: x.company for x in registry.keyword_companies(words, "w", brands, "company", brands, ["en", "kr"]).collect()}
    assert got == {"Tea": "B", "차": "A", "A": "C", "B": "B", "x": None, None: None}


def test_names_and_codes(spark):
    df = spark.createDataFrame([("신라면 묶음 3P", "KR7005930003"), ("", "kr7005930003"), ("a/b(c)", "KR700593000X"), (None, None)], "n string, i string")
    n, i = F.col("n"), F.col("i")
    rows = df.select(products.clean_name(n), products.promotions(n), products.romanized(n), products.isin_valid(i), products.isin_fixed(i), products.pack_count(n), products.token_set(n)).collect()
    assert [tuple(r) for r in rows] == [
        ("신라면 묶음 3-Pack", ["묶음"], "Sinramyeon Mukkeum 3p", True, "KR7005930003", 1, ["신라면", "묶음", "3", "p"]),
        ("", [], "", True, "kr7005930003", 1, []),
        ("a b c", [], "A/b(c)", False, "KR7005930003", 1, ["a", "b", "c"]),
        (None, [], None, False, None, 1, None),
    ]


def test_reviews_and_overrides(spark):
    df = spark.createDataFrame([("a", "x", 6.0), ("a", "y", 3.0), (None, "z", 1.0), ("b", "x", None)], "company string, brand string, amt double")
    got = [tuple(r) for r in universe.review_queue(df, ["company", "brand"], "amt", F.col("brand") == "y").orderBy("place").collect()]
    assert got == [("a", "x", 6.0, 60.0, 60.0, 1), (None, "z", 1.0, 10.0, 70.0, 2), ("b", "x", 0.0, 0.0, 70.0, 3)]
    assert universe.review_queue(df.limit(0), ["company"], "amt", F.lit(False)).count() == 0
    new = spark.createDataFrame([("x", "X"), ("y", " ")], "brand string, company string")
    assert sorted(map(tuple, universe.apply_overrides(df.select("brand", "company"), new, ["brand"], "company").collect()), key=repr) == [("x", "X"), ("x", "X"), ("y", "a"), ("z", None)]
    ids = lambda rows: universe.next_id(spark.createDataFrame(rows, "id string"), "id", "C").first()[0]
    assert (ids([("C007",), ("C1",), ("D999",), (None,)]), ids([("C999",)]), ids([])) == ("C008", "C1000", "C001")
    day = spark.createDataFrame([(dt.date(2023, 8, 31),)], "d date")
    assert day.select(universe.next_review(F.col("d"))).first()[0] == dt.date(2024, 2, 29)


def test_quality_of_odd_tables(spark):
    empty = spark.createDataFrame([], "company string, trend double, news double, products long, revision double, dispersion double, segment string, listed boolean")
    assert universe.recommendations(universe.scored_signals(empty)).count() == 0
    none = spark.createDataFrame([("a", None, None, None, None, None, None, None)], empty.schema)
    r = universe.recommendations(universe.scored_signals(none)).first()
    assert (r.heat, r.priority, r.status, r.action, r.confidence) == (None, None, "none", "collect data", "low")
    checks = {x.check: x for x in universe.quality_checks(spark.createDataFrame([], "id int, name string, amt double, mapped boolean"), spark.createDataFrame([], "price double, amt double"), ["name"], "id").collect()}
    assert checks["blank name"].severity == "ok" and checks["mapped share"].severity == "warning" and checks["overall"].severity == "warning"
    q = universe.numeric_quality(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), ["v"]).first()
    assert (q.n_total, q.n_null, q.n_outlier, q.mean) == (3, 2, 0, 1.0)
    assert spark.range(1).select(universe.catalog_quality(spark.range(1))).first()[0] == 0.0


def test_signals_of_short_and_flat_series(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [("led", day(n), float(100 + (n * 7) % 11), float(100 + ((n - 2) * 7) % 11), 1.0) for n in range(60)]
    rows += [("flat", day(n), 5.0, 5.0, 5.0) for n in range(60)] + [("short", day(n), n + 1.0, n + 2.0, 1.0) for n in range(4)] + [("gap", day(0), None, None, None)]
    got = {r.key: r for r in market.signals(spark.createDataFrame(rows, "key string, day date, sales double, price double, volume double"), "day").collect()}
    assert set(got) == {"led"} and got["led"].lag == 2 and got["led"].hit_rate == 100.0 and got["led"]["corr"] > 0.999 and got["led"].volume_corr is None


def test_calendar_months_of_the_panel(spark):
    rows = [("a", 1, 202301, 10.0, 1.0, True), ("a", 1, 202401, 30.0, 2.0, False), ("a", 2, 202402, 30.0, 0.0, None), (" ", 3, 202401, 1.0, 1.0, True), (None, 3, 202401, 1.0, 1.0, True)]
    panel = market.alpha_panel(spark.createDataFrame(rows, "code string, sku int, ym int, amt double, qty double, trend boolean")).orderBy("ym").collect()
    assert [(r.ym, r.sales_yoy, r.sales_mom, r.asp, r.newproduct_share, r.trend_share) for r in panel] == [(202301, None, None, 10.0, 100.0, 100.0), (202401, 200.0, None, 15.0, 0.0, 0.0), (202402, None, 0.0, None, 100.0, 0.0)]
    assert panel[2].available_date == dt.date(2024, 3, 15)


def test_alpha_score_of_missing_parts(spark):
    rows = [(None, 40.0, None, None, None, None), (30.0, None, None, None, None, None), (30.0, 40.0, 80.0, 0, 12, 0.9), (None, None, None, 3, None, 0.4), (-90.0, -90.0, -9.0, 99, 0, None)]
    df = spark.createDataFrame(rows, "mom double, yoy double, demand double, anomalies int, periods int, lead_corr double")
    assert [r.alpha for r in factors.alpha_score(df).collect()] == [0.0, 26.0, 100.0, 12.2, 0.0]


def test_neutralised_rows_without_sector_or_spread(spark):
    rows = [(1, "s", 1.0, 1.0), (1, "s", 3.0, 2.0), (1, "t", 5.0, 3.0), (1, None, 7.0, 4.0), (1, "s", None, 5.0), (2, "s", 2.0, None)]
    df = spark.createDataFrame(rows, "date int, sector string, x double, cap double")
    got = {r.x: (r.z and round(r.z, 9), r.p) for r in factors.neutralised(factors.neutralised(df, "x", "z", ("sector_z",)), "x", "p", ("rank_pct",)).collect()}
    half = round(0.5**0.5, 9)
    assert got == {1.0: (-half, 0.5), 3.0: (half, 1.0), 5.0: (None, 1.0), 7.0: (None, None), None: (None, None), 2.0: (None, 1.0)}
    assert {r.x: r.n for r in factors.neutralised(df, "x", "n", ("cap_neutral",)).collect()}[2.0] is None
    with pytest.raises(ValueError):
        factors.neutralised(df, "x", "z", ("size",))


def test_capabilities():
    assert capabilities({"dt": "d", "brand": "b"}) == {"grain": "brand", "missing": ["amt"], "has_sku": False, "has_brand": True, "has_cat1": False, "has_qty": False, "has_region": False}


def test_review_queue_equal_sales_go_by_name(spark):
    """The same amounts in other orders add up to doubles that differ in their last digits."""
    amounts = [0.1, 0.2, 0.3]
    rows = [(b, x) for b, order in (("c", 1), ("b", -1), ("a", 1)) for x in amounts[::order]]
    df = spark.createDataFrame(rows, "brand string, amt double").coalesce(1)
    got = universe.review_queue(df, ["brand"], "amt", F.lit(False)).orderBy("place").collect()
    assert [r.brand for r in got] == ["a", "b", "c"] and len({r.sales for r in got}) == 1


def test_delivery_facts_sort_by_a_number_first(spark):
    """Up to round 3 the tiers were sorted by names alone, which begin alike, so that every comparison read whole rows."""
    rows = [("a", None, 1, 202301, 10.0, 1.0), ("a", None, 1, 202301, 5.0, 1.0), ("a", None, 1, 202302, 30.0, 2.0), ("a", "b", None, 202401, 45.0, 3.0), (None, None, None, 202401, 7.0, 1.0)]
    out = market.delivery_facts(spark.createDataFrame(rows, "company string, brand string, sku long, ym int, amt double, qty double"))
    got = {(r.tier, r.company, r.brand, r.sku, r.ym): (r.sales, r.yoy, r.mom) for r in out.collect()}
    assert got == {
        ("sku", "a", None, 1, 202301): (15.0, None, None), ("sku", "a", None, 1, 202302): (30.0, None, 100.0), ("sku", "a", "b", None, 202401): (45.0, None, None), ("sku", None, None, None, 202401): (7.0, None, None),
        ("brand", "a", None, None, 202301): (15.0, None, None), ("brand", "a", None, None, 202302): (30.0, None, 100.0), ("brand", "a", "b", None, 202401): (45.0, None, None), ("brand", None, None, None, 202401): (7.0, None, None),
        ("company", "a", None, None, 202301): (15.0, None, None), ("company", "a", None, None, 202302): (30.0, None, 100.0), ("company", "a", None, None, 202401): (45.0, 200.0, None), ("company", None, None, None, 202401): (7.0, None, None),
    }
    sorts = [x.split("Sort [")[1] for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Sort [" in x] or [x.split("Window [")[1].split("], [")[1] for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window [" in x]
    assert len(sorts) == 3 and all(x.startswith("__h") for x in sorts)
    assert "__h" not in out.columns
