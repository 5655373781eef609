"""Sectors, shareholders, parents and currency scores on odd tables."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from quillon.operators import currency, entities


def test_industries_by_precedence(spark):
    t = lambda *xs: spark.createDataFrame(list(xs), "code string, industry string")
    learned, builtin = t(("263000", "exact"), ("4711", "late"), ("99", "two"), ("263000", "zz"), (None, "none")), t(("26", "IT"), ("264", "phones"), ("264111", "all six"), ("47111", "five aren't tried"))
    codes = ["263000", "264111", "264222", " 2690 ", "47115", "991", "1", "C26", "", None, "26"]
    df = spark.createDataFrame([(c,) for c in [*codes, "26"]], "code string")
    out = entities.industry_by_prefix(df, "code", learned, builtin).collect()
    assert len(out) == 12 and {r.code: r.industry for r in out} == {"263000": "exact", "264111": "all six", "264222": "phones", " 2690 ": "IT", "47115": "late", "991": "two", "1": None, "C26": None, "": None, None: None, "26": "IT"}
    assert entities.industry_by_prefix(df.limit(0), "code", learned, builtin).count() == 0


def test_sectors_by_division_range_and_letter(spark):
    details = spark.createDataFrame([("10", "Staples"), ("26", "IT")], "division string, sector string")
    ranges = spark.createDataFrame([(10, 33, "Industrials"), (35, 36, "Utilities"), (68, 68, "Real Estate")], "low int, high int, sector string")
    letters = spark.createDataFrame([("C", "Made"), ("k", "Money")], "letter string, sector string")
    want = {"10999": "Staples", "26": "IT", "12": "Industrials", "33": "Industrials", "34": "Unclassified", "35": "Utilities", "6812": "Real Estate", "69": "Unclassified", "09": "Unclassified", "7": "Unclassified", "c10": "Made", "K": "Money", "X": "Unclassified", "": "Unclassified", None: "Unclassified"}
    df = spark.createDataFrame([(c,) for c in [*want, "12"]], "code string")
    out = entities.sector_by_division(df, "code", details, ranges, letters).collect()
    assert len(out) == len(want) + 1 and {r.code: r.sector for r in out} == want


def test_shareholders(spark):
    master = spark.createDataFrame([("농심홀딩스", "NongShim Holdings", "072710", 3), ("농심홀딩스", "old", None, 1), ("삼성전자", None, "005930", 2), ("큰회사", "Big", "x", 4), (None, "none", None, 5), ("삼성", "short", None, 6)], "name string, name_en string, stock string, code int")
    names = ["농심홀딩스", " 삼성전자 ", "농심홀", "홀딩스", "딩스", "국민연금공단", "nps", "홍길동", "한국은행", "Someone Else", "", None]
    df = spark.createDataFrame([(n,) for n in [*names, "nps"]], "holder string")
    out = entities.largest_shareholders(df, "holder", master).collect()
    got = {r.holder: tuple(r)[1:] for r in out}
    assert len(out) == 13 and got == {
        "농심홀딩스": ("NONGSHIM HOLDINGS", "KOSPI / KOSDAQ", "KR7072710007", "exact"), " 삼성전자 ": ("삼성전자", "KOSPI / KOSDAQ", "KR7005930003", "exact"), "농심홀": ("NONGSHIM HOLDINGS", "KOSPI / KOSDAQ", "KR7072710007", "prefix_suffix"),
        "홀딩스": ("NONGSHIM HOLDINGS", "KOSPI / KOSDAQ", "KR7072710007", "prefix_suffix"), "딩스": ("딩스", "N/A (Individual)", "N/A", "individual"), "국민연금공단": ("NATIONAL_PENSION_SERVICE", "N/A", "N/A", "institution"), "nps": ("NATIONAL_PENSION_SERVICE", "N/A", "N/A", "institution"),
        "홍길동": ("홍길동", "N/A (Individual)", "N/A", "individual"), "한국은행": ("한국은행", "", "", "unmatched"), "Someone Else": ("Someone Else", "", "", "unmatched"), "": (None,) * 4, None: (None,) * 4,
    }


def test_subsidiary_status(spark):
    rows = [(" A ", "KR1", "subsidiary"), ("A", "", "delisted"), ("A", None, "international"), ("", "KR1", "x"), (None, None, None)]
    out = spark.createDataFrame(rows, "p string, i string, k string").select(entities.subsidiary_status(*map(F.col, "pik")).alias("s")).collect()
    assert [r.s for r in out] == ["Subsidiary (subsidiary of A - KR1)", "Delisted (subsidiary of A)", "Internationally Listed (subsidiary of A)", "Not listed", "Not listed"]


def test_parents_of_chains_and_circles(spark):
    chain = [(i, i + 1) for i in range(37)]
    circle = [(100, 101), (101, 102), (102, 100), (103, 100), (104, 104)]
    edges = spark.createDataFrame([*chain, chain[0], (200, 300), (200, 299), (None, 1), (1000, None), *circle], "c long, p long")
    got = {r.child: (r.root, r.depth) for r in entities.ultimate_parents(edges, "c", "p").collect()}
    assert got == {i: (37, 37 - i) for i in range(37)} | {200: (299, 1)} | dict.fromkeys((100, 101, 102, 103, 104), (None, None))
    assert entities.ultimate_parents(edges.limit(0), "c", "p").count() == 0


def _plain_scores(series: dict[str, list[tuple[int, float]]], day: int) -> tuple[float, float]:
    """Written from the definition: values up to the day, component by component."""
    x = {k: [v for d, v in sorted(s) if d <= day] for k, s in series.items()}
    clip = lambda v, b: max(-b, min(b, v))
    pct = lambda k, n: 100 * (x[k][-1] / x[k][-1 - n] - 1) if len(x.get(k, [])) > n and x[k][-1 - n] else None
    change = lambda k, n: x[k][-1] - x[k][-1 - n] if len(x.get(k, [])) > n else None
    mean = lambda n: sum(x["USDKRW"][-n:]) / n if len(x["USDKRW"]) >= n else None
    usd, steps = x["USDKRW"], [b - a for a, b in zip(x["USDKRW"], x["USDKRW"][1:], strict=False)][-14:]
    up, down = sum(max(s, 0) for s in steps) / 14, sum(max(-s, 0) for s in steps) / 14
    rsi = 50 if len(usd) < 15 or (not up and not down) else 100 if not down else 100 - 100 / (1 + up / down)
    swing = max(-25, -12.5 * ((rsi - 70) / 30 + 1)) if rsi >= 70 else min(25, 12.5 * ((30 - rsi) / 30 + 1)) if rsi <= 30 else clip((50 - rsi) * 0.2, 10)
    add = lambda parts: sum(clip(v * f, b) for v, f, b in parts if v is not None)
    near = 100 * (usd[-1] / mean(20) - 1) if mean(20) else None
    short = swing + add([(pct("USDKRW", 5), 5, 15), (pct("DXY", 5), 15, 15), (change("UST10Y", 5), 100, 10), (pct("KOSPI", 5), -5, 10), (pct("CNY", 5), 10, 10), (near, 10 if near is not None and abs(near) <= 1.5 else 5, 15)])
    oil = [v for v in (pct("WTI", 60), pct("BRENT", 60)) if v is not None]
    ratio = lambda a, b: 100 * (a / b - 1) if a is not None and b else None
    mid = add([(ratio(usd[-1], mean(200)), 4, 20), (ratio(mean(60), mean(200)), 6, 15), (pct("DXY", 60), 4, 20), (change("UST10Y", 60), 30, 15), (pct("KOSPI", 60), -1.5, 10), (sum(oil) / len(oil) if oil else None, 1, 10), (pct("CNY", 60), 4, 10)])
    return clip(short, 100), clip(mid, 100)


def test_currency_scores_as_of_days(spark):
    start = dt.date(2020, 1, 1)
    wave = lambda n, size, level: [(d, level + size * math.sin(d / n) + d * size / 300) for d in range(0, 260, 1 + n % 2)]
    series = {"USDKRW": wave(9, 20, 1200.0), "DXY": wave(4, 1, 95.0), "UST10Y": wave(6, 0.1, 3.0), "KOSPI": wave(5, 40, 2400.0), "WTI": wave(7, 3, 60.0)[:50], "CNY": [(200, 7.0), (201, 0.0)]}
    rows = [(k, start + dt.timedelta(d), v) for k, s in series.items() for d, v in s] + [("USDKRW", start + dt.timedelta(5000), None), ("unused", start, 1.0)]
    days = [0, 1, 2, 7, 14, 15, 30, 61, 100, 199, 201, 230, 259, 400]
    asked = spark.createDataFrame([(start + dt.timedelta(d),) for d in [*days, 30]], "day date")
    got = {(r.day - start).days: (r.short, r.mid) for r in currency.currency_scores(spark.createDataFrame(rows, "key string, day date, value double"), asked).collect()}
    assert set(got) == {d for d in days if sum(x <= d for x, _ in series["USDKRW"]) >= 2}
    for d, (short, mid) in got.items():
        want = _plain_scores(series, d)
        assert math.isclose(short, want[0], abs_tol=1e-8) and math.isclose(mid, want[1], abs_tol=1e-8), d
    said = spark.createDataFrame([(s, m) for s in (-40.0, -20.0, 0.0, 20.0, 40.0) for m in (-25.0, 0.0, 25.0)], "s double, m double").select(currency.advice(F.col("s"), F.col("m")).alias("a"), currency.verdict(F.col("s")).alias("v")).collect()
    assert [r.a for r in said] == ["at once", "in parts", "by need", "in parts", "in parts", "by need", "in parts", "by need", "only what is needed", "by need", "only what is needed", "only what is needed", "by need", "only what is needed", "wait"]
    assert [r.v for r in said][::3] == ["exchange", "rather exchange", "neutral", "rather wait", "wait"]
