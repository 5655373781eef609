"""Signal studies on odd tables: gaps, nulls, constant and short series, shared codes."""

from __future__ import annotations

import datetime as dt

import pytest

from quillon.operators import studies

SALES = "key string, day date, sales double, tx long"
PRICES = "key string, day date, price double, volume double"


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)  # a Monday


def test_gaps(spark):
    """The first empty period falls by 100, growth from 0 is null; repeated days add up; rows without a day go."""
    rows = [("a", _day(0), 10.0, 1), ("a", _day(0), 10.0, 1), ("a", _day(1), 30.0, 3), ("a", _day(4), 5.0, 1), ("a", None, 9.0, 9), (None, _day(0), None, None)]
    got = {(r.key, (r.period - _day(0)).days): (r.growth, r.tx_growth) for r in studies.sales_periods(spark.createDataFrame(rows, SALES), "day").collect()}
    assert got == {("a", 0): (None, None), ("a", 1): (50.0, 50.0), ("a", 2): (-100.0, -100.0), ("a", 4): (None, None), (None, 0): (None, None)}
    months = [("a", dt.date(2024, 1, 31), 10.0, 1), ("a", dt.date(2024, 2, 29), 20.0, None), ("a", dt.date(2024, 4, 30), 1.0, 1)]
    got = [(r.period.month, r.growth) for r in studies.sales_periods(spark.createDataFrame(months, SALES), "month").orderBy("period").collect()]
    assert got == [(1, None), (2, 100.0), (3, -100.0), (4, None)]


def test_prices(spark):
    """Weeks take their last known price, and the return skips weeks without one; volume after an empty week is unknown."""
    rows = [("a", _day(0), 10.0, 1.0), ("a", _day(3), 20.0, 1.0), ("a", _day(4), None, 2.0), ("a", _day(8), None, 8.0), ("a", _day(15), 30.0, None), ("a", _day(29), 15.0, 1.0), ("a", None, 1.0, 1.0)]
    got = [((r.period - _day(0)).days, r.ret, r.volume_change) for r in studies.price_periods(spark.createDataFrame(rows, PRICES), "week").orderBy("period").collect()]
    assert got == [(0, None, None), (14, 50.0, -100.0), (28, -50.0, None)]
    days = [(r.ret, r.volume_change) for r in studies.price_periods(spark.createDataFrame(rows[:3] + rows[5:], PRICES), "day").orderBy("period").collect()]
    assert days == [(None, None), (100.0, 0.0), (-25.0, -50.0)]


@pytest.fixture(scope="module")
def series(spark):
    """Returns follow growth by two rows; constant and short keys beside it."""
    growth = [1.0, -2.0, 3.0, 5.0, -4.0, 0.5, 7.0, -1.0, 2.0, 9.0, -3.0, 4.0]
    rows = [("a", _day(i), g, growth[i - 2] if i > 1 else 6.0, float(i)) for i, g in enumerate(growth)]
    rows += [("flat", _day(i), 1.0, 2.0, None) for i in range(6)] + [("short", _day(i), float(i), 1.0, 1.0) for i in range(3)]
    return spark.createDataFrame(rows, "key string, period date, growth double, ret double, volume_change double")


def test_lags(series):
    got = {(r.key, r.lag): (r.corr, r.n) for r in studies.lag_table(series, "growth", "ret", 20).collect()}
    assert got[("a", 2)] == (1.0, 10) and {k for k, _ in got} == {"a"} and ("a", 10) in got and ("a", 11) not in got
    assert studies.lag_table(series.limit(0), "growth", "ret", 3).count() == 0


def test_rolling(series):
    rows = {(r.key, r.period): (r.roll_short, r.roll_long) for r in studies.rolling_pair(series, (3, 12)).collect()}
    assert rows[("a", _day(1))] == (None, None) and rows[("a", _day(2))][0] is not None and rows[("a", _day(11))][1] is not None
    assert all(v == (None, None) for (k, _), v in rows.items() if k == "flat")


def test_events(series):
    """Twelve values: the ninetieth percentile lies at 6.8, so 7 and 9 are events; the second has two rows after it."""
    got = {(r.key, r.horizon): r for r in studies.event_study(series, "growth", (1, 3)).collect()}
    one, three = got[("a", 1)], got[("a", 3)]
    assert (one.n_events, one.n, three.n) == (2, 2, 1) and one.threshold == pytest.approx(6.8)
    assert one.ret == pytest.approx((0.5 + 2.0) / 2) and three.ret == pytest.approx(100 * (1.005 * 1.07 * 0.99 - 1))
    assert got[("flat", 1)].n_events == 6 and ("short", 1) not in got
    assert studies.event_study(series, "volume_change", (1,)).where("key = 'flat'").count() == 0


def test_states(spark):
    days = [_day(7 * i + 2) for i in range(12)]
    wave = [10.0, 20.0, 15.0, 30.0, 22.0, 40.0, 31.0, 35.0, 50.0, 45.0, 60.0, 52.0]
    sales = spark.createDataFrame([(c, d, x, 1) for c in ("full", "twin", "blank", "unpriced") for d, x in zip(days, wave, strict=True)] + [("new", days[0], 1.0, 1)], "company string, day date, sales double, tx long")
    prices = spark.createDataFrame([("1", d, x, 5.0) for d, x in zip(days, wave[::-1], strict=True)] + [("3", days[0], None, 1.0)], "code string, day date, price double, volume double")
    codes = spark.createDataFrame([("full", "1"), ("twin", " 1 "), ("new", "1"), ("blank", " "), ("none", None), ("unpriced", "3")], "company string, code string")
    got = {r.company: (r.status, r.freq) for r in studies.company_signals(sales, prices, codes).collect()}
    assert got == {"full": ("ok", "week"), "twin": ("ok", "week"), "new": ("insufficient", None), "blank": ("no code", None), "none": ("no code", None), "unpriced": ("no prices", None)}
    assert studies.universe_signals(sales, prices.limit(0)).count() == 0
