"""The factor research chain on odd tables: nulls, ties, missing sectors, short series, empty tables; targets against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillon.operators import chain

PRICES = "code string, day date, price double"


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_signal_day(spark):
    """Five business days after 31 January 2024 (Wednesday), 31 March (Sunday), 31 August (Saturday)."""
    rows = spark.createDataFrame([(202401,), (202403,), (202408,), (None,)], "ym int")
    got = {r.ym: r.d for r in rows.select("ym", chain.signal_day(F.col("ym")).alias("d")).collect()}
    assert got == {202401: dt.date(2024, 2, 7), 202403: dt.date(2024, 4, 5), 202408: dt.date(2024, 9, 6), None: None}


def test_targets(spark):
    draw = random.Random(5)
    series = {c: [(_day(i), draw.uniform(50, 150)) for i in range(30) if draw.random() < 0.8 or i == 3] for c in "abcde"}
    sector = {"a": "x", "b": "x", "c": "x", "d": "y"}
    index = [(_day(i), 100.0 + i) for i in range(28)]
    rows = [(c, d, p) for c, s in series.items() for d, p in s] + [("a", _day(40), None)]
    horizons = {"s": 2, "l": 9}

    def ahead(s, d, n):
        days = [x for x, _ in s]
        i = days.index(d) if d in days else None
        return None if i is None or i + n + 1 >= len(s) else 100 * (s[i + n + 1][1] / s[i + 1][1] - 1)

    want = {}
    for d in (_day(3), _day(7), _day(25)):
        for h, n in horizons.items():
            raw = {c: r for c, s in series.items() if (r := ahead(s, d, n)) is not None}
            market = ahead(index, d, n)
            for c, r in raw.items():
                want[(c, d, h, "raw")] = r
                if market is not None:
                    want[(c, d, h, "excess")] = r - market
                if c in sector:
                    want[(c, d, h, "sector_rel")] = r - statistics.median(raw[o] for o in raw if sector.get(o) == sector[c])
    days = spark.createDataFrame([(_day(3),), (_day(3),), (_day(7),), (_day(25),), (None,)], "day date")
    sectors = spark.createDataFrame([*sector.items(), ("e", None)], "code string, sector string")
    out = chain.targets(spark.createDataFrame(rows, PRICES), spark.createDataFrame(index, "day date, price double"), sectors, days, horizons).collect()
    got = {(r.code, r.day, r.horizon, r.kind): r.target for r in out}
    assert len(out) == len(got) and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    for kinds in (("sector_rel",), ("raw",), ("excess",)):  # what isn't read isn't worked out
        some = chain.targets(spark.createDataFrame(rows, PRICES), spark.createDataFrame(index, "day date, price double"), sectors, days, horizons, kinds).collect()
        assert sorted(some) == sorted(r for r in out if r.kind in kinds)
    assert chain.targets(spark.createDataFrame([], PRICES), spark.createDataFrame([], "day date, price double"), sectors, days).count() == 0


def test_signals(spark):
    """Fourteen months of four codes: growth from the thirteenth on, one code without a sector, one without prices in time."""
    months = [202300 + m for m in range(1, 13)] + [202401, 202402]
    panel = [(c, ym, 100.0 + k * i + i % 3, 10 + i) for k, c in enumerate("abcd", 1) for i, ym in enumerate(months)] + [(None, 202401, 1.0, 1), ("a", None, 1.0, 1)]
    prices = [(c, dt.date(2024, m, 12), 1.0) for c in "abc" for m in (2, 3)] + [("d", dt.date(2024, 2, 25), 1.0), ("a", dt.date(2024, 2, 7), None)]
    sectors = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "x")], "code string, sector string")
    rows = chain.signals(spark.createDataFrame(panel, "code string, ym int, sales double, tx long"), spark.createDataFrame(prices, PRICES), sectors).collect()
    growth = {(r.code, r.ym): (r.day, r.value) for r in rows if r.feature == "yoy"}
    one = chain.signals(spark.createDataFrame(panel, "code string, ym int, sales double, tx long"), spark.createDataFrame(prices, PRICES), sectors, ("yoy",)).collect()
    assert sorted(one) == sorted(r for r in rows if r.feature == "yoy")
    assert {k: d for k, (d, _) in growth.items()} == {(c, ym): dt.date(2024, ym - 202400 + 1, 12) for c in "ab" for ym in (202401, 202402)}
    assert growth[("a", 202401)][1] == pytest.approx(-(0.5**0.5)) and growth[("b", 202401)][1] == pytest.approx(0.5**0.5)
    assert all(r.code in "ab" for r in rows)


@pytest.fixture(scope="module")
def pair(spark):
    """Targets that follow values in two months and oppose them in a third; a fourth month is short, a fifth constant."""
    found, goals = [], []
    for m, (ym, n, sign) in enumerate([(202401, 10, 1), (202402, 10, 1), (202403, 10, -1), (202404, 4, 1), (202405, 10, 0)]):
        for i in range(n):
            found.append((f"c{i}", ym, _day(31 * m), "x", "yoy", float(i)))
            goals.append((f"c{i}", _day(31 * m), "1m", "sector_rel", float(sign * i)))
    return spark.createDataFrame(found, "code string, ym int, day date, sector string, feature string, value double"), spark.createDataFrame(goals, "code string, day date, horizon string, kind string, target double")


def test_lag_decay(pair):
    row = chain.lag_decay(*pair).collect()
    assert len(row) == 1 and row[0].n == 3 and row[0].ic == pytest.approx(1 / 3) and row[0].hit == pytest.approx(2 / 3)
    assert row[0].icir == pytest.approx((1 / 3) / statistics.stdev([1, 1, -1])) and row[0].t == pytest.approx(row[0].icir * 3**0.5)
    one = chain.lag_decay(pair[0].where("ym = 202401"), pair[1]).first()
    assert (one.sd, one.icir, one.t) == (0.0, 0.0, 0.0)
    assert chain.lag_decay(pair[0].limit(0), pair[1]).count() == 0


def test_backtest(spark, pair):
    months = {r.ym: r for r in chain.backtest(*pair).collect()}
    assert set(months) == {202401, 202402, 202403, 202405}
    assert (months[202401].low, months[202401].high, months[202401].ls, months[202401].turnover) == (0.5, 8.5, 8.0, 0.0) and months[202403].ls == -8.0
    total = chain.performance(chain.backtest(*pair)).first()
    assert (total.n, total.hit, total.annual, total.max_drawdown) == (4, 0.5, 24.0, -8.0)
    assert tuple(chain.performance(chain.backtest(pair[0].limit(0), pair[1])).first())[:3] == (0, 0.0, 0.0)


def test_fifths(spark):
    """Equal values share a part, and parts without values take no number."""
    rows = spark.createDataFrame([("g", v) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0)] + [("few", 1.0)] + [(None, float(i)) for i in range(5)], "g string, v double")
    got = sorted((r.g, r.v, r.q) for r in chain.fifths(rows.where("g IS NOT NULL"), ["g"], "v").collect())
    assert got == [("g", 1.0, 1)] * 4 + [("g", 2.0, 1), ("g", 3.0, 2)]


def test_wide_lag_decay(spark):
    """One row a code and month gives what the long tables of pairs give, and the pairs of features and targets are never rows that move."""
    draw = random.Random(8)
    months = [2022 * 100 + m for m in range(1, 13)] + [2023 * 100 + m for m in range(1, 13)]
    codes = [f"c{i}" for i in range(16)]
    panel = spark.createDataFrame([(c, ym, float(draw.randint(0, 9)), draw.randint(1, 3)) for c in codes for ym in months if draw.random() < 0.95], "code string, ym int, sales double, tx long")
    prices = spark.createDataFrame([(c, dt.date(2022, 1, 1) + dt.timedelta(d), draw.choice([None, 0.0, 5.0, draw.uniform(5, 9)])) for c in codes for d in range(0, 800, 2)], PRICES)
    index = spark.createDataFrame([(dt.date(2022, 1, 1) + dt.timedelta(d), draw.uniform(5, 9)) for d in range(0, 760, 2)], "day date, price double")
    sectors = spark.createDataFrame([(c, None if c == "c0" else int(c[1:]) % 2) for c in codes], "code string, sector int")
    found = chain.wide_signals(panel, prices, sectors).drop("sector")
    wide = chain.wide_lag_decay(chain.wide_targets(prices, index, sectors, found.select("day"), found=found))
    signals = chain.signals(panel, prices, sectors)
    long = chain.lag_decay(signals, chain.targets(prices, index, sectors, signals.select("day")))
    key = lambda r: (r.feature, r.kind, r.horizon)
    got, want = sorted(wide.collect(), key=key), sorted(long.select(wide.columns).collect(), key=key)
    assert len(want) >= 50 and [(*key(r), r.n) for r in got] == [(*key(r), r.n) for r in want]
    assert all(a[c] == pytest.approx(b[c], abs=1e-9) for a, b in zip(got, want, strict=True) for c in ("ic", "sd", "icir", "t", "hit"))
    assert chain.wide_lag_decay(chain.wide_targets(prices.limit(0), index, sectors, found.select("day"), found=found)).count() == 0


def test_factor_decay_moves_a_row_once(spark, sf):
    """Up to round 3 every pair of a feature and a target was a row, shuffled and sorted for its rank."""
    from quillon.operators import chain_queries

    plan = chain_queries.factor_decay(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "rank(" not in plan
