"""Every query against its SQL, and the ones without SQL against what they must hold."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillon import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, str) else float(f"{float(v) + 0:.9g}")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got, want = _rows(df.columns, df.collect()), _rows(names, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)


def test_codes(spark, sf):
    rows = catalog.queries()["codes"](spark, sf).collect()
    assert all(r.code == f"{r.s_suppkey:06d}" for r in rows)
    for r in rows:
        digits = "".join(str(int(c, 36)) for c in r.isin)
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        assert total % 10 == 0


def test_name_matching(spark, sf):
    for r in catalog.queries()["name_matching"](spark, sf).collect():
        key = int(r.name.split("#")[1].split()[0])
        if key % 5 < 3:
            assert (r.matched, r.how) == (key, "exact" if key % 2 == 0 else "contains")


def test_name_matching_covers_all_customers(spark, sf):
    for r in catalog.queries()["name_matching"](spark, sf).collect():
        key = int(r.name.split("#")[1].split()[0])
        assert (r.matched, r.how) == (key, "exact" if key % 2 == 0 else "contains")


def test_names_of_any_script_length_and_direction(spark):
    from quillon.operators.text import match_names

    registry = ["㈜삼성전자", "LG", "네이버", "한국전력공사", "SK", "alpha beta gamma", "A", "ab cd", "日本電気", None, "..."]
    want = {
        "삼성전자": (0, "exact"), "주식회사 네이버": (2, "exact"), "삼성전자 우": (0, "contains"), "한국전력": (3, "contains"), "lg": (1, "exact"), "SKC": (4, "contains"),
        "S": (4, "contains"), "beta gamma": (5, "contains"), "alpha": (None, "none"), "a": (6, "exact"), "abcdx": (7, "contains"), "bcd": (7, "contains"), "日本電": (8, "contains"),
        "현대": (None, "none"), "": (None, "none"), "-": (None, "none"), None: (None, "none"),
    }
    left = spark.createDataFrame([(x,) for x in want for _ in (0, 1)], "name string")
    rows = match_names(left, spark.createDataFrame(list(enumerate(registry)), "id long, name string"), "name", "id").collect()
    assert len(rows) == 2 * len(want)
    for r in rows:
        assert (r.matched, r.how) == want[r.name], r


def test_year_pivot_covers_all_years(spark, sf, duck):
    sums = "SELECT 'y' || year(l_shipdate), sum(l_extendedprice * (1 - l_discount)) FROM lineitem GROUP BY 1"
    want = dict(duck.execute(sums).fetchall())
    wide = catalog.queries()["year_pivot_all"](spark, sf)
    rows = wide.collect()
    assert set(wide.columns) == {"company", *want} and len({r.company for r in rows}) == len(rows)
    for y, total in want.items():
        assert math.isclose(sum(r[y] or 0 for r in rows), total, rel_tol=1e-6)
    three = {r.company: r for r in catalog.queries()["year_pivot"](spark, sf).collect()}
    assert all(math.isclose(r[y] or 0, three[r.company][y] or 0, abs_tol=0.011) for r in rows for y in ("y1996", "y1997", "y1998"))


def test_fuzzy_and_sweep(spark, sf):
    assert all(0 <= r.ratio <= 1 for r in catalog.queries()["fuzzy_names"](spark, sf).collect())
    rows = catalog.queries()["currency_sweep"](spark, sf).collect()
    assert len(rows) == 8 and len({round(r.sold + r.left, 2) for r in rows}) == 1


def test_pool_holds_and_clears(spark):
    from quillon.operators.schedule import pool_simulation

    days = spark.createDataFrame([(0, 100.0, 1.0, 0.0), (1, 100.0, 2.0, 0.0), (2, 0.0, 4.0, 60.0), (3, 0.0, 8.0, 0.0)], "day long, inflow double, rate double, score double")
    grid = spark.createDataFrame([("a", 50.0, 90.0, 2), ("b", 50.0, 90.0, 9)], "scenario string, weak double, strong double, hold int")
    got = {r.scenario: (r.sold, r.avg_rate, r.forced, r.cleared, r.left) for r in pool_simulation(days, grid).collect()}
    # a: 100 by age and half of the rest at 4, the rest by age at 8; b: half at 4, the rest cleared at 8
    assert got == {"a": (200.0, 5.0, 150.0, 0.0, 0.0), "b": (200.0, 6.0, 0.0, 100.0, 0.0)}


def test_hold_sweep(spark, sf):
    rows = catalog.queries()["currency_hold_sweep"](spark, sf).collect()
    assert len(rows) == 56 and len({round(r.sold, 2) for r in rows}) == 1 and any(r.cleared > 0 for r in rows)


def test_backtest_costs(spark, sf, duck):
    from quillon.plans import dialect, research
    from quillon.sources.roles import FACTS_SQL

    sql = dialect.render(f"WITH {FACTS_SQL}, {research._FWD} SELECT code, ym, yoy, fwd FROM x WHERE yoy IS NOT NULL", 1).replace("{f}", "f")
    x = duck.execute(sql).df()
    x = x[x.groupby("ym")["yoy"].transform("count") >= 5].copy()
    x["q"] = x.groupby("ym")["yoy"].transform(lambda s: 1 + sum((s > s.quantile(p)).astype(int) for p in (0.2, 0.4, 0.6, 0.8)))
    x = x.dropna(subset=["fwd"])
    mean = x.pivot_table(index="ym", columns="q", values="fwd")
    ls, turnover = mean[5] - mean[1], (x.pivot_table(index="ym", columns="code", values="q").diff().abs() > 0).mean(axis=1)
    net = ls - turnover * 0.3
    rows = {r.ym: r for r in catalog.queries()["quintile_backtest_costs"](spark, sf).collect()}
    assert set(rows) == set(ls.index)
    assert all(math.isclose(rows[m].turnover, turnover[m], abs_tol=1e-3) and (math.isnan(net[m]) or math.isclose(rows[m].net, net[m], abs_tol=1e-3)) for m in rows)
    (total,) = catalog.queries()["quintile_backtest_summary"](spark, sf).collect()
    want = (ls.count(), 12**0.5 * ls.mean() / ls.std(), 12**0.5 * net.mean() / net.std(), 12 * ls.mean(), (ls.dropna() > 0).mean(), turnover.mean(), (ls.cumsum() - ls.cumsum().cummax()).min())
    assert all(math.isclose(a, b, abs_tol=1e-3) for a, b in zip(total, want, strict=True)), (total, want)


def test_collections_clamp(spark):
    from quillon.operators.schedule import expected_collections

    df = spark.sql("SELECT DATE '2024-01-31' AS start, DATE '2024-04-29' AS end, 1 AS months")
    assert [str(r.due) for r in expected_collections(df, "start", "end", "months").orderBy("period").collect()] == ["2024-01-31", "2024-02-29", "2024-03-31"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_strings_inside_names_are_not_broadcast(spark):
    from quillon.operators.text import match_names

    left = spark.createDataFrame([(f"harbor elec {i} x",) for i in range(50)], "name string")
    registry = spark.createDataFrame([(i, f"harbor elec {i}") for i in range(50)], "id long, name string")
    out = match_names(left, registry, "name", "id")
    assert {r.how for r in out.collect()} == {"contains"}
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0


def test_research_steps_are_worked_out_once(spark, sf):
    """Months and prices are read from the checkpoint folder: the order lines aren't in what is left of the plan."""
    from quillon import catalog

    for name in ("event_study", "quintile_backtest_costs"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "l_extendedprice" not in plan


def test_event_study_of_returns_that_compound_to_nothing(spark):
    """Quantities that come back after three months: whether such a return counts as a hit hangs on the last digit of its logarithms."""
    import random

    import duckdb
    from quillon import plans

    draw = random.Random(1)
    rows = []
    for k in range(120):
        base = [float(draw.randint(1, 50)) for _ in range(3)]
        rows += [(f"c{k}", f"{k:06d}", "s", 202301 + i, float(draw.randint(1, 999)), base[i % 3]) for i in range(12)]
    rows += [("z", "zero", "s", 202301 + i, float(i), [0.0, 2.0, 0.0][i % 3]) for i in range(12)] + [("n", "", "s", 202301, 1.0, 1.0), ("o", "one", "s", 202301, 1.0, 1.0)]
    columns = ("company", "code", "sector", "ym", "amt", "qty")
    facts = spark.createDataFrame(rows, "company string, code string, sector string, ym int, amt double, qty double")
    db = duckdb.connect()
    db.execute("CREATE TABLE facts (company VARCHAR, code VARCHAR, sector VARCHAR, ym INTEGER, amt DOUBLE, qty DOUBLE)")
    db.executemany("INSERT INTO facts VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = sorted(db.execute(plans.duckdb_sql("event_study", f"f AS (SELECT {', '.join(columns)} FROM facts)")).fetchall())
    got = sorted(tuple(r) for r in plans.run(spark, "event_study", facts).collect())
    assert len(want) >= 100 and [(r[0], r[1], float(r[3])) for r in got] == [(r[0], r[1], float(r[3])) for r in want]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-9) for a, b in zip(got, want, strict=True))
