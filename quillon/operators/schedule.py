"""Receivable schedules and the currency pool."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_collections(contracts: DataFrame, start: str, end: str, months: str) -> DataFrame:
    """A row per due date from start to end every ``months`` months; a day that a month lacks is its last one."""
    n = F.floor(F.months_between(F.col(end), F.col(start)) / F.col(months)).cast("int")
    steps = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array())
    return contracts.withColumn("period", F.explode(steps)).withColumn("due", F.add_months(F.col(start), F.col("period") * F.col(months)))


def payout_due(day: Column) -> Column:
    """The end of the first month of the next quarter."""
    return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 3))


def stage(due: Column, invoiced: Column, paid: Column, today: Column, days: int = 30) -> Column:
    return (
        F.when(paid.isNotNull(), "done").when(invoiced.isNotNull() & (F.date_add(due, days) < today), "overdue")
        .when(invoiced.isNotNull(), "waiting").when(due <= today, "to_invoice").otherwise("planned")
    )


def pool_simulation(days: DataFrame, scenarios: DataFrame, max_age: int = 30) -> DataFrame:
    """A first-in-first-out pool of currency per scenario: inflow joins it each day, what is ``hold`` days old is sold, then
    the share of the rest that the score asks for, and what remains is cleared at the last day's rate. ``days``: day long,
    inflow double, rate double, score double (bounded by the calendar); ``scenarios``: scenario string, weak double, strong
    double, and hold (days) unless it is ``max_age`` for all. ``sold`` and ``avg_rate`` hold all sales; ``forced`` those by
    age and ``cleared`` those at the end are parts of ``sold``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        pool: deque[list[float]] = deque()
        got = forced = wanted = cleared = 0.0
        for r in pdf.itertuples():
            pool.append([r.day, r.inflow])
            old = 0.0
            while pool and r.day - pool[0][0] >= r.hold:
                old += pool.popleft()[1]
            share = 1.0 if r.score >= r.strong else 0.5 if r.score >= r.weak else 0.0
            left = asked = share * sum(x[1] for x in pool) if share else 0.0
            while pool and left > 1e-9:
                part = min(pool[0][1], left)
                left -= part
                pool[0][1] -= part
                if pool[0][1] <= 1e-9:
                    pool.popleft()
            forced, wanted, got = forced + old, wanted + asked, got + (old + asked) * r.rate
        if len(pdf):
            cleared = sum(x[1] for x in pool)
            got += cleared * pdf["rate"].iloc[-1]
        sold = forced + wanted + cleared
        return pd.DataFrame({"scenario": pdf["scenario"].iloc[:1], "sold": sold, "avg_rate": got / sold if sold else None, "forced": forced, "cleared": cleared, "left": 0.0})

    grid = scenarios.where("strong >= weak")
    if "hold" not in grid.columns:
        grid = grid.withColumn("hold", F.lit(max_age))
    return days.join(F.broadcast(grid)).groupBy("scenario").applyInPandas(fold, "scenario string, sold double, avg_rate double, forced double, cleared double, left double")
