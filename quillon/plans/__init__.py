"""Plans over role-bound facts. ``run`` applies one to any DataFrame that ``sources.bind_roles`` made."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.ranks import settled
from quillon.plans import aggregates, research, series
from quillon.plans.dialect import render
from quillon.plans.scaled import SCALED
from quillon.sources.roles import ROLES

PLANS: dict[str, str] = aggregates.PLANS | series.PLANS | research.PLANS


#: What a plan's ``:name``s stand for unless ``run`` is given something else.
PARAMETERS: dict[str, dict[str, object]] = {
    "pit_latest": {"as_of": dt.date(1998, 6, 15), "lag_days": 7},
    "category_category_filter": {"category": "PROMO", "pattern": "S%"},
    "sales_coverage": {"covered": "[13]$"},
    "asp_outliers": {"least": 100, "most": 1800},
    "anomaly_events": {"threshold": 1.8},
}


def roles(name: str) -> set[str]:
    """The roles that a plan reads."""
    return {r for r in ROLES if re.search(rf"\b{r}\b", PLANS[name])}


def run(spark: SparkSession, name: str, facts: DataFrame, **parameters: object) -> DataFrame:
    """A plan over ``facts``; ``parameters`` replace those that it has (``PARAMETERS``), others raise."""
    known = PARAMETERS.get(name, {})
    if unknown := set(parameters) - set(known):
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    if name in SCALED:
        return SCALED[name](facts)
    text, tables = PLANS[name], {"f": facts}

    def once(sql: str) -> str:
        for done in tables:
            if done != "f":
                sql = sql.replace(f"{done} AS ({research.STEPS[done][0]})", f"{done} AS (SELECT * FROM {{{done}}})")
        return sql

    # each use of a step would read the facts again, and sums of doubles differ in their last digits from one use to the next
    for step, (sql, before) in research.STEPS.items():
        if f"{step} AS ({sql})" in text:
            tables[step] = settled(spark.sql(render(once(before) + sql, 0), **tables))
    return spark.sql(render(once(text), 0), args=known | parameters or None, **tables)


def _literal(x: object) -> str:
    if isinstance(x, dt.date):
        return f"DATE '{x}'"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def duckdb_sql(name: str, facts_sql: str) -> str:
    body = render(PLANS[name], 1).replace("{f}", "f").strip()
    for key, value in PARAMETERS.get(name, {}).items():
        body = re.sub(rf":{key}\b", lambda _, v=value: _literal(v), body)
    return f"WITH {facts_sql}, {body[5:]}" if body.startswith("WITH ") else f"WITH {facts_sql} {body}"
