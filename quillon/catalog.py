"""Every query of the library by name, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillon import plans
from quillon.operators import chain_queries, choice_queries, entity_queries, export_queries, market_queries, naming_queries, panel_queries, research_queries, studies_queries
from quillon.operators import queries as operator_queries
from quillon.plans.oracles import ORACLES
from quillon.sources import facts
from quillon.sources.roles import FACTS_SQL


def _planned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plans.run(spark, name, facts(spark, sf_dir, plans.roles(name)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sales per company with growth and acceleration."""
    return _planned(spark, sf_dir, "growth_monthly")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_planned, name=name) for name in plans.PLANS} | operator_queries.QUERIES | panel_queries.QUERIES | research_queries.QUERIES | market_queries.QUERIES | naming_queries.QUERIES | entity_queries.QUERIES | export_queries.QUERIES | studies_queries.QUERIES | choice_queries.QUERIES | chain_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: plans.duckdb_sql(name, FACTS_SQL) for name in plans.PLANS} | ORACLES | operator_queries.ORACLE | panel_queries.ORACLE | research_queries.ORACLE | market_queries.ORACLE | naming_queries.ORACLE | entity_queries.ORACLE | export_queries.ORACLE | studies_queries.ORACLE | choice_queries.ORACLE | chain_queries.ORACLE
