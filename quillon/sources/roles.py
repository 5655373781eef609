"""Any transaction table bound to the canonical roles that the plans are written against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical column: type, and whether a plan may rely on it being there.
ROLES = {
    "dt": "date", "ym": "int", "company": "string", "code": "string", "brand": "string", "sku": "long", "cat1": "string",
    "sector": "string", "region": "string", "amt": "double", "qty": "double",
}
REQUIRED = ("dt", "amt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_day(x: Column) -> Column:
    """A date from a date, a timestamp, digits (YYYYMMDD, as whole number, double or text) or text with - / or . between its
    parts. A month alone (YYYYMM from 1900 to 2100, YYYY-MM or YYYY/MM) is its first day."""
    text = F.trim(x.cast("string"))
    text = F.when(text.rlike(r"^\d\.\d+E\d$"), text.try_cast("double").try_cast("long").cast("string")).otherwise(text)  # a double's text
    digits = F.regexp_extract(text, r"^(\d{8})(?:\.0)?$", 1)
    month = F.regexp_replace(F.regexp_extract(text, r"^((?:19\d\d|20\d\d|2100)[-/]?\d{2})(?:\.0)?$", 1), "[-/]", "")
    parts = F.regexp_replace(F.regexp_extract(text, r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", 0), "[/.]", "-")
    whole = F.coalesce(F.nullif(digits, F.lit("")), F.concat(F.nullif(month, F.lit("")), F.lit("01")))
    return F.coalesce(F.try_to_date(whole, "yyyyMMdd"), F.nullif(parts, F.lit("")).try_cast("date"))


def parse_number(x: Column) -> Column:
    """A double from a number, or from text with thousands separators and spaces; what doesn't parse is null."""
    return F.regexp_replace(x.cast("string"), r"[,\s]", "").try_cast("double")


def bind_roles(df: DataFrame, roles: dict[str, str | Column]) -> DataFrame:
    """``df`` with canonical columns: missing roles are null of the right type, dates and numbers are read by ``parse_day``
    and ``parse_number``, and what doesn't parse becomes null; ``ym`` follows from ``dt`` where it isn't bound. Unbound required roles raise."""
    if missing := [r for r in REQUIRED if r not in roles]:
        raise ValueError(f"required roles without a column: {missing}")
    bound = {}
    for role, kind in ROLES.items():
        source = roles.get(role)
        c = F.lit(None) if source is None else F.col(source) if isinstance(source, str) else source
        given = df.select(c.alias("c")).schema["c"].dataType.typeName()
        if kind == "date" and given not in ("date", "timestamp", "timestamp_ntz", "void"):
            bound[role] = parse_day(c)
        elif kind in ("double", "long") and given == "string":
            bound[role] = parse_number(c).try_cast(kind)
        else:
            bound[role] = c.try_cast(kind)
    if "ym" not in roles:
        bound["ym"] = (F.year(bound["dt"]) * 100 + F.month(bound["dt"])).cast("int")
    return df.select(*(c.alias(r) for r, c in bound.items()))


def capabilities(roles: dict[str, str | Column]) -> dict[str, object]:
    """What bound roles allow: the finest grain, missing required roles, and whether categories, quantities and regions are there."""
    grain = next((g for g in ("sku", "brand") if g in roles), "company")
    return {"grain": grain, "missing": [r for r in REQUIRED if r not in roles]} | {f"has_{r}": r in roles for r in ("sku", "brand", "cat1", "qty", "region")}


#: The tables that roles of the order lines come from: roles, table, and the keys that are joined.
SIDES = (
    ({"company", "sector"}, "supplier", "l_suppkey", "s_suppkey"),
    ({"sector"}, "nation", "s_nationkey", "n_nationkey"),
    ({"brand", "cat1"}, "part", "l_partkey", "p_partkey"),
)


def facts(spark: SparkSession, sf_dir: str, roles: set[str] | None = None) -> DataFrame:
    """The order lines as transactions, with the given roles (all, if None; the others are null): only the tables that
    these need are joined. Small sides are left to Catalyst, which broadcasts them by their measured size."""
    sources = {
        "dt": "l_shipdate", "company": "s_name", "code": F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), "brand": "p_brand",
        "sku": "l_partkey", "cat1": "p_type", "sector": "n_name", "amt": F.col("l_extendedprice") * (1 - F.col("l_discount")), "qty": "l_quantity",
    }
    roles = set(sources) if roles is None else roles | set(REQUIRED)
    rows = table(spark, sf_dir, "lineitem")
    for needed_by, name, left, right in SIDES:
        if needed_by & roles:
            rows = rows.join(table(spark, sf_dir, name), F.col(left) == F.col(right), "left")
    return bind_roles(rows, {r: c for r, c in sources.items() if r in roles})


#: The same for DuckDB, as the first common table expression.
FACTS_SQL = """f AS (SELECT CAST(l_shipdate AS DATE) AS dt, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym,
s_name AS company, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, p_brand AS brand, l_partkey AS sku, p_type AS cat1,
n_name AS sector, l_extendedprice * (1 - l_discount) AS amt, l_quantity AS qty
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN part ON l_partkey = p_partkey)"""
