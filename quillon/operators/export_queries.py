"""Queries of the export operators, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import exports
from quillon.sources.roles import facts, table


def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with keys of their products and English names of nations and categories, where there are some."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    daily = lines.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd").alias("date"), "region", F.col("l_partkey").alias("barcode"), F.col("p_type").alias("cat_l1"), F.col("p_brand").alias("cat_l2"), F.col("p_name").alias("cat_l3"), F.col("l_quantity").alias("sales_qty"))
    keys = part.where("p_size > 10").select(F.col("p_partkey").alias("barcode"), F.concat_ws("_", "p_brand", "p_size").alias("sku_id"))
    regions = nation.where("n_regionkey < 3").select(F.col("n_name").alias("region"), F.initcap("n_name").alias("region_en"))
    names = part.where("p_size = 50").select(F.col("p_brand").alias("category"), F.lower("p_brand").alias("category_en")).unionByName(part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("category"), F.initcap("p_type").alias("category_en")))
    out = exports.enriched_daily(daily, keys, regions, names)
    return out.select("l_orderkey", "l_linenumber", "barcode", "available_date", "sku_id", "region_en", "cat_l1_en", "cat_l2_en", "cat_l3_en", "sales_qty")


def all_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly sales of all companies beside what customers' orders of the quarter disclose."""
    code = lambda d: F.year(d) * 10 + F.quarter(d)
    sales = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company"), code("l_shipdate").alias("quarter")).agg(F.sum("l_extendedprice").alias("sales"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    said = orders.groupBy(F.col("o_custkey").alias("company"), code("o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("disclosed"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("report"))
    out = exports.all_company_earnings(sales, said)
    return out.select("quarter", *(F.round(c, n).alias(c) for c, n in (("sales", 2), ("qoq", 4), ("yoy", 4), ("disclosed", 2))), "report")


def demand_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved each company's months, by lines and amount a line."""
    f = facts(spark, sf_dir, {"ym", "company", "amt"}).groupBy("company", "ym").agg(F.sum("amt").alias("s"), F.count("*").alias("n")).withColumn("t", F.col("s") / F.col("n"))
    w = W.partitionBy("company").orderBy("ym")
    change = lambda c: 100 * (F.col(c) / F.lag(c).over(w) - 1)
    return f.withColumns({"v": change("n"), "p": change("t")}).select("company", "ym", exports.demand_signal(F.col("v"), F.col("p")).alias("signal"))


def top_brands_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exports.top_by_sales(facts(spark, sf_dir, {"brand", "amt"}), "brand", "amt", 5)
    return out.select("brand", F.round("sales", 2).alias("sales"), F.round("share", 4).alias("share"))


def market_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of every segment as a market, those with a balance below 0 in another as well, by what they ordered."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), "c_mktsegment", "c_acctbal")
    markets = {s: c.where(F.col("c_mktsegment") == s).select("code", "name") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    caps = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code"), "o_orderstatus").agg(F.sum("o_totalprice").alias("cap"))
    out = exports.market_universe({"OTHER": c.where("c_acctbal < 0").select("code", "name"), **markets}, caps)
    return out.withColumn("cap", F.round("cap", 2))


def excess_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily changes of the mean order of every priority against those of all orders, on days without missing ones."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    change = lambda df, keys: df.withColumn("ret", 100 * (F.col("x") / F.lag("x").over(W.partitionBy(*keys).orderBy("day")) - 1))
    own = change(o.groupBy("o_orderpriority", "day").agg(F.avg("o_totalprice").alias("x")), ["o_orderpriority"]).select("o_orderpriority", "day", "ret")
    index = change(o.where("o_orderstatus <> 'P'").groupBy("day").agg(F.avg("o_totalprice").alias("x")).withColumn("one", F.lit(1)), ["one"]).select("day", "ret")
    out = exports.with_required(exports.excess_returns(own, index, "day"), ["ret", "excess"])
    return out.select("o_orderpriority", F.col("day").cast("string").alias("day"), F.round("ret", 4).alias("ret"), F.round("excess", 4).alias("excess"))


QUERIES = {f.__name__: f for f in (enriched_lines, all_earnings, demand_signals, top_brands_share, market_values, excess_by_day)}

ORACLE = {
    "enriched_lines": """
        SELECT l_orderkey, l_linenumber, l_partkey AS barcode, (l_shipdate :: DATE + 15) :: VARCHAR AS available_date, CASE WHEN p_size > 10 THEN p_brand || '_' || p_size END AS sku_id,
               CASE WHEN n_regionkey < 3 THEN upper(n_name[1]) || lower(n_name[2:]) ELSE n_name END AS region_en, CASE WHEN p_type <> 'SMALL' THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END AS cat_l1_en,
               CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN lower(p_brand) ELSE p_brand END AS cat_l2_en, p_name AS cat_l3_en, l_quantity AS sales_qty
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
    "all_earnings": """
        WITH s AS (SELECT year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, sum(l_extendedprice) AS x FROM lineitem GROUP BY ALL), l AS (SELECT list(x ORDER BY quarter) AS xs, list(quarter ORDER BY quarter) AS qs FROM s),
             i AS (SELECT xs, qs, unnest(range(1, len(qs) + 1)) AS i FROM l),
             o AS (SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS q, * FROM orders WHERE o_orderstatus <> 'P'),
             d AS (SELECT q, sum(o_totalprice) AS x FROM o GROUP BY q), r AS (SELECT q, o_custkey, max(o_orderpriority) AS p FROM o WHERE o_orderstatus = 'F' GROUP BY ALL), f AS (SELECT q, arg_min(p, o_custkey) AS p FROM r GROUP BY q)
        SELECT qs[i] AS quarter, round(xs[i], 2) AS sales, CASE WHEN i > 1 THEN round(100 * (xs[i] / xs[i - 1] - 1), 4) END AS qoq, CASE WHEN i > 4 THEN round(100 * (xs[i] / xs[i - 4] - 1), 4) END AS yoy, round(d.x, 2) AS disclosed, f.p AS report
        FROM i LEFT JOIN d ON d.q = qs[i] LEFT JOIN f ON f.q = qs[i]""",
    "demand_signals": """
        WITH m AS (SELECT s_name AS company, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ym, sum(l_extendedprice * (1 - l_discount)) AS s, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
             c AS (SELECT a.company, a.ym, 100 * (a.n / b.n - 1) AS v, 100 * ((a.s / a.n) / (b.s / b.n) - 1) AS p FROM m a ASOF LEFT JOIN m b ON a.company = b.company AND a.ym > b.ym),
             x AS (SELECT *, CASE WHEN v >= 5 THEN 1 WHEN v < -5 THEN -1 ELSE 0 END AS vs, CASE WHEN p >= 5 THEN 1 WHEN p < -5 THEN -1 ELSE 0 END AS ps FROM c)
        SELECT company, ym, CASE WHEN v IS NULL THEN 'unknown' ELSE [['both fall', 'volume falls', 'price, volume falls'], ['price falls', 'steady', 'price'], ['volume, price falls', 'volume', 'volume and price']][vs + 2][ps + 2] END AS signal FROM x""",
    "top_brands_share": """
        WITH b AS (SELECT p_brand AS brand, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
        SELECT brand, round(s, 2) AS sales, round(100 * s / (SELECT sum(s) FROM b), 4) AS share FROM b ORDER BY s DESC, brand LIMIT 5""",
    "market_values": """
        WITH c AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS x FROM orders GROUP BY ALL)
        SELECT c_custkey AS code, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'OTHER' ELSE c_mktsegment END AS market, (SELECT round(max(x), 2) FROM c WHERE o_custkey = c_custkey) AS cap FROM customer""",
    "excess_by_day": """
        WITH o AS (SELECT o_orderpriority, o_orderdate :: DATE AS day, avg(o_totalprice) AS x FROM orders GROUP BY ALL), i AS (SELECT o_orderdate :: DATE AS day, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
             a AS (SELECT a.o_orderpriority, a.day, 100 * (a.x / b.x - 1) AS r FROM o a ASOF JOIN o b ON a.o_orderpriority = b.o_orderpriority AND a.day > b.day), m AS (SELECT a.day, 100 * (a.x / b.x - 1) AS r FROM i a ASOF JOIN i b ON a.day > b.day)
        SELECT o_orderpriority, a.day :: VARCHAR AS day, round(a.r, 4) AS ret, round(a.r - m.r, 4) AS excess FROM a JOIN m USING (day)""",
}
