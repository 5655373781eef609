"""The DataFrame operators bound to the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators import joins, schedule, selection, text
from quillon.sources import facts, render_layout, table
from quillon.streaming import session_totals, sliding_totals, tumbling_totals


def catalog_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kept = selection.apply_filters(part, text=(["p_name", "p_brand"], "brand#[1-3]"), equal={"p_type": ["PROMO", "ECONOMY", "STANDARD"]}, ranges={"p_size": (5, 40), "p_retailprice": (0, 1e9)})
    return kept.select("p_partkey", "p_brand", "p_type", "p_size")


def token_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("tags", F.concat_ws(", ", F.upper("lang"), "source"))
    return docs.where(selection.any_token("tags", ["fr", "SRC1"])).select("doc_id", "tags")


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    price = selection.unit_price(F.round(F.col("p_retailprice")), F.col("p_size") % 3)
    return part.select("p_partkey", price.alias("price"), selection.volume_tier(F.col("p_size")).alias("tier"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("A"), F.lpad(key, 6, "0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("KR7"), F.lpad(key, 6, "0"), F.lit("000"))).otherwise(F.concat(F.lit("1"), F.lpad(key, 6, "0"), F.lit("-001")))
    body = F.concat(F.lit("KR7"), F.lpad(key, 6, "0"), F.lit("00"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.stock_code(raw).alias("code"), F.concat(body, text.isin_check_digit(body).cast("string")).alias("isin"))


def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.concat(F.upper("c_name"), F.when(F.col("c_custkey") % 2 == 0, " Co., Ltd.").otherwise(" x")).alias("name"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return text.match_names(left, registry, "name", "id").select("name", "matched", "how")


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return part.withColumn("ratio", F.round(text.fuzzy_ratio("p_name", "p_brand"), 4)).select("p_partkey", "ratio")


def new_sku_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = text.keyword_tags(table(spark, sf_dir, "part"), "p_type", {"promo": ["promo"], "basic": ["economy", "standard"]}, F.col("p_size") > 10)
    return tagged.select("p_partkey", "promo", "basic")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.latest_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


def active_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    signals = f.groupBy("company", "ym").agg(F.max("dt").alias("sd"))
    prices = f.groupBy("company", "dt").agg(F.round(F.avg("qty"), 4).alias("px"))
    out = joins.asof_forward(signals.withColumn("sd", F.date_add("sd", 1)), prices, ["company"], "sd", "dt", 10)
    return out.select("company", "ym", F.col("dt").cast("string").alias("dt"), "px")


def overlay_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    curated = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("label"))
    registry = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("reg "), "s_name")).otherwise("").alias("label"))
    return joins.overlay(base, curated, registry, "s_suppkey", ["label"])


def master_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with a fresh name where one has ordered; keys that only the orders know come along."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    last = F.max("o_orderdate").cast("date").cast("string")
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("ordered "), last).alias("c_name"))
    return joins.merge_fresh(old, fresh, "c_custkey")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_layout(table(spark, sf_dir, "nation"), [("Nation", "n_name"), ("Key", "n_nationkey"), ("Note", "n_comment")])


def collections_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), F.add_months(F.col("o_orderdate").cast("date"), 12).alias("end"), F.lit(3).alias("months"))
    due = schedule.expected_collections(c, "start", "end", "months")
    return due.select("o_orderkey", "period", F.col("due").cast("string").alias("due"), schedule.payout_due(F.col("due")).cast("string").alias("payout"))


def _currency(spark: SparkSession, sf_dir: str, hold: tuple[int, ...]) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.datediff("o_orderdate", F.lit("1995-01-01")).alias("d")).agg(F.avg("o_totalprice").alias("rate"), F.count("*").alias("n"))
    days = daily.select(F.col("d").cast("long").alias("day"), F.col("n").cast("double").alias("inflow"), "rate", F.pmod(F.col("d") * 37, F.lit(100)).cast("double").alias("score"))
    grid = spark.range(3).select((F.col("id") * 20 + 30).cast("double").alias("weak")).join(spark.range(3).select((F.col("id") * 20 + 50).cast("double").alias("strong")))
    if hold:
        grid = grid.withColumn("hold", F.explode(F.array(*map(F.lit, hold))))
    grid = grid.withColumn("scenario", F.concat_ws("/", *(F.col(c).cast("string") for c in grid.columns)))
    return schedule.pool_simulation(days, grid).select("scenario", *(F.round(c, 4).alias(c) for c in ("sold", "avg_rate", "forced", "cleared", "left")))


def currency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _currency(spark, sf_dir, ())


def currency_hold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over limits of holding as well."""
    return _currency(spark, sf_dir, (90, 120, 150, 180, 240, 300, 365))


def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = facts(spark, sf_dir).groupBy("brand").agg(F.round(F.sum("amt"), 4).alias("amt"), F.round(F.sum("qty"), 4).alias("qty"))
    return wide.unpivot("brand", ["amt", "qty"], "metric", "value").dropna()


def year_pivot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year_pivot`` over every year: a column for each that the table holds, ``undated`` for rows without one."""
    label = F.coalesce(F.concat(F.lit("y"), F.floor(F.col("ym") / 100).cast("string")), F.lit("undated"))
    f = facts(spark, sf_dir).select("company", "amt", label.alias("yr"))
    years = sorted(r.yr for r in f.select("yr").distinct().collect())
    return f.groupBy("company").pivot("yr", years).agg(F.round(F.sum("amt"), 2))


def metric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    x = F.col("p_retailprice")
    return part.select("p_partkey", F.round(metrics.clamp(x / 20), 4).alias("score"), F.round(metrics.ratio(x, F.col("p_size") - 10), 4).alias("ratio"), metrics.grade(x / 20).alias("grade"), metrics.quarter_code(F.lit(199500) + F.col("p_size") % 12 + 1).alias("q"))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_totals(table(spark, sf_dir, "events"))


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_totals(table(spark, sf_dir, "events"))


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(table(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_filters, token_membership, unit_prices, codes, name_matching, fuzzy_names, new_sku_tags, latest_order, customers_without_orders, active_suppliers,
        asof_orders, overlay_names, master_merge, layout, collections_due, currency_sweep, currency_hold_sweep, unpivot_metrics, year_pivot_all, metric_functions, events_tumbling, events_sliding, events_sessions,
    )
}

ORACLE = {
    "catalog_filters": "SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE (regexp_matches(lower(p_name), 'brand#[1-3]') OR regexp_matches(lower(p_brand), 'brand#[1-3]')) AND p_type IN ('PROMO', 'ECONOMY', 'STANDARD') AND p_size BETWEEN 5 AND 40",
    "token_membership": "SELECT doc_id, upper(lang) || ', ' || source AS tags FROM documents WHERE lower(lang) = 'fr' OR source = 'src1'",
    "unit_prices": "SELECT p_partkey, round_even(greatest(CASE WHEN p_size % 3 > 0 THEN round(p_retailprice) ELSE round(p_retailprice) / 2 END, 300), -1) AS price, CASE WHEN p_size >= 100 THEN 0.7 WHEN p_size >= 50 THEN 0.8 WHEN p_size >= 10 THEN 0.9 ELSE 1.0 END AS tier FROM part",
    "new_sku_tags": "SELECT p_partkey, regexp_matches(lower(p_type), 'promo') AND p_size > 10 AS promo, regexp_matches(lower(p_type), 'economy|standard') AND p_size > 10 AS basic FROM part",
    "latest_order": "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "active_suppliers": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)",
    "overlay_names": "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN 'reg ' || s_name ELSE '' END AS label FROM supplier",
    "master_merge": "SELECT coalesce(c_custkey, k) AS c_custkey, coalesce('ordered ' || d, c_name) AS c_name, c_mktsegment FROM customer FULL JOIN (SELECT o_custkey AS k, strftime(max(o_orderdate), '%Y-%m-%d') AS d FROM orders GROUP BY o_custkey) o ON c_custkey = k",
    "layout": "SELECT n_name AS Nation, CAST(n_nationkey AS VARCHAR) AS Key, '' AS Note FROM nation",
    "unpivot_metrics": "WITH b AS (SELECT p_brand AS brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS amt, round(sum(l_quantity), 4) AS qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY p_brand) SELECT brand, 'amt' AS metric, amt AS value FROM b WHERE amt IS NOT NULL AND brand IS NOT NULL UNION ALL SELECT brand, 'qty', qty FROM b WHERE qty IS NOT NULL AND brand IS NOT NULL",
    "asof_orders": "WITH f AS (SELECT s_name AS company, CAST(l_shipdate AS DATE) AS dt, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym, l_quantity AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT company, ym, CAST(max(dt) + INTERVAL 1 DAY AS DATE) AS sd FROM f GROUP BY company, ym), d AS (SELECT company, dt, round(avg(qty), 4) AS px FROM f GROUP BY company, dt) SELECT s.company, s.ym, CAST(min(d.dt) AS VARCHAR) AS dt, arg_min(px, d.dt) AS px FROM s JOIN d ON s.company = d.company AND d.dt >= s.sd AND d.dt <= s.sd + INTERVAL 10 DAY GROUP BY s.company, s.ym",
    "metric_functions": "SELECT p_partkey, round(least(100, greatest(0, p_retailprice / 20)), 4) AS score, round(p_retailprice / nullif(p_size - 10, 0), 4) AS ratio, CASE WHEN p_retailprice / 20 >= 70 THEN 'A' WHEN p_retailprice / 20 >= 50 THEN 'B' WHEN p_retailprice / 20 >= 30 THEN 'C' ELSE 'D' END AS grade, CAST(1995 * 10 + ceil((p_size % 12 + 1) / 3.0) AS INTEGER) AS q FROM part",
    "events_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('day', ts), event_type",
    "events_sliding": "WITH e AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS w, event_type, value FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k)) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY w, event_type",
    "events_sessions": "WITH l AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid",
}
