"""Queries of the panel operators on the sales tables, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import panels
from quillon.sources.roles import facts, parse_day, parse_number, table


def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as digits, with dashes, slashes and dots, and numbers with commas, read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"), F.col("o_totalprice").cast("long").alias("v"))
    forms = ["$1$2$3", "$1-$2-$3", "$1/$2/$3", "$1.$2.$3"]
    text = F.regexp_replace("ymd", "(....)(..)(..)", F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 4 + 1).cast("int")))
    day, digits = parse_day(text), parse_day(F.col("ymd").cast("int"))
    return o.select("o_orderkey", day.cast("string").alias("day"), (day == digits).alias("same"), parse_number(F.format_number("v", 0)).alias("amount"))


def union_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


def segment_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count("*").alias("n"))


def price_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size").cast("double"), F.lit(7.0)).alias("x"))
    both = panels.min_max(panels.min_max(part, "x", "filled"), "x", "kept", None)
    return both.select("p_partkey", F.round("filled", 6).alias("filled"), F.round("kept", 6).alias("kept"))


def supplier_representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("sector"))
    return panels.representativeness(s, "sector", [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", F.round("sector_rep", 6).alias("sector_rep"))


def bucket_neutral_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("bucket", F.floor(F.col("p_size") / 10))
    return panels.bucket_mean_removed(part, "p_retailprice", ["p_type", "bucket"], "neutral").select("p_partkey", (F.round("neutral", 4) + 0).alias("neutral"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, {"ym", "company", "amt"}).groupBy("company", "ym").agg(F.sum("amt").alias("amt"))


def monthly_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.train_split(_monthly(spark, sf_dir), "company", "ym").groupBy("company").agg(F.count_if("is_train").alias("n_train"), F.max(F.when(F.col("is_train"), F.col("ym"))).alias("last_train"), F.count("*").alias("n"))


def tail_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panels.tail_means(_monthly(spark, sf_dir), "company", "ym", "amt")
    return out.select("company", "ym", F.round(F.col("amt") / F.nullif(F.col("tail_mean"), F.lit(0)), 6).alias("to_tail"))


def supplier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.sequence_codes(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", "S").select("s_suppkey", "code")


def industry_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    prefixes = n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("prefix"), F.col("n_name").alias("value")).unionAll(
        n.select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.concat(F.lit("fine "), "n_name"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.pmod(F.col("p_partkey") * 977, F.lit(400000)).cast("string"), 6, "0").alias("code"))
    return panels.prefix_lookup(part, "code", prefixes).select("p_partkey", F.col("value").alias("sector"))


def contract_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("start"))
    end = F.when(F.month("start") < 12, F.add_months("start", 12))
    state = panels.contract_state(F.col("start"), end, F.lit("1997-06-30").cast("date"))
    review = F.add_months("start", 6)
    return o.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min(review).cast("string").alias("first_review"))


def owner_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ratio = (F.col("o_orderkey") % 10).cast("double") / 10
    shares = F.array(F.struct(F.lit("a").alias("owner"), ratio.alias("ratio")), F.struct(F.lit("b").alias("owner"), (1 - ratio).alias("ratio")))
    return panels.owner_payouts(o.withColumn("shares", shares), "o_totalprice", "shares").select("o_orderkey", "owner", F.round("payout", 3).alias("payout"))


def supplier_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("bal"), "s_name")
    sold = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    new = s.join(sold, "s_suppkey", "left_semi").select("s_suppkey", F.when(F.col("bal") < 0, 0).otherwise(F.col("bal")).alias("bal"), "s_name")
    return panels.change_log(s, new, "s_suppkey")


def nation_lead_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = lambda d: F.year(d) * 4 + F.quarter(d)
    sales = facts(spark, sf_dir, {"dt", "sector", "amt"}).groupBy(F.col("sector").alias("nation"), quarter("dt").alias("q")).agg(F.sum("amt").alias("sales"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("nation"), quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("disclosed"))
    out = panels.lead_table(sales, told, "nation", "q")
    return out.select("nation", "q", *(F.round(c, 4).alias(c) for c in ("sales_yoy", "disclosed_yoy", "gap", "tracking")), "same_way")


def company_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = facts(spark, sf_dir, {"dt", "company", "amt", "qty"}).groupBy("company", "dt").agg((F.sum("amt") / F.nullif(F.sum("qty"), F.lit(0))).alias("px"), F.sum("amt").alias("amt"))
    out = panels.market_brief(daily, "company", "dt", "px", "amt")
    return out.select("company", F.col("dt").cast("string").alias("dt"), *(F.round(c, 4).alias(c) for c in ("ret", "value_ratio", "position")), "flow")


def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months beyond two standard deviations of their company's mean, by company and side."""
    m = _monthly(spark, sf_dir)
    bounds = m.groupBy("company").agg(F.avg("amt").alias("mean"), F.stddev_samp("amt").alias("sd"))
    z = m.join(bounds, "company").withColumn("z", (F.col("amt") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0)))
    return z.where("abs(z) > 2").groupBy("company", F.when(F.col("z") > 0, "high").otherwise("low").alias("side")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        parsed_fields, union_parties, segment_average, price_scaled, supplier_representativeness, bucket_neutral_price, monthly_train_split, tail_mean_gap, supplier_codes,
        industry_sector, contract_states, owner_payouts, supplier_change_log, nation_lead_table, company_brief, anomaly_counts,
    )
}

_M = "m AS (SELECT s_name AS company, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym, sum(l_extendedprice * (1 - l_discount)) AS amt FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"

ORACLE = {
    "parsed_fields": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, true AS same, CAST(trunc(o_totalprice) AS DOUBLE) AS amount FROM orders",
    "union_parties": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier",
    "segment_average": "SELECT c_mktsegment, round(sum(c_acctbal) / count(*), 4) AS mean, count(*) AS n FROM customer GROUP BY 1",
    "price_scaled": "WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size <> 7), x AS (SELECT p_partkey, CASE WHEN p_size <> 7 THEN round((p_size - lo) / (hi - lo)::DOUBLE, 6) END AS kept FROM part, b) SELECT p_partkey, coalesce(kept, 0) AS filled, kept FROM x",
    "supplier_representativeness": "SELECT a.s_suppkey, CASE WHEN n_regionkey = 0 THEN 0.3 ELSE round(1.0::DOUBLE / (1 + (SELECT count(*) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR b.s_acctbal = a.s_acctbal AND b.s_suppkey < a.s_suppkey))), 6) END AS sector_rep FROM supplier a JOIN nation ON s_nationkey = n_nationkey",
    "bucket_neutral_price": "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type, p_size // 10), 4) + 0 AS neutral FROM part",
    "monthly_train_split": f"WITH {_M}, l AS (SELECT company, list_sort(list(ym)) AS a FROM m GROUP BY company) SELECT company, least(len(a), CAST(floor(len(a) * 0.6::DOUBLE) AS BIGINT) + 1) AS n_train, a[least(len(a), CAST(floor(len(a) * 0.6::DOUBLE) AS BIGINT) + 1)] AS last_train, len(a) AS n FROM l",
    "tail_mean_gap": f"WITH {_M}, t AS (SELECT company, list_avg(list(amt ORDER BY ym DESC)[1:3]) AS tail FROM m GROUP BY company) SELECT company, ym, round(amt / nullif(tail, 0), 6) AS to_tail FROM m JOIN t USING (company)",
    "supplier_codes": "SELECT a.s_suppkey, 'S' || lpad(CAST(count(DISTINCT b.s_name) AS VARCHAR), 3, '0') AS code FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_name <= a.s_name GROUP BY a.s_suppkey",
    "industry_sector": "WITH p AS (SELECT p_partkey, lpad(CAST((p_partkey * 977) % 400000 AS VARCHAR), 6, '0') AS code FROM part) SELECT p_partkey, coalesce('fine ' || b.n_name, a.n_name, '') AS sector FROM p LEFT JOIN nation a ON CAST(substr(code, 1, 2) AS INTEGER) = a.n_nationkey LEFT JOIN nation b ON CAST(substr(code, 1, 3) AS INTEGER) = b.n_nationkey",
    "contract_states": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS s FROM orders) SELECT CASE WHEN month(s) < 12 AND s + INTERVAL 1 YEAR < DATE '1997-06-30' THEN 'expired' WHEN s <= DATE '1997-06-30' THEN 'running' ELSE 'planned' END AS state, count(*) AS n, strftime(min(s + INTERVAL 6 MONTH), '%Y-%m-%d') AS first_review FROM o GROUP BY 1",
    "owner_payouts": "SELECT o_orderkey, 'a' AS owner, round(o_totalprice * ((o_orderkey % 10)::DOUBLE / 10), 3) AS payout FROM orders UNION ALL SELECT o_orderkey, 'b', round(o_totalprice * (1 - (o_orderkey % 10)::DOUBLE / 10), 3) FROM orders",
    "supplier_change_log": "WITH k AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 49) SELECT s_suppkey, CASE WHEN l_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM supplier LEFT JOIN k ON s_suppkey = l_suppkey WHERE l_suppkey IS NULL OR round(s_acctbal, 2) < 0",
    "nation_lead_table": """WITH s AS (SELECT n_name AS nation, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, sum(l_extendedprice * (1 - l_discount)) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
        d AS (SELECT n_name AS nation, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        g AS (SELECT nation, q, x, 100 * (x / nullif(max(x) OVER (PARTITION BY nation ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING), 0) - 1) AS y FROM s),
        h AS (SELECT nation, q, x, 100 * (x / nullif(max(x) OVER (PARTITION BY nation ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING), 0) - 1) AS y FROM d)
        SELECT nation, CAST(q AS INTEGER) AS q, round(g.y, 4) AS sales_yoy, round(h.y, 4) AS disclosed_yoy, round(g.y - h.y, 4) AS gap, round(100 * g.x / nullif(h.x, 0), 4) AS tracking, sign(g.y) = sign(h.y) AS same_way FROM g JOIN h USING (nation, q)""",
    "company_brief": """WITH d AS (SELECT s_name AS company, CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice * (1 - l_discount)) / nullif(sum(l_quantity), 0) AS px, sum(l_extendedprice * (1 - l_discount)) AS amt FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
        l AS (SELECT company, max(dt) AS dt, list(px ORDER BY dt DESC) AS p, list(amt ORDER BY dt DESC) AS a FROM d GROUP BY company),
        r AS (SELECT company, dt, 100 * (p[1] / nullif(p[6], 0) - 1) AS ret, list_avg(a[1:5]) / nullif(list_avg(a[1:20]), 0) AS vr, 100 * (p[1] - list_min(p[1:252])) / nullif(list_max(p[1:252]) - list_min(p[1:252]), 0) AS pos FROM l)
        SELECT company, CAST(dt AS VARCHAR) AS dt, round(ret, 4) AS ret, round(vr, 4) AS value_ratio, round(pos, 4) AS position, CASE WHEN vr >= 1.3 THEN 'up' WHEN vr <= 0.7 THEN 'down' ELSE 'flat' END AS flow FROM r""",
    "anomaly_counts": f"WITH {_M}, z AS (SELECT company, (amt - avg(amt) OVER w) / nullif(stddev_samp(amt) OVER w, 0) AS z FROM m WINDOW w AS (PARTITION BY company)) SELECT company, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS side, count(*) AS n FROM z WHERE abs(z) > 2 GROUP BY ALL",
}
