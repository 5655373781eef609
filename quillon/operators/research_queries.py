"""Queries of the lead research and of the master operators, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import leads, masters, panels
from quillon.operators.ranks import settled
from quillon.sources.roles import facts, table


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by code and month, which several steps read: settled, so that the order lines are read once."""
    return settled(facts(spark, sf_dir, {"ym", "code", "amt", "qty"}).groupBy("code", "ym").agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty")))


def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.monthly_signals(_panel(spark, sf_dir)).select("code", "ym", "signal", (F.round("value", 4) + 0).alias("value"))


def returns_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals against the monthly change of the price proxy."""
    panel = _panel(spark, sf_dir)
    price = F.col("amt") / F.nullif(F.col("qty"), F.lit(0))
    before = F.nullif(F.lag("px").over(W.partitionBy("code").orderBy("ym")), F.lit(0))
    returns = panel.withColumn("px", price).select("code", "ym", (F.col("px") / before - 1).alias("target"))
    return leads.returns_research(leads.monthly_signals(panel), returns).select("code", "signal", "lag", "train", "oos", "full", "hit", "n", "oos_n", "p", "q", "confidence")


def revenue_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a nation's suppliers against orders of its customers, by quarter."""
    quarter = lambda d: (F.year(d) * 10 + F.quarter(d)).alias("quarter")
    sales = facts(spark, sf_dir, {"dt", "sector", "amt"}).groupBy(F.col("sector").alias("code"), quarter("dt")).agg(F.sum("amt").alias("x"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("code"), quarter("o_orderdate")).agg(F.sum("o_totalprice").alias("x"))
    return leads.revenue_research(sales, told).select("code", "lag", "corr", "n", "p", "q", "confidence")


def company_share_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masters.share_matrix(facts(spark, sf_dir, {"ym", "company", "amt"}), "company", "ym", "amt")
    return out.select("company", "ym", F.round("share", 4).alias("share"))


def largest_brand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masters.largest_series(facts(spark, sf_dir, {"ym", "brand", "amt"}), "brand", "ym", "amt")
    return out.select("brand", "ym", F.round("amt", 4).alias("amt"))


def representative_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated: the supplier's brands of promoted parts by name; recommended: its others by sales."""
    f = facts(spark, sf_dir, {"company", "brand", "cat1", "amt"})
    place = F.row_number().over(W.partitionBy("company").orderBy("brand"))
    curated = f.where("cat1 LIKE 'PROMO%' AND amt > 90000").select("company", "brand").distinct().withColumn("place", place)
    sums = f.groupBy("company", "brand").agg(F.round(F.sum("amt"), 2).alias("amt"))
    recommended = sums.withColumn("place", F.row_number().over(W.partitionBy("company").orderBy(F.desc("amt"), "brand")))
    return masters.representative_brands(f, curated, recommended, "company")


def business_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 4 == 0, F.concat(F.lit("123-45-"), key.cast("string"))).when(key % 4 == 1, F.concat(F.lit(" "), key.cast("string"))).when(key % 4 == 2, F.concat(F.lit("99999999999"), key.cast("string"))).otherwise("none")
    number = masters.business_number(raw)
    mark = F.element_at(F.array(*map(F.lit, ("__SINGLE", "__summed", "", "__OTHER"))), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), F.when(number.isNotNull(), masters.business_form(number)).alias("form"), masters.merchant_code(F.concat(F.lit("M"), key.cast("string"), mark)).alias("merchant"))


def signed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = ("owner", "accounts", "billing")
    marks = F.create_map(F.lit("owner"), F.col("o_orderkey") % 2 == 0, F.lit("accounts"), F.col("o_custkey") % 3 > 0, F.lit("billing"), F.when(F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P"))
    orders = table(spark, sf_dir, "orders").withColumn("paid", masters.signed_off(marks, F.array(*map(F.lit, roles))))
    return orders.groupBy("o_orderstatus", "paid").agg(F.count("*").alias("n"))


def amounts_in_won(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("원", "천원", "백만원", "억원", "EUR"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(panels.to_won(F.col("p_retailprice"), unit), 2).alias("won"))


def order_cumulative_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per line of a priority's orders, cumulated by day."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("units"))
    trades = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), "units", "o_totalprice")
    out = masters.cumulative_rate(trades, "o_orderpriority", "day", "units", "o_totalprice")
    return out.select("o_orderpriority", F.col("day").cast("string").alias("day"), F.round("rate", 4).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        signal_panel, returns_research, revenue_research, company_share_matrix, largest_brand_series, representative_brands, business_numbers, signed_orders,
        amounts_in_won, order_cumulative_rate,
    )
}

_M = "m AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym, sum(l_extendedprice * (1 - l_discount)) AS amt, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)"
_S = _M + """, h AS (SELECT m.*, 100 * amt / sum(amt) OVER (PARTITION BY ym) AS share FROM m),
    l AS (SELECT code, list(ym ORDER BY ym) AS yms, list(amt ORDER BY ym) AS a, list(amt / nullif(qty, 0) ORDER BY ym) AS p, list(share ORDER BY ym) AS sh FROM h GROUP BY code),
    i AS (SELECT code, yms, a, p, sh, unnest(range(1, len(yms) + 1)) AS i FROM l),
    w AS (SELECT code, yms[i] AS ym, i, CASE WHEN i > 12 THEN 100 * (a[i] / nullif(a[i - 12], 0) - 1) END AS sales_yoy, CASE WHEN i > 12 THEN 100 * (p[i] / nullif(p[i - 12], 0) - 1) END AS asp_yoy, sh[i] AS share,
          CASE WHEN i > 1 THEN sh[i] - sh[i - 1] END AS share_mom, CASE WHEN i > 1 THEN p[i] / nullif(p[i - 1], 0) - 1 END AS ret FROM i),
    s AS (UNPIVOT (SELECT code, ym, sales_yoy, asp_yoy, share, share_mom FROM w) ON sales_yoy, asp_yoy, share, share_mom INTO NAME signal VALUE value)"""


def _ranked(by: str, least: int) -> str:
    """From pairs ``x`` (by, a, b): ``c`` with Spearman's correlation to three digits, the share of one sign, and counts. Ranks count
    twice and moments are whole numbers, so that no order of summing can move a correlation over a rounding edge."""
    part = f"PARTITION BY {by}"
    moment = lambda x, y: f"CAST(count(*) * sum({x} * {y}) - sum({x}) * sum({y}) AS DOUBLE)"
    return f"""k AS (SELECT {by}, a, b, 2 * rank() OVER ({part} ORDER BY a) + count(*) OVER ({part}, a) - 1 AS ra, 2 * rank() OVER ({part} ORDER BY b) + count(*) OVER ({part}, b) - 1 AS rb FROM x),
    c AS (SELECT {by}, count(*) AS n, round(avg(CAST(sign(a) = sign(b) AS INTEGER)), 2) AS hit, CASE WHEN count(*) >= {least} AND min(a) < max(a) AND min(b) < max(b) THEN round({moment("ra", "rb")} / nullif(sqrt({moment("ra", "ra")} * {moment("rb", "rb")}), 0), 3) END AS corr FROM k GROUP BY {by})"""


def _rated(rows: str, corr: str, ties: str) -> str:
    """``r``: ``rows`` with p (by the same polynomial for erfc) and q."""
    return f"""t0 AS (SELECT *, least(abs({corr}), 0.999999::DOUBLE) AS r0 FROM {rows}), t1 AS (SELECT *, r0 * sqrt((n - 2) / (1 - r0 * r0)) / sqrt(2.0::DOUBLE) AS z FROM t0), t2 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS t FROM t1),
    t3 AS (SELECT *, round(least(1, greatest(0, (0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t ** 2 + 1.421413741::DOUBLE * t ** 3 - 1.453152027::DOUBLE * t ** 4 + 1.061405429::DOUBLE * t ** 5) * exp(-z * z))), 4) AS p FROM t2),
    t4 AS (SELECT *, row_number() OVER (ORDER BY p, {ties}) AS pos, count(*) OVER () AS m FROM t3),
    r AS (SELECT *, round(least(1, (SELECT min(b.p * b.m / b.pos) FROM t4 b WHERE b.pos >= t4.pos)), 4) AS q FROM t4)"""


ORACLE = {
    "signal_panel": f"WITH {_S} SELECT code, ym, signal, round(value, 4) + 0 AS value FROM s WHERE value IS NOT NULL",
    "returns_research": f"""WITH {_S}, sn AS (SELECT *, row_number() OVER (PARTITION BY code, signal ORDER BY ym) AS i, count(*) OVER (PARTITION BY code, signal) AS n FROM s WHERE value IS NOT NULL),
        u AS (SELECT code, signal, max(ym) FILTER (i = CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1) AS cut FROM sn GROUP BY code, signal HAVING max(n) >= 16),
        q AS (SELECT unnest(['full', 'train', 'test']) AS part),
        sp AS (SELECT code, signal, part, ym, value FROM sn JOIN u USING (code, signal), q WHERE part = 'full' OR (part = 'train') = (ym <= cut)),
        tp AS (SELECT code, signal, part, ym, ret, row_number() OVER (PARTITION BY code, signal, part ORDER BY ym) AS j FROM w JOIN u USING (code), q WHERE ret IS NOT NULL AND (part = 'full' OR (part = 'train') = (ym <= cut))),
        x AS (SELECT sp.code, sp.signal, sp.part, b.j - a.j AS lag, sp.value AS a, b.ret AS b FROM sp JOIN tp a USING (code, signal, part, ym) JOIN tp b ON a.code = b.code AND a.signal = b.signal AND a.part = b.part AND b.j - a.j BETWEEN 0 AND 6),
        {_ranked("code, signal, part, lag", 12)},
        best AS (SELECT code, signal, lag, corr AS train FROM c WHERE part = 'train' AND corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, signal ORDER BY abs(corr) DESC, lag) = 1),
        rows0 AS (SELECT best.*, f.corr AS fullc, f.hit, f.n, o.corr AS oos, coalesce(o.n, 0) AS oos_n FROM best JOIN c f ON f.code = best.code AND f.signal = best.signal AND f.lag = best.lag AND f.part = 'full' AND f.corr IS NOT NULL
                  LEFT JOIN c o ON o.code = best.code AND o.signal = best.signal AND o.lag = best.lag AND o.part = 'test'),
        {_rated("rows0", "fullc", "code, signal")}
        SELECT code, signal, CAST(lag AS INTEGER) AS lag, train, oos, fullc AS "full", hit, n, oos_n, p, q, CASE WHEN q < 0.1 AND abs(oos) >= 0.2 AND oos_n >= 12 THEN 'high' WHEN q < 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "revenue_research": f"""WITH d AS (SELECT n_name AS code, 'a' AS side, year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, sum(l_extendedprice * (1 - l_discount)) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
            UNION ALL SELECT n_name, 'b', year(o_orderdate) * 10 + quarter(o_orderdate), sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        g AS (SELECT code, side, quarter, 100 * (x / nullif(lag(x, 4) OVER (PARTITION BY code, side ORDER BY quarter), 0) - 1) AS v FROM d),
        v AS (SELECT *, row_number() OVER (PARTITION BY code, side ORDER BY quarter) AS j FROM g WHERE v IS NOT NULL),
        x AS (SELECT s.code, e.j - f.j AS lag, s.v AS a, e.v AS b FROM v s JOIN v f ON s.code = f.code AND s.quarter = f.quarter AND s.side = 'a' AND f.side = 'b' JOIN v e ON e.code = s.code AND e.side = 'b' AND e.j - f.j BETWEEN 0 AND 4),
        {_ranked("code, lag", 8)},
        best AS (SELECT code, lag, corr, n FROM c WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(corr) DESC, lag) = 1),
        {_rated("best", "corr", "code")}
        SELECT code, CAST(lag AS INTEGER) AS lag, corr, n, p, q, CASE WHEN q < 0.1 AND n >= 12 THEN 'high' WHEN q < 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "company_share_matrix": """WITH m AS (SELECT s_name AS company, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ym, sum(l_extendedprice * (1 - l_discount)) AS amt FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
        SELECT c.company, t.ym, round(coalesce(100 * (SELECT amt FROM m WHERE m.company = c.company AND m.ym = t.ym) / t.x, 0), 4) AS share FROM (SELECT DISTINCT company FROM m) c, (SELECT ym, sum(amt) AS x FROM m GROUP BY ym) t""",
    "largest_brand_series": """WITH m AS (SELECT p_brand AS brand, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ym, sum(l_extendedprice * (1 - l_discount)) AS amt FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL)
        SELECT brand, ym, round(amt, 4) AS amt FROM m WHERE brand IN (SELECT brand FROM m GROUP BY brand ORDER BY sum(amt) DESC, brand LIMIT 6)""",
    "representative_brands": """WITH f AS (SELECT s_name AS company, p_brand AS brand, p_type AS cat, l_extendedprice * (1 - l_discount) AS amt FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey),
        b AS (SELECT company, brand, round(sum(amt), 2) AS amt, bool_or(cat LIKE 'PROMO%' AND amt > 90000) AS cur FROM f GROUP BY company, brand),
        o AS (SELECT company, brand, cur, row_number() OVER (PARTITION BY company ORDER BY cur DESC, CASE WHEN cur THEN brand END, amt DESC, brand) AS slot FROM b)
        SELECT c.company, CAST(n.slot AS INTEGER) AS slot, coalesce(brand, '') AS brand, CASE WHEN brand IS NULL THEN 'none' WHEN cur THEN 'curated' ELSE 'recommended' END AS reason
        FROM (SELECT DISTINCT company FROM b) c CROSS JOIN (SELECT unnest(range(1, 6)) AS slot) n LEFT JOIN o ON o.company = c.company AND o.slot = n.slot""",
    "business_numbers": """WITH k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '12345' || c_custkey WHEN 1 THEN CAST(c_custkey AS VARCHAR) END AS d FROM customer), n AS (SELECT c_custkey, CASE WHEN len(d) <= 10 THEN lpad(d, 10, '0') END AS number FROM k)
        SELECT c_custkey, number, number[1:3] || '-' || number[4:5] || '-' || number[6:10] AS form, 'M' || c_custkey || CASE WHEN c_custkey % 4 = 3 THEN '__OTHER' ELSE '' END AS merchant FROM n""",
    "signed_orders": "SELECT o_orderstatus, o_orderkey % 2 = 0 AND o_custkey % 3 > 0 AND o_totalprice > 1000 AND o_orderstatus <> 'P' AS paid, count(*) AS n FROM orders GROUP BY ALL",
    "amounts_in_won": "SELECT p_partkey, round(p_retailprice * [1, 1000, 1000000, 100000000, 1][p_size % 5 + 1], 2) AS won FROM part",
    "order_cumulative_rate": """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS u FROM lineitem GROUP BY l_orderkey), t AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, u, o_totalprice AS x FROM orders JOIN l ON o_orderkey = l_orderkey),
        g AS (SELECT o_orderpriority, day, sum(u) AS u, sum(x) AS x FROM t GROUP BY ALL), d AS (SELECT DISTINCT day FROM g), p AS (SELECT o_orderpriority, min(day) AS first FROM g GROUP BY ALL)
        SELECT p.o_orderpriority, CAST(d.day AS VARCHAR) AS day, round(sum(x) OVER w / nullif(sum(u) OVER w, 0), 4) AS rate FROM p JOIN d ON d.day >= first LEFT JOIN g ON g.o_orderpriority = p.o_orderpriority AND g.day = d.day WINDOW w AS (PARTITION BY p.o_orderpriority ORDER BY d.day)""",
}
