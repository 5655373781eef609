"""Queries of the operators on companies and currencies, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import currency, dashboard, entities, receivables
from quillon.sources.roles import facts, table


def _whole(x: str):
    return F.floor(x).cast("long").cast("string")


def order_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' whole amounts as industry codes: codes learned from parts' prices, prefixes from suppliers' balances."""
    codes = table(spark, sf_dir, "orders").select("o_orderkey", _whole("o_totalprice").alias("code"))
    learned = table(spark, sf_dir, "part").select(_whole("p_retailprice").alias("code"), F.col("p_type").alias("industry"))
    builtin = table(spark, sf_dir, "supplier").select(F.left(_whole("s_acctbal"), F.lit(3)).alias("code"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("industry"))
    return entities.industry_by_prefix(codes, "code", learned, builtin).select("o_orderkey", "industry")


def order_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector of the orders' amounts by first two digits, ranges of them, or the letter of open orders' priority."""
    codes = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.substring("o_orderpriority", 3, 20)).otherwise(_whole("o_totalprice")).alias("code"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    details = nation.where("n_regionkey = 0").select((F.col("n_nationkey") + 10).cast("string").alias("division"), F.col("n_name").alias("sector"))
    low = F.lit(20) + 15 * F.col("r_regionkey")
    ranges = region.select(low.alias("low"), (low + 9).alias("high"), F.col("r_name").alias("sector"))
    letters = table(spark, sf_dir, "orders").where("o_orderpriority < '4'").select(F.lower(F.substring("o_orderpriority", 3, 1)).alias("letter"), F.col("o_orderpriority").alias("sector")).distinct()
    return entities.sector_by_division(codes, "code", details, ranges, letters).select("o_orderkey", "sector")


def part_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names looked up among names that some of them begin or end."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") > 45, F.col("p_name")).when(F.col("p_size") > 20, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    firms = part.where("p_retailprice < 1000").select(name.alias("name"), F.initcap("p_name").alias("name_en"), F.when(F.col("p_size") % 3 == 0, F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("stock"), F.col("p_partkey").alias("code"))
    out = entities.largest_shareholders(part.select("p_partkey", F.when(F.col("p_type") != "SMALL", F.col("p_name")).otherwise(F.col("p_type")).alias("holder")), "holder", firms)
    return out.select("p_partkey", "holder_en", "holder_status", "holder_isin", "holder_source")


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of every order's chain of orders before it, and how far back it is."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey", before.alias("previous"))
    return entities.ultimate_parents(edges, "o_orderkey", "previous")


def currency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the first days of months, with daily means of orders and order lines in the place of rates and prices."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = F.col("o_orderdate").cast("date")
    by = {"DXY": "1-URGENT", "KOSPI": "2-HIGH", "BRENT": "3-MEDIUM", "WTI": "4-NOT SPECIFIED", "CNY": "5-LOW"}
    key = F.element_at(F.create_map(*(F.lit(v) for kv in by.items() for v in reversed(kv))), F.col("o_orderpriority"))
    series = orders.groupBy(F.lit("USDKRW").alias("key"), day.alias("day")).agg(F.avg("o_totalprice").alias("value"))
    series = series.unionByName(orders.groupBy(key.alias("key"), day.alias("day")).agg(F.avg("o_totalprice").alias("value")))
    series = series.unionByName(lines.groupBy(F.lit("UST10Y").alias("key"), F.col("l_shipdate").cast("date").alias("day")).agg((100 * F.avg("l_discount")).alias("value")))
    days = orders.select(F.trunc(day, "month").alias("day"))
    out = currency.currency_scores(series, days)
    return out.select(F.col("day").cast("string").alias("day"), *((F.round(c, 4) + 0).alias(c) for c in ("short", "mid", "combined")), "advice")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts and collections as JSON documents, one of each per customer: from the first order to the last, a record per order."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    one = orders.groupBy("o_custkey").agg(F.min("day").alias("a"), F.max("day").alias("b"), (12 * F.floor(F.sum("o_totalprice") / 12)).cast("double").alias("fee"), F.max_by("o_orderstatus", F.struct("o_orderkey")).alias("s"))
    c = one.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    often = F.element_at(F.create_map(*(F.lit(x) for x in ("AUTOMOBILE", "monthly", "BUILDING", "annually", "MACHINERY", "one-time", "HOUSEHOLD", "Quarterly"))), F.col("c_mktsegment"))
    share = lambda owner, ratio, amount, mode: F.struct(owner.alias("owner"), ratio.alias("ratio"), amount.alias("amount"), F.lit(mode).alias("mode"))
    shares = F.array(share(F.col("c_mktsegment"), F.lit(0.3), F.lit(0.0), "ratio"), share(F.lit("fixed"), F.lit(0.0), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0), "amount"))
    contract = F.struct(
        F.col("c_custkey").cast("string").alias("id"), often.alias("billing_frequency"), (F.col("s") == "O").alias("auto_renewal"), F.col("a").cast("string").alias("effective_date"), F.col("b").cast("string").alias("subscription_end_date"),
        F.col("fee").alias("yearly_fee"), F.when(F.col("c_nationkey") < 12, "USD").otherwise("KRW").alias("currency"), F.col("c_nationkey").alias("payment_terms_days"), shares.alias("revenue_shares"),
    )
    contracts = c.select(F.lit("contracts").alias("name"), F.to_json(F.array(contract)).alias("data"))
    by_day = orders.groupBy("o_custkey", "day").agg(F.min("o_orderstatus").alias("s"), F.max("o_orderpriority").alias("p")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    steps = F.create_map(F.col("c_mktsegment"), F.struct(F.lit(True).alias("tax_invoice"), F.lit(True).alias("expense"), (F.col("p") < "3").alias("paid")), F.lit("fixed"), F.struct(F.lit(True).alias("tax_invoice"), F.lit(True).alias("expense"), F.lit(True).alias("paid")))
    record = F.struct((F.col("s") != "P").alias("manager"), F.lit(True).alias("accounting"), F.lit(True).alias("ar"), (F.col("p") != "5-LOW").alias("invoiced"), F.date_add("day", 3).cast("string").alias("invoiced_at"), F.date_add("day", 40).cast("string").alias("paid_at"), steps.alias("payout"))
    keyed = F.struct(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("day").cast("string")).alias("k"), record.alias("v"))
    collections = by_day.groupBy("o_custkey").agg(F.collect_list(keyed).alias("r")).select(F.lit("collections").alias("name"), F.to_json(F.map_from_entries("r")).alias("data"))
    return contracts.unionByName(collections)


def receivable_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of contracts read from JSON, as of the first of 2000."""
    store = _store(spark, sf_dir)
    out = receivables.receivables(receivables.contracts_of(store), receivables.collections_of(store), F.lit("2000-01-01").cast("date"), 1400.0)
    paid = F.aggregate("payouts", F.lit(0.0), lambda s, p: s + p["amount"])
    done = F.size(F.filter("payouts", lambda p: p["done"]))
    return out.select("id", *(F.col(c).cast("string").alias(c) for c in ("due", "payment_due", "payout_due")), F.round("base_amount", 2).alias("base_amount"), "stage", F.size("payouts").alias("partners"), done.alias("partners_done"), F.round(12 * paid, 2).alias("dozen_payouts"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"ym", "company", "amt"})
    return f.groupBy("company", F.col("ym").alias("period")).agg(F.sum("amt").alias("sales"), F.count("*").alias("tx"))


def anomaly_events_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of companies out of line by interquartile ranges or by a z-score over 2.5, in a window of nine."""
    return dashboard.anomalies(_panel(spark, sf_dir), "both", window=9)


def demand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dashboard.demand(_panel(spark, sf_dir))
    return out.select("company", "period", *((F.round(c, 4) + 0).alias(c) for c in ("sales_chg", "tx_chg", "ticket_chg", "sales_accel")), "driver", "demand_score")


def company_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.dashboard(_panel(spark, sf_dir), window=9, threshold=2.0)


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the order lines, with dates, sales and counts missing where flags and taxes say so."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when((F.col("l_returnflag") != "R") | (F.col("l_tax") > 0), F.col("l_shipdate")).alias("day"), F.when(F.col("l_linestatus") != "F", F.nullif(F.col("l_linenumber"), F.lit(7))).alias("tx"),
        F.when(F.col("l_discount") < 0.1, F.round(F.col("l_quantity") * F.col("l_quantity") * F.when(F.col("l_tax") > 0.07, -1).when(F.col("l_tax") > 0.06, 0).otherwise(1))).alias("sales"),
    )
    return dashboard.data_quality(rows, "day", "sales", "tx")


QUERIES = {f.__name__: f for f in (order_industries, order_sectors, part_holders, first_orders, currency_scores, receivable_stages, anomaly_events_both, demand_scores, company_dashboard, line_quality)}

_PANEL = """m AS (SELECT s_name AS company, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS period, sum(l_extendedprice * (1 - l_discount)) AS sales, count(*) :: DOUBLE AS tx FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
             l AS (SELECT company, list(period ORDER BY period) AS ps, list(sales ORDER BY period) AS ss, list(tx ORDER BY period) AS xs FROM m GROUP BY company)"""
_EVENTS = """v AS (SELECT company, 'sales' AS metric, ps, ss AS vs FROM l WHERE len(ps) >= 3 UNION ALL SELECT company, 'tx', ps, xs FROM l WHERE len(ps) >= 3),
             w AS (SELECT company, metric, ps[i] AS period, vs[i] AS x, vs[greatest(1, i - {0} + 1):i] AS w FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM v)),
             z AS (SELECT *, list_avg(w) AS a, round((x - list_avg(w)) / nullif(list_stddev_samp(w), 0), 2) AS z, list_aggregate(w, 'quantile_cont', 0.25) AS q1, list_aggregate(w, 'quantile_cont', 0.75) AS q3 FROM w WHERE len(w) >= 3),
             ev AS (SELECT *, round_even(a, 0) AS e, CASE WHEN abs(z) >= 5 THEN 'critical' WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE abs(z) > {1} OR ({2} AND q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))))"""
_DEMAND = """i AS (SELECT company, ps, ss, xs, list_transform(ss, lambda s, k: s / xs[k]) AS ts, unnest(range(1, len(ps) + 1)) AS i FROM l),
             c AS (SELECT company, i, len(ps) AS n, ps[i] AS period, CASE WHEN i > 1 THEN 100 * (ss[i] / ss[i - 1] - 1) END AS sc, CASE WHEN i > 1 THEN 100 * (xs[i] / xs[i - 1] - 1) END AS xc, CASE WHEN i > 1 THEN 100 * (ts[i] / ts[i - 1] - 1) END AS tc,
                          CASE WHEN i > 2 THEN 100 * (ss[i] / ss[i - 1] - ss[i - 1] / ss[i - 2]) END AS ac, CASE WHEN i > 1 THEN ss[i] - ss[i - 1] END AS d, CASE WHEN i > 1 THEN ts[i - 1] * (xs[i] - xs[i - 1]) END AS vo, CASE WHEN i > 1 THEN xs[i - 1] * (ts[i] - ts[i - 1]) END AS pr FROM i),
             a AS (SELECT company, avg(sc) AS s, avg(xc) AS x, avg(tc) AS t, avg(ac) AS a FROM c WHERE i > n - 3 GROUP BY company),
             sc AS (SELECT company, round(0.3 * coalesce(least(100, greatest(0, s + 50)), 50) + 0.25 * coalesce(least(100, greatest(0, x + 50)), 50) + 0.2 * coalesce(least(100, greatest(0, t + 50)), 50) + 0.25 * CASE WHEN a IS NULL THEN 50 ELSE least(100, greatest(0, (a + 20) * 2.5)) END, 1) :: DOUBLE AS score FROM a),
             dm AS (SELECT c.*, score, CASE WHEN d IS NULL OR d = 0 THEN '' WHEN d > 0 THEN CASE WHEN vo >= 0.6 * greatest(abs(d), 1) THEN 'volume' WHEN pr >= 0.6 * greatest(abs(d), 1) THEN 'price' WHEN vo > 0 AND pr > 0 THEN 'volume and price' ELSE 'other' END
                           WHEN vo < 0 AND pr < 0 THEN 'both fall' WHEN abs(vo) >= abs(pr) THEN 'volume falls' ELSE 'price falls' END AS driver FROM c JOIN sc USING (company))"""

ORACLE = {
    "anomaly_events_both": f"""WITH {_PANEL}, {_EVENTS.format(9, 2.5, "true")}
        SELECT company, period, metric, CASE WHEN x >= a THEN 'rise' ELSE 'fall' END AS kind, round_even(x, 0) AS actual, e AS expected, round(100 * (x - e) / nullif(e, 0), 1) + 0 AS deviation, z, severity FROM ev""",
    "demand_scores": f"WITH {_PANEL}, {_DEMAND} SELECT company, period, round(sc, 4) + 0 AS sales_chg, round(xc, 4) + 0 AS tx_chg, round(tc, 4) + 0 AS ticket_chg, round(ac, 4) + 0 AS sales_accel, driver, score AS demand_score FROM dm",
    "company_dashboard": f"""WITH {_PANEL}, {_EVENTS.format(9, 2.0, "false")}, {_DEMAND},
             n AS (SELECT company, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM ev GROUP BY company),
             o AS (SELECT dm.*, coalesce(n.n, 0) AS events, coalesce(c, 0) AS critical, round(sc, 1) AS mom, least(25, coalesce(10 * c + 5 * h + 2 * m, 0)) AS cost FROM dm LEFT JOIN n USING (company) WHERE i = dm.n),
             p AS (SELECT *, round(CASE WHEN mom IS NULL THEN 20 ELSE least(40, greatest(0, (mom + 30) / 60 * 40)) END + score * 0.35 + 25 - cost, 1) AS points FROM o)
        SELECT company, mom, round(ac, 1) AS accel, CASE WHEN ac > 2 THEN 'accelerates' WHEN sc > 5 THEN 'grows' WHEN ac < -2 THEN 'slows' ELSE 'flat' END AS trend, driver, score AS demand_score, events, critical, points AS score,
               CASE WHEN points >= 75 THEN 'strong buy' WHEN points >= 60 THEN 'buy' WHEN points >= 45 THEN 'neutral' WHEN points >= 30 THEN 'caution' ELSE 'risk' END AS band FROM p""",
    "line_quality": """
        WITH r AS (SELECT CASE WHEN l_returnflag <> 'R' OR l_tax > 0 THEN l_shipdate END AS day, CASE WHEN l_linestatus <> 'F' THEN nullif(l_linenumber, 7) END AS tx,
                          CASE WHEN l_discount < 0.1 :: DOUBLE THEN l_quantity * l_quantity * CASE WHEN l_tax > 0.07 :: DOUBLE THEN -1 WHEN l_tax > 0.06 :: DOUBLE THEN 0 ELSE 1 END END AS sales FROM lineitem),
             q AS (SELECT quantile_cont(sales, 0.25) AS a, quantile_cont(sales, 0.75) AS b FROM r),
             g AS (SELECT count(*) AS n, count(*) - count(day) AS nd, count(*) - count(sales) AS ns, count(*) - count(tx) AS nt, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS rep, count(*) FILTER (sales < 0) AS neg, count(*) FILTER (sales = 0) AS zero,
                          count(*) FILTER (sales < a - 1.5 * (b - a) OR sales > b + 1.5 * (b - a)) AS far, count(*) FILTER (day IS NOT NULL AND sales IS NOT NULL) AS ok FROM r, q),
             c AS (SELECT unnest(['no_date', 'no_sales', 'no_tx', 'repeated', 'negative', 'zero', 'outliers', 'usable_rows']) AS "check", unnest(['error', 'error', 'warning', 'warning', 'warning', 'info', 'info', 'ok']) AS bad, unnest([nd, ns, nt, rep, neg, zero, far, ok]) AS n,
                          unnest([floor(least(30, 50.0 * nd / n)), floor(least(25, 40.0 * ns / n)), floor(least(5, 5.0 * nt / n)), CASE WHEN 20 * rep > n THEN 10 ELSE 5 END, 5, CASE WHEN 20 * zero > n THEN 5 ELSE 2 END, CASE WHEN 10 * far > n THEN 5 WHEN 20 * far > n THEN 3 ELSE 0 END, 0]) AS cut FROM g),
             d AS (SELECT "check", CASE WHEN n > 0 THEN bad ELSE 'ok' END AS severity, n, CASE WHEN n > 0 THEN cut ELSE 0 END :: INT AS cut FROM c)
        SELECT *, greatest(0, 100 - sum(cut) OVER ()) :: INT AS score FROM d""",
    "order_industries": """
        WITH o AS (SELECT o_orderkey, floor(o_totalprice) :: BIGINT :: VARCHAR AS c FROM orders), l AS (SELECT floor(p_retailprice) :: BIGINT :: VARCHAR AS c, min(p_type) AS i FROM part GROUP BY 1),
             b AS (SELECT left(floor(s_acctbal) :: BIGINT :: VARCHAR, 3) AS c, min('S' || s_nationkey) AS i FROM supplier GROUP BY 1)
        SELECT o_orderkey, coalesce((SELECT i FROM l WHERE l.c = o.c), (SELECT arg_max(i, length(b.c)) FROM b WHERE length(b.c) IN (2, 3) AND starts_with(o.c, b.c)), (SELECT arg_max(i, length(l.c)) FROM l WHERE length(l.c) IN (2, 3, 4) AND starts_with(o.c, l.c))) AS industry FROM o""",
    "order_sectors": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN left(floor(o_totalprice) :: BIGINT :: VARCHAR, 2) :: INT END AS d, CASE WHEN o_orderstatus = 'P' AND o_orderpriority < '4' THEN o_orderpriority END AS p FROM orders)
        SELECT o_orderkey, coalesce(n_name, r_name, p, 'Unclassified') AS sector
        FROM o LEFT JOIN nation ON n_regionkey = 0 AND n_nationkey + 10 = d LEFT JOIN region ON d BETWEEN 20 + 15 * r_regionkey AND 29 + 15 * r_regionkey""",
    "part_holders": """
        WITH f AS (SELECT CASE WHEN p_size > 45 THEN p_name WHEN p_size > 20 THEN p_name || ' ' || p_brand ELSE p_brand || ' ' || p_name END AS n, p_name AS e, CASE WHEN p_size % 3 = 0 THEN lpad(p_partkey :: VARCHAR, 6, '0') END AS stock, p_partkey AS code FROM part WHERE p_retailprice < 1000),
             s AS (SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_name ELSE p_type END AS h FROM part), h AS (SELECT DISTINCT h FROM s),
             m AS (SELECT h, f.*, n = h AS same FROM h JOIN f ON n = h OR (length(h) >= 3 AND (starts_with(n, h) OR ends_with(n, h)) AND 2 * length(h) >= length(n)) QUALIFY row_number() OVER (PARTITION BY h ORDER BY n = h DESC, stock IS NULL, code) = 1),
             d AS (SELECT *, 'KR7' || stock || '00' AS body, list_transform(string_split('KR7' || stock || '00', ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55) :: VARCHAR ELSE c END) AS ds FROM m),
             g AS (SELECT *, list_reverse(string_split(array_to_string(ds, ''), '')) AS r FROM d),
             i AS (SELECT *, body || (10 - list_sum(list_transform(r, lambda c, k: CASE WHEN k % 2 = 1 THEN (2 * c :: INT) // 10 + (2 * c :: INT) % 10 ELSE c :: INT END)) % 10) :: INT % 10 AS isin FROM g)
        SELECT p_partkey, coalesce(upper(e), s.h) AS holder_en, CASE WHEN stock IS NOT NULL THEN 'KOSPI / KOSDAQ' ELSE '' END AS holder_status, coalesce(isin, '') AS holder_isin,
               CASE WHEN same THEN 'exact' WHEN same IS NOT NULL THEN 'prefix_suffix' ELSE 'unmatched' END AS holder_source FROM s LEFT JOIN i USING (h)""",
    "first_orders": """
        SELECT o_orderkey AS child, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY depth > 0""",
    "currency_scores": """
        WITH s AS (SELECT 'USDKRW' AS k, o_orderdate :: DATE AS day, avg(o_totalprice) AS v FROM orders GROUP BY ALL
                   UNION ALL SELECT ['DXY', 'KOSPI', 'BRENT', 'WTI', 'CNY'][left(o_orderpriority, 1) :: INT], o_orderdate :: DATE, avg(o_totalprice) FROM orders GROUP BY ALL
                   UNION ALL SELECT 'UST10Y', l_shipdate :: DATE, 100 * avg(l_discount) FROM lineitem GROUP BY ALL),
             l AS (SELECT k, list(day ORDER BY day) AS ds, list(v ORDER BY day) AS vs FROM s GROUP BY k),
             i AS (SELECT k, ds[i] AS day, vs[1:i] AS x, i AS n FROM (SELECT *, unnest(range(2, len(vs) + 1)) AS i FROM l)),
             m AS (SELECT k, day, x[-1] AS last, CASE WHEN n >= 20 THEN list_avg(x[-20:]) END AS ma20, CASE WHEN n >= 60 THEN list_avg(x[-60:]) END AS ma60, CASE WHEN n >= 200 THEN list_avg(x[-200:]) END AS ma200,
                          CASE WHEN n > 5 THEN 100 * (x[-1] / x[-6] - 1) END AS p5, CASE WHEN n > 60 THEN 100 * (x[-1] / x[-61] - 1) END AS p60, CASE WHEN n > 5 THEN x[-1] - x[-6] END AS c5, CASE WHEN n > 60 THEN x[-1] - x[-61] END AS c60,
                          list_avg(list_transform(range(14), lambda j: greatest(x[n - j] - x[n - j - 1], 0))) AS up, list_avg(list_transform(range(14), lambda j: greatest(x[n - j - 1] - x[n - j], 0))) AS down, n FROM i),
             r AS (SELECT *, CASE WHEN n < 15 OR (up = 0 AND down = 0) THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM m),
             d AS (SELECT DISTINCT date_trunc('month', o_orderdate) :: DATE AS day FROM orders),
             a AS (SELECT d.day, q.k, r.* EXCLUDE (day, k) FROM (SELECT d.day, l.k FROM d, l) q JOIN d USING (day) ASOF JOIN r ON r.k = q.k AND q.day >= r.day),
             p AS (SELECT u.day, u.last, u.ma20, u.ma60, u.ma200, u.p5, u.rsi, 100 * (u.last / u.ma20 - 1) AS near, (SELECT p5 FROM a WHERE k = 'DXY' AND day = u.day) AS dxy5, (SELECT p60 FROM a WHERE k = 'DXY' AND day = u.day) AS dxy60,
                          (SELECT c5 FROM a WHERE k = 'UST10Y' AND day = u.day) AS ust5, (SELECT c60 FROM a WHERE k = 'UST10Y' AND day = u.day) AS ust60, (SELECT p5 FROM a WHERE k = 'KOSPI' AND day = u.day) AS ko5, (SELECT p60 FROM a WHERE k = 'KOSPI' AND day = u.day) AS ko60,
                          (SELECT p5 FROM a WHERE k = 'CNY' AND day = u.day) AS cny5, (SELECT p60 FROM a WHERE k = 'CNY' AND day = u.day) AS cny60, (SELECT avg(p60) FROM a WHERE k IN ('WTI', 'BRENT') AND day = u.day) AS oil FROM a u WHERE u.k = 'USDKRW'),
             z AS (SELECT day, least(100, greatest(-100, CASE WHEN rsi >= 70 THEN greatest(-25, -12.5 * ((rsi - 70) / 30 + 1)) WHEN rsi <= 30 THEN least(25, 12.5 * ((30 - rsi) / 30 + 1)) ELSE least(10, greatest(-10, (50 - rsi) * 0.2 :: DOUBLE)) END
                              + CASE WHEN 5 * p5 IS NULL THEN 0 ELSE least(15, greatest(-15, 5 * p5)) END + CASE WHEN 15 * dxy5 IS NULL THEN 0 ELSE least(15, greatest(-15, 15 * dxy5)) END + CASE WHEN 100 * ust5 IS NULL THEN 0 ELSE least(10, greatest(-10, 100 * ust5)) END - CASE WHEN 5 * ko5 IS NULL THEN 0 ELSE least(10, greatest(-10, 5 * ko5)) END
                              + CASE WHEN 10 * cny5 IS NULL THEN 0 ELSE least(10, greatest(-10, 10 * cny5)) END + CASE WHEN CASE WHEN abs(near) <= 1.5 THEN 10 * near ELSE 5 * near END IS NULL THEN 0 ELSE least(15, greatest(-15, CASE WHEN abs(near) <= 1.5 THEN 10 * near ELSE 5 * near END)) END)) AS short,
                          least(100, greatest(-100, CASE WHEN 400 * (last / ma200 - 1) IS NULL THEN 0 ELSE least(20, greatest(-20, 400 * (last / ma200 - 1))) END + CASE WHEN 600 * (ma60 / ma200 - 1) IS NULL THEN 0 ELSE least(15, greatest(-15, 600 * (ma60 / ma200 - 1))) END + CASE WHEN 4 * dxy60 IS NULL THEN 0 ELSE least(20, greatest(-20, 4 * dxy60)) END
                              + CASE WHEN 30 * ust60 IS NULL THEN 0 ELSE least(15, greatest(-15, 30 * ust60)) END - CASE WHEN 1.5 * ko60 IS NULL THEN 0 ELSE least(10, greatest(-10, 1.5 * ko60)) END + CASE WHEN 4 * cny60 IS NULL THEN 0 ELSE least(10, greatest(-10, 4 * cny60)) END + CASE WHEN oil IS NULL THEN 0 ELSE least(10, greatest(-10, oil)) END)) AS mid FROM p)
        SELECT day :: VARCHAR AS day, round(short, 4) + 0 AS short, round(mid, 4) + 0 AS mid, round((short + mid) / 2, 4) + 0 AS combined,
               CASE WHEN short <= -35 AND mid <= -20 THEN 'at once' WHEN least(short, mid) <= -20 AND greatest(short, mid) < 20 THEN 'in parts' WHEN short >= 35 AND mid >= 20 THEN 'wait' WHEN greatest(short, mid) >= 20 AND least(short, mid) > -20 THEN 'only what is needed' ELSE 'by need' END AS advice FROM z""",
    "receivable_stages": """
        WITH o AS (SELECT *, o_orderdate :: DATE AS day FROM orders), g AS (SELECT o_custkey AS c, min(day) AS a, max(day) AS b, 12.0 :: DOUBLE * floor(sum(o_totalprice) / 12) AS fee, arg_max(o_orderstatus, o_orderkey) AS s FROM o GROUP BY ALL),
             k AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 12 ELSE 3 END AS step, c_mktsegment = 'MACHINERY' AS once, CASE WHEN s = 'O' THEN greatest(b, DATE '2000-12-31') ELSE b END AS e FROM g JOIN customer ON c_custkey = c),
             p AS (SELECT *, (a + to_months(CAST(i * step AS INTEGER))) :: DATE AS due FROM (SELECT *, unnest(range(0, CASE WHEN once THEN 1 ELSE 600 END)) AS i FROM k)),
             q AS (SELECT *, round_even(fee / CASE WHEN once OR step = 12 THEN 1 WHEN step = 1 THEN 12 ELSE 4 END, 2) AS x FROM p WHERE once OR due <= e),
             r AS (SELECT o_custkey, day, min(o_orderstatus) <> 'P' AS paid, max(o_orderpriority) AS pr FROM o GROUP BY ALL),
             j AS (SELECT q.*, coalesce(pr <> '5-LOW', false) AS inv, coalesce(paid, false) AS pd, coalesce(pr < '3', false) AS first, pr IS NOT NULL AS rec FROM q LEFT JOIN r ON o_custkey = c AND day = due)
        SELECT c :: VARCHAR AS id, due :: VARCHAR AS due, CASE WHEN inv THEN (due + 3 + c_nationkey) :: VARCHAR END AS payment_due, CASE WHEN pd THEN last_day(date_trunc('quarter', due + 40) + INTERVAL 3 MONTH) :: VARCHAR END AS payout_due,
               round(CASE WHEN c_nationkey < 12 THEN 1400 * x ELSE x END, 2) AS base_amount,
               CASE WHEN NOT inv THEN CASE WHEN due > DATE '2000-01-01' THEN 'planned' ELSE 'to_invoice' END WHEN NOT pd THEN CASE WHEN due + 3 + c_nationkey < DATE '2000-01-01' THEN 'overdue' ELSE 'waiting' END WHEN NOT first THEN 'payout' ELSE 'done' END AS stage,
               1 + (c_acctbal > 0) :: INT AS partners, first :: INT + (rec AND c_acctbal > 0) :: INT AS partners_done, round(12 * (x * 0.3 :: DOUBLE + CASE WHEN c_acctbal > 0 THEN x * (c_acctbal / fee) ELSE 0 END), 2) AS dozen_payouts FROM j""",
}
