"""Queries of the product, registry, universe and market operators, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import factors, market, products, registry, universe
from quillon.operators.text import isin_check_digit
from quillon.sources.roles import facts, table


def _pick(key: str, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


#: Endings of product names: pieces, sizes and forms in their usual spellings.
_ENDINGS = ("컵 65g 4개입", "소캔355ml*6", " 봉지(구) 1.8L", "매운맛", "큰사발 2리터 10입")


def sku_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"name": F.concat(F.lit("제조)"), "p_brand", _pick("p_partkey", _ENDINGS)), "cat": F.when(F.col("p_partkey") % 7 == 0, "캔")})
    out = products.sku_attributes(part, "name", "p_brand", "cat", "p_retailprice", "p_size")
    return out.select("p_partkey", "pack_count", "is_multipack", "size_value", "size_unit", "package_form", "family", "variant", "asp")


def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pick("p_partkey", ("신라면_큰컵(매운맛) 4P 행사", "할인 특가 불닭/볶음면  5개입", "한국 a-b"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", products.clean_name(x).alias("clean"), F.array_join(products.promotions(x), ",").alias("tags"), products.without_promotions(x).alias("plain"), products.romanized(x).alias("latin")
    )


def _isin(key: Column) -> Column:
    body = F.concat(F.lit("KR7"), F.lpad(key.cast("string"), 6, "0"), F.lit("00"))
    return F.concat(body, isin_check_digit(body).cast("string"))


def security_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    good = _isin(key)
    given = F.when(key % 2 == 0, good).otherwise(F.concat(F.substring(good, 1, 11), ((F.substring(good, 12, 1).cast("int") + 1) % 10).cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", products.isin_valid(given).alias("valid"), products.isin_fixed(given).alias("isin"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = key.cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lpad(text, 6, "0").alias("code"), _isin(key).alias("isin"), (key + 90_000_000).cast("string").alias("corp"), F.concat(F.lit("공급사"), text).alias("name_kr"),
        F.concat(F.lit("Harbor Elec Hldgs Unit"), text, F.lit(" Co., Ltd.")).alias("name_en"), F.concat(F.lit("Supply "), text, F.lit(" Co., Ltd.")).alias("reg_name"),
        (key % 2 == 0).alias("listed"), (20_240_100 + key % 5).alias("modified"), F.when(key % 3 == 0, F.lpad(text, 6, "0")).alias("stock"),
    )


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    text = F.col("s_suppkey").cast("string")
    wrong = F.concat(F.substring("isin", 1, 11), ((F.substring("isin", 12, 1).cast("int") + 3) % 10).cast("string"))
    forms = F.array(
        F.concat("code", F.lit(" KS Equity")), F.concat("code", F.lit(".KQ")), F.col("isin"), wrong, F.col("corp"), text, F.col("name_kr"),
        F.concat(F.lit("HARBOR ELEC HLDGS UNIT"), text, F.lit(" Corp")), F.concat(F.lit("Unit"), text, F.lit(" Harbor")), F.lit("nobody here"),
    )
    asked = r.select("s_suppkey", F.element_at(forms, (F.col("s_suppkey") % 10 + 1).cast("int")).alias("q"))
    return registry.identify(asked, "q", r.drop("s_suppkey")).select("s_suppkey", "code", "how", "score")


def registry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    asked = r.select(F.concat(F.lit("SUPPLY-"), F.col("s_suppkey").cast("string")).alias("name"))
    best = F.min(F.when(F.col("rank") == 1, F.col("code")))
    return registry.candidates(asked, "name", r).groupBy("name").agg(F.min("how").alias("status"), F.count("*").alias("n"), best.alias("code"))


def registry_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock codes of every fourth supplier, names of the others; every fifth name is cut short."""
    r, key = _registry(spark, sf_dir), F.col("s_suppkey")
    name = F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit(" zz"))).otherwise(F.concat(F.lit("supply"), key.cast("string")))
    asked = r.select("s_suppkey", name.alias("name"), F.when(key % 4 == 0, F.concat(F.lit("A"), "code")).alias("stock_text"))
    return registry.match_registry(asked, "name", "stock_text", r).select("s_suppkey", "code", "how")


def share_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    pairs = r.where("s_suppkey % 10 = 0").select(F.col("code").alias("common"), F.lpad((F.col("s_suppkey") + 5).cast("string"), 6, "0").alias("preferred"))
    return registry.related(r, pairs)


def keyword_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 40).cast("string")).alias("brand"))
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word")).unionByName(s.select(F.col("company").alias("word"))).distinct()
    return registry.keyword_companies(words, "word", s, "company", s, ["brand"])


def catalog_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), (F.col("s_acctbal") / 10000).alias("signal_score"), ((F.col("s_suppkey") % 50) / 100 - 0.15).alias("ic"), (F.col("s_suppkey") % 100).alias("hit_ratio_pct"))
    return universe.best_companies(s, 20).select("company", F.round("quality", 6).alias("quality"))


def company_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), k.alias("k"), _pick("s_suppkey", ("ramen", "holding", "dairy", "meat")).alias("segment"), (k % 3 > 0).alias("listed"))
    k = F.col("k")
    trends = s.where("k % 2 = 0").select("company", ((k % 7 - 3) / 3).alias("trend"))
    news = s.where("k % 3 = 0").select("company", (k * 37 % 600).cast("double").alias("news"))
    made = s.where("k % 5 = 0").select("company", (k % 6).alias("products"))
    consensus = s.where("k % 4 = 1").select("company", F.when(k % 8 == 1, (k % 9 - 4) / 4).alias("revision"), (k % 11 / 10).alias("dispersion"))
    scored = universe.scored_signals(universe.signals_of(s, trends, news, made, consensus))
    return universe.recommendations(scored).select("company", F.round("heat", 6).alias("heat"), F.round("opportunity", 6).alias("opportunity"), "priority", "status", "action", "confidence")


def use_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"ym", "company", "code", "brand", "sku", "amt", "qty"})
    panel = f.groupBy("company", "brand", "code", "ym").agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty"))
    skus = f.groupBy("sku").agg(F.max(F.when(F.col("sku") % 2 == 0, F.col("code"))).alias("code"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.sum("amt").alias("amt"))
    return universe.use_cases(panel, skus, new_months=80)


def brand_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"company", "brand", "amt"})
    out = universe.review_queue(f, ["company", "brand"], "amt", F.col("brand").endswith("1"))
    return out.withColumn("sales", F.round("sales", 4))


def overridden_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("shown"), F.lit("low").alias("confidence"))
    given = part.select("p_brand").distinct().select("p_brand", F.when(F.col("p_brand").endswith("3"), "  ").otherwise(F.concat(F.lit(" "), F.upper("p_brand"))).alias("shown")).where("p_brand NOT LIKE '%2'")
    return universe.apply_overrides(part, given, ["p_brand"], "shown", "confidence")


def delivery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 1, F.col("p_name")).alias("name"), "p_brand", (F.col("p_partkey") % 1900).alias("id"), F.col("p_retailprice").alias("amt"), (F.col("p_size") > 10).alias("mapped"))
    panel = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).otherwise(0.0).alias("amt"))
    return universe.quality_checks(master, panel, ["name", "p_brand"], "id", (1000.0, 4000.0))


def line_numbers_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = universe.numeric_quality(table(spark, sf_dir, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax") - 0.02, F.lit(0.0))), ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "max")})


def review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", universe.next_review(F.col("o_orderdate").cast("date")).cast("string").alias("next_review"))


def next_supplier_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.next_id(table(spark, sf_dir, "supplier"), "s_name", "Supplier#", 9)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"dt", "sector", "amt", "qty"})
    return f.groupBy(F.col("sector").alias("key"), F.col("dt").alias("day")).agg(F.sum("amt").alias("sales"), (F.sum("amt") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("price"), F.sum("qty").alias("volume"))


def _signals(daily: DataFrame, freq: str) -> DataFrame:
    return market.signals(daily, freq).select("key", "n", "lag", "corr", "hit_rate", "sample", "persistence", "stability", "volume_corr", "spikes", "score", "grade", "strength")


def signals_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(market.whole_market(_daily(spark, sf_dir)), "day")


def signals_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(_daily(spark, sf_dir), "week")


def signals_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(_daily(spark, sf_dir), "month")


def tracking_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a nation's suppliers against a scaled sum of its customers' orders, by quarter."""
    quarter = lambda d: (F.year(d) * 10 + F.quarter(d)).alias("quarter")
    sales = facts(spark, sf_dir, {"dt", "sector", "amt"}).groupBy(F.col("sector").alias("nation"), quarter("dt")).agg(F.sum("amt").alias("sales"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scale = F.when(F.col("n_nationkey") % 5 == 0, 0.05).when(F.col("n_nationkey") % 5 == 1, 0.8).otherwise(1.5)
    told = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("nation"), quarter("o_orderdate")).agg(F.sum(F.col("o_totalprice") * scale).alias("disclosed"))
    lead = sales.join(told, ["nation", "quarter"]).withColumn("tracking", F.round(100 * F.col("sales") / F.nullif(F.col("disclosed"), F.lit(0.0)), 1))
    out = market.tracking_sanity(lead, "nation")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "most", "std")})


_SIGNALS = ("share", "asp", "newproduct_share", "trend_share", "sales_yoy", "sales_mom", "sales_3m", "asp_yoy", "asp_mom", "share_mom", "share_yoy", "trend_share_yoy")


def alpha_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"ym", "code", "sku", "cat1", "amt", "qty"}).withColumn("trend", F.col("cat1") == "PROMO")
    out = market.alpha_panel(f)
    return out.select("code", "ym", F.col("available_date").cast("string").alias("available_date"), F.round("sales", 4).alias("sales"), "quantity", *((F.round(c, 4) + 0).alias(c) for c in _SIGNALS))


def delivery_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.delivery_facts(facts(spark, sf_dir, {"ym", "company", "brand", "sku", "amt", "qty"}))
    return out.select("tier", "company", "brand", "sku", "ym", F.col("available_date").cast("string").alias("available_date"), "quantity", *((F.round(c, 4) + 0).alias(c) for c in ("sales", "yoy", "mom")))


def basic_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"dt", "company", "brand", "amt", "qty"})
    daily = f.groupBy(F.col("dt").alias("day"), "company", "brand").agg(F.round(F.sum("amt"), 4).alias("amount"), F.sum("qty").alias("quantity"), F.count("*").alias("lines"))
    return market.basic_sales(daily, "all")


def basic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.basic_info(facts(spark, sf_dir, {"company", "brand"}).select("company", F.when(F.col("brand") != "Brand#1", F.col("brand")).otherwise(" ").alias("brand")))


def brand_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.brand_categories(facts(spark, sf_dir, {"company", "brand", "cat1"}))


def shifted_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"ym", "company", "amt", "qty"})
    panel = f.groupBy(F.col("company").alias("key"), "ym").agg(F.sum("amt").alias("sales"), (F.sum("amt") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("price"))
    return market.shifted_overlay(panel, 3).select("key", "ym", F.round("sales", 4).alias("sales"), F.round("price", 4).alias("price"))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase"]
    out = market.score_pivot(table(spark, sf_dir, "events"), "user_id", "event_type", kinds, "value")
    return out.select("user_id", *(F.round(k, 6).alias(k) for k in kinds))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, {"ym", "code", "sector", "amt"})
    return f.groupBy("code", "sector", "ym").agg(F.sum("amt").alias("sales"), F.count("*").alias("tx"))


_FEATURES = ("yoy", "delta", "smooth3", "z6", "tx_yoy", "atv", "atv_yoy", "price_effect")


def eight_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount of a transaction as its logarithm, since a mean of amounts in cents often lies halfway between two digits."""
    return factors.features(_codes(spark, sf_dir)).withColumn("atv", F.log("atv")).select("code", "ym", *((F.round(c, 4) + 0).alias(c) for c in _FEATURES))


def neutral_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth after all five steps, by month; rows of one nation have no sector."""
    p = factors.features(_codes(spark, sf_dir)).withColumnsRenamed({"ym": "date", "tx": "cap"}).withColumn("sector", F.nullif("sector", F.lit("NATION_3")))
    return factors.neutralised(p, "yoy", "factor").select("code", F.col("date").alias("ym"), (F.round("factor", 6) + 0).alias("factor"))


def neutral_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of growth after clipping and the deviation within sectors alone."""
    p = factors.features(_codes(spark, sf_dir)).withColumnsRenamed({"ym": "date", "tx": "cap"})
    return factors.neutralised(p, "delta", "factor", ("winsorize", "sector_z")).select("code", F.col("date").alias("ym"), (F.round("factor", 6) + 0).alias("factor"))


def tracking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a nation's suppliers against orders of its customers, by quarter."""
    quarter = lambda d: (F.year(d) * 10 + F.quarter(d)).alias("quarter")
    sales = facts(spark, sf_dir, {"dt", "sector", "amt"}).groupBy(F.col("sector").alias("nation"), quarter("dt")).agg(F.sum("amt").alias("sales"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("nation"), quarter("o_orderdate")).agg(F.sum("o_totalprice").alias("disclosed"))
    return factors.tracking_quality(sales, told, "nation")


def alpha_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    given = table(spark, sf_dir, "supplier").select(
        k, F.when(k % 5 > 0, k % 61 * 0.977 - 25).alias("mom"), F.when(k % 3 > 0, k % 83 * 0.977 - 30).alias("yoy"), F.when(k % 7 > 0, k % 97 * 0.977).alias("demand"), F.when(k % 4 > 0, k % 15 * 0.977).alias("anomalies"),
        F.when(k % 2 > 0, k % 12).alias("periods"), F.when(k % 6 > 0, k % 11 / 10).alias("lead_corr"),
    )
    return factors.alpha_score(given).select("s_suppkey", F.round("points", 1).alias("points"), "sure")


def supplier_isins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    k = F.col("s_suppkey")
    exchange = r.where("s_suppkey % 2 = 0").select("code", F.col("s_suppkey").cast("string").alias("stock"), "isin", F.lit("main").alias("market"))
    matches = r.select("s_suppkey", F.when(k % 5 > 0, F.col("corp")).otherwise(" ").alias("corp"), F.when(k % 5 > 0, F.when(k % 3 > 0, F.col("code"))).alias("stock"))
    return factors.isin_chain(matches, exchange).select("s_suppkey", "isin", "market", "found")


def upcoming_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the 30 days from the first order on."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return factors.upcoming(orders, "day", orders.agg(F.min("day").alias("d")).scalar()).select("o_orderkey", F.col("day").cast("string").alias("day"))


QUERIES = {
    f.__name__: f
    for f in (
        sku_names, cleaned_names, security_codes, identified, registry_candidates, registry_matches, share_pairs, keyword_owners, catalog_best, company_actions, use_cases,
        brand_review_queue, overridden_brands, delivery_checks, line_numbers_quality, review_dates, next_supplier_id, signals_daily, signals_weekly, signals_monthly, tracking_checks,
        alpha_panel, delivery_facts, basic_sales, basic_info, brand_categories, shifted_overlay, event_scores, eight_features, neutral_growth, neutral_change,
        tracking_quality, alpha_scores, supplier_isins, upcoming_orders,
    )
}

_F = """f AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ym, s_name AS company, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, n_name AS nation, n_nationkey,
    p_brand AS brand, p_type AS cat, l_partkey AS sku, l_extendedprice * (1 - l_discount) AS amt, l_quantity AS qty
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey)"""
#: suppliers with their ISIN by Luhn's rule over the digits of KR7, the code and 00
_I = """d AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, '20277' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '00' AS digits FROM supplier),
    e AS (SELECT k, code, list_sum([CAST(digits[13 - i] AS INTEGER) * (2 - i % 2) - CASE WHEN CAST(digits[13 - i] AS INTEGER) * (2 - i % 2) > 9 THEN 9 ELSE 0 END FOR i IN range(13)]) AS s FROM d),
    i AS (SELECT k, code, CAST((10 - s % 10) % 10 AS INTEGER) AS c, 'KR7' || code || '00' AS body FROM e)"""

#: monthly rows with growth over twelve rows, the row before, and the lists of the last three and six
_X = _F + """, g AS (SELECT code, nation, ym, sum(amt) AS s, count(*) AS tx, sum(amt) / count(*) AS atv FROM f GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ym) AS j FROM g),
    y AS (SELECT a.*, 100 * (a.s / nullif(b.s, 0) - 1) AS yoy, 100 * (a.tx / nullif(b.tx, 0) - 1) AS ty, 100 * (a.atv / nullif(b.atv, 0) - 1) AS ay FROM o a LEFT JOIN o b ON b.code = a.code AND b.j = a.j - 12),
    x AS (SELECT *, list(yoy) OVER (w ROWS 2 PRECEDING) AS last3, list(yoy) OVER (w ROWS 5 PRECEDING) AS last6, lag(yoy) OVER w AS y1 FROM y WINDOW w AS (PARTITION BY code ORDER BY ym))"""


def _signals_sql(days: str, period: str, most: int, short: int) -> str:
    corr = lambda a, b: f"CASE WHEN count(*) >= 2 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"
    return f"""WITH {_F}, n AS (SELECT nation AS key, day, sum(amt) AS s, sum(amt) / nullif(sum(qty), 0) AS p, sum(qty) AS v FROM f GROUP BY ALL), {days},
        g AS (SELECT key, {period} AS t, sum(s) AS s, arg_max(p, day) AS p, sum(v) AS v FROM d GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS j FROM g),
        c AS (SELECT b.key, b.t, 100 * (b.s / nullif(a.s, 0) - 1) AS x, 100 * (b.p / nullif(a.p, 0) - 1) AS y, 100 * (b.v / nullif(a.v, 0) - 1) AS z FROM o b JOIN o a ON a.key = b.key AND a.j = b.j - 1),
        m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS j FROM c WHERE x IS NOT NULL AND y IS NOT NULL),
        l AS (SELECT a.key, b.j - a.j AS lag, round({corr('a.x', 'b.y')}, 4) AS corr, round(100 * avg(CASE WHEN sign(a.x) = sign(b.y) THEN 1.0::DOUBLE ELSE 0 END), 1) AS hit_rate, count(*) AS sample
              FROM m a JOIN m b ON a.key = b.key AND b.j BETWEEN a.j AND a.j + {most} GROUP BY ALL),
        best AS (SELECT * FROM l WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(corr) DESC, lag) = 1),
        r AS (SELECT b.key, b.j, {corr('a.x', 'a.y')} AS r FROM m b JOIN m a ON a.key = b.key AND a.j BETWEEN b.j - {short - 1} AND b.j WHERE b.j >= {short} GROUP BY ALL),
        q AS (SELECT key, round(100 * avg(CASE WHEN r > 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FILTER (r IS NOT NULL), 1) AS persistence, CASE WHEN stddev_samp(r) > 0 THEN round(1 / (1 + stddev_samp(r)), 3) WHEN count(r) > 0 THEN 1 END AS stability FROM r GROUP BY key),
        u AS (SELECT key, count(*) AS n, round((SELECT {corr('h.x', 'h.z')} FROM m h WHERE h.key = m.key AND h.z IS NOT NULL), 3) AS volume_corr, count(*) FILTER (z > 50) AS spikes FROM m GROUP BY key HAVING count(*) >= 4),
        w AS (SELECT u.key, n, lag, corr, hit_rate, sample, persistence, stability, volume_corr, spikes, round(least(100, 35 * abs(corr) + greatest(0, (hit_rate - 50) / 2) + coalesce(persistence / 5, 10) + least(10, 20 * abs(coalesce(volume_corr, 0))) + 10 * coalesce(nullif(stability, 0), 0.5)), 1) AS score
              FROM u JOIN best USING (key) LEFT JOIN q USING (key))
        SELECT *, CASE WHEN score >= 70 THEN 'A' WHEN score >= 50 THEN 'B' WHEN score >= 30 THEN 'C' ELSE 'D' END AS grade, CASE WHEN abs(corr) >= 0.5 THEN 'strong' WHEN abs(corr) >= 0.3 THEN 'middle' ELSE 'weak' END AS strength FROM w"""


ORACLE = {
    "sku_names": """SELECT p_partkey, [4, 6, 1, 1, 10][j] AS pack_count, j IN (1, 2, 5) AS is_multipack, ['65', '355', '1.8', '', '2'][j] AS size_value, ['g', 'ml', 'L', '', 'L'][j] AS size_unit,
        CASE WHEN p_partkey % 7 = 0 THEN 'Can' ELSE ['Cup', 'Small Can', 'Bag', 'Unknown', 'Big Bowl'][j] END AS package_form, p_brand AS family, CASE WHEN j = 4 THEN '매운맛' ELSE '' END AS variant, round(p_retailprice / nullif(p_size, 0), 0) AS asp
        FROM (SELECT *, p_partkey % 5 + 1 AS j FROM part)""",
    "cleaned_names": """SELECT p_partkey, ['신라면 큰컵 매운맛 4-Pack 행사', '할인 특가 불닭 볶음면 5-Pack', '한국 a b'][j] AS clean, ['행사', '할인,특가', ''][j] AS tags,
        ['신라면_큰컵(매운맛) 4P', '불닭/볶음면 5개입', '한국 a-b'][j] AS plain, ['Sinramyeon_keunkeob(maeunmas) 4p Haengsa', 'Halin Teugga Buldalg/bokkeummyeon 5gaeib', 'Hangug A-b'][j] AS latin FROM (SELECT *, p_partkey % 3 + 1 AS j FROM part)""",
    "security_codes": f"WITH {_I} SELECT k AS s_suppkey, k % 2 = 0 AS valid, body || c AS isin FROM i",
    "identified": """SELECT s_suppkey, CASE WHEN j < 9 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS code, ['ticker', 'ric', 'isin', 'isin_fixed', 'corp', 'code', 'name', 'spelling', 'words', NULL][j + 1] AS how,
        [1, 1, 1, 0.85, 1, 1, 0.97, 0.95, 0.883, NULL][j + 1]::DOUBLE AS score FROM (SELECT s_suppkey, s_suppkey % 10 AS j FROM supplier)""",
    "registry_candidates": """WITH k AS (SELECT s_suppkey, 'supply' || s_suppkey AS n FROM supplier),
        p AS (SELECT a.s_suppkey AS q, a.n AS qn, b.s_suppkey AS r, a.n = b.n AS same FROM k a JOIN k b ON contains(a.n, b.n) OR contains(b.n, a.n))
        SELECT 'SUPPLY-' || q AS name, CASE WHEN bool_or(same) THEN 'exact' ELSE 'partial' END AS status, count(*) AS n, lpad(CAST(arg_min(r, (r % 2, -(r % 5), r)) AS VARCHAR), 6, '0') AS code FROM p GROUP BY q""",
    "registry_matches": """WITH k AS (SELECT s_suppkey AS k, 'supply' || s_suppkey AS n, s_suppkey % 4 = 0 AND s_suppkey % 3 = 0 AS anchored, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey || 'zz' ELSE 'supply' || s_suppkey END AS q FROM supplier)
        SELECT k AS s_suppkey, CASE WHEN anchored OR q = n THEN lpad(CAST(k AS VARCHAR), 6, '0') END AS code, CASE WHEN anchored THEN 'anchor' WHEN q = n THEN 'exact' ELSE 'none' END AS how FROM k""",
    "share_pairs": """WITH p AS (SELECT s_suppkey AS c, s_suppkey + 5 AS p FROM supplier WHERE s_suppkey % 10 = 0) SELECT lpad(CAST(c AS VARCHAR), 6, '0') AS code, 'preferred_of' AS relation, lpad(CAST(p AS VARCHAR), 6, '0') AS other FROM p
        UNION ALL SELECT lpad(CAST(p AS VARCHAR), 6, '0'), 'common_of', lpad(CAST(c AS VARCHAR), 6, '0') FROM p WHERE p IN (SELECT s_suppkey FROM supplier)""",
    "keyword_owners": """SELECT s_name AS word, s_name AS company FROM supplier UNION ALL
        SELECT b, (SELECT max(s_name) FROM supplier WHERE 'Brand#' || (s_suppkey % 40) = b) FROM (SELECT DISTINCT p_brand AS b FROM part)""",
    "catalog_best": """SELECT s_name AS company, round((0.5::DOUBLE * s_acctbal / 10000 + 0.2::DOUBLE * least(1, greatest(0, ((s_suppkey % 50) / 100 - 0.15::DOUBLE + 0.1::DOUBLE) / 0.4::DOUBLE)) + 0.15::DOUBLE * least(1, greatest(0, (s_suppkey % 100 - 40) / 30))) / 0.85::DOUBLE, 6) AS quality
        FROM supplier ORDER BY quality DESC, company LIMIT 20""",
    "company_actions": """WITH s AS (SELECT s_name AS company, s_suppkey AS k, ['ramen', 'holding', 'dairy', 'meat'][s_suppkey % 4 + 1] AS segment, s_suppkey % 3 > 0 AS listed FROM supplier),
        p AS (SELECT *, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * (k % 7 - 3) / 3 END AS t, CASE WHEN k % 3 = 0 THEN least(1, ln(1 + k * 37 % 600) / ln(501)) END AS n, CASE WHEN k % 5 = 0 THEN least(1, (k % 6) / 4) END AS m,
              CASE WHEN k % 4 = 1 THEN least(1, (k % 11) / 10) END AS d, CASE WHEN k % 8 = 1 THEN least(1, abs((k % 9 - 4) / 4)) END AS r FROM s),
        h AS (SELECT *, list_avg([t, n, m]) AS heat, list_avg([d, r]) AS opp, list_filter([CASE WHEN t IS NOT NULL THEN 'trend' END, CASE WHEN n IS NOT NULL THEN 'news' END, CASE WHEN m IS NOT NULL THEN 'newprod' END, CASE WHEN d IS NOT NULL THEN 'consensus' END], lambda x: x IS NOT NULL) AS st FROM p)
        SELECT company, round(heat, 6) AS heat, round(opp, 6) AS opportunity, CASE WHEN heat IS NOT NULL THEN round(CASE WHEN opp IS NULL THEN heat ELSE 0.65::DOUBLE * heat + 0.35::DOUBLE * opp END, 3) END AS priority, CASE WHEN len(st) = 0 THEN 'none' ELSE array_to_string(st, ',') END AS status,
        CASE WHEN heat IS NULL THEN 'collect data' WHEN heat >= 0.6::DOUBLE AND NOT listed THEN 'watch unlisted' WHEN heat >= 0.6::DOUBLE AND segment IN ('ramen', 'dairy') THEN 'deep dive' WHEN heat >= 0.6::DOUBLE THEN 'brand tracker' WHEN opp >= 0.6::DOUBLE THEN 'consensus gap' ELSE 'keep' END AS action,
        CASE WHEN list_contains(st, 'trend') AND (list_contains(st, 'consensus') OR list_contains(st, 'news')) THEN 'high' WHEN len(st) > 0 THEN 'medium' ELSE 'low' END AS confidence FROM h""",
    "use_cases": f"""WITH {_F}, p AS (SELECT company, brand, code, ym, sum(amt) AS amt, sum(qty) AS qty FROM f GROUP BY ALL), m AS (SELECT ym, row_number() OVER (ORDER BY ym DESC) AS j FROM (SELECT DISTINCT ym FROM p)),
        b AS (SELECT company, brand, code, sum(amt) FILTER (j <= 12) AS a1, sum(amt) FILTER (j BETWEEN 13 AND 24) AS a0, sum(qty) FILTER (j <= 12) AS q1, sum(qty) FILTER (j BETWEEN 13 AND 24) AS q0 FROM p JOIN m USING (ym) WHERE (SELECT count(*) FROM m) >= 24 GROUP BY ALL),
        g AS (SELECT *, 100 * (a1 / a0 - 1) AS v FROM b WHERE a1 > 0 AND a0 > 0), ga AS (SELECT *, row_number() OVER (ORDER BY v DESC, company, brand) AS up, row_number() OVER (ORDER BY v, company DESC, brand DESC) AS dn FROM g),
        c AS (SELECT *, 100 * (a1 / q1 / (a0 / q0) - 1) AS v FROM b WHERE a1 > 0 AND q1 > 0 AND q0 > 0),
        s AS (SELECT sku, max(code) FILTER (sku % 2 = 0) AS code, year(min(day)) * 12 + month(min(day)) AS m0, year(max(day)) * 12 + month(max(day)) AS m1, sum(amt) AS amt FROM f GROUP BY sku),
        n AS (SELECT *, amt / greatest((SELECT max(m1) FROM s) - m0, 1) AS v FROM s WHERE (SELECT max(m1) FROM s) - m0 <= 80),
        y AS (SELECT company, code, ym // 100 AS y, sum(amt) AS amt FROM p GROUP BY ALL), yy AS (SELECT min(y) AS y0, max(y) AS y1 FROM (SELECT ym // 100 AS y FROM m GROUP BY 1 HAVING count(*) >= 12)),
        h AS (SELECT company, code, y, 100 * amt / sum(amt) OVER (PARTITION BY y) AS s FROM y), x AS (SELECT a.company, a.code, a.s - coalesce(b.s, 0) AS v FROM h a JOIN yy ON a.y = y1 AND y0 < y1 LEFT JOIN h b ON b.company = a.company AND b.code = a.code AND b.y = y0),
        u AS (SELECT 'momentum' AS usecase, brand AS entity, code, round(v, 1) AS value, a1 >= (SELECT median(a1) FROM g) AS sure FROM ga WHERE up <= 6 OR dn <= 3
              UNION ALL SELECT 'new_hit', CAST(sku AS VARCHAR), code, round(v, 0), true FROM (FROM n ORDER BY v DESC, sku LIMIT 6)
              UNION ALL SELECT 'share_shift', company, code, round(v, 1), true FROM (FROM x ORDER BY abs(v) DESC, company LIMIT 6)
              UNION ALL SELECT 'price', brand, code, round(v, 1), a1 >= (SELECT median(a1) FROM c) FROM (FROM c ORDER BY abs(v) DESC, company, brand LIMIT 6)),
        w AS (SELECT usecase, entity, code, value, CASE WHEN value >= 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN coalesce(code, '') = '' THEN 'low' WHEN sure THEN 'high' ELSE 'medium' END AS confidence FROM u)
        SELECT *, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, abs(value) DESC, usecase, entity, code NULLS FIRST) AS rank FROM w""",
    "brand_review_queue": f"""WITH {_F}, b AS (SELECT company, brand, sum(amt) AS sales FROM f GROUP BY ALL), t AS (SELECT sum(sales) AS x FROM b)
        SELECT company, brand, round(sales, 4) AS sales, round(100 * sales / x, 2) AS sales_pct, round(100 * sum(sales) OVER w / x, 2) AS cum_pct, row_number() OVER w AS place FROM b, t WHERE brand NOT LIKE '%1' WINDOW w AS (ORDER BY sales DESC, company, brand ROWS UNBOUNDED PRECEDING)""",
    "overridden_brands": "SELECT p_partkey, p_brand, CASE WHEN right(p_brand, 1) IN ('2', '3') THEN p_name ELSE upper(p_brand) END AS shown, CASE WHEN right(p_brand, 1) IN ('2', '3') THEN 'low' ELSE 'high' END AS confidence FROM part",
    "delivery_checks": """WITH p AS (SELECT *, count(*) OVER () AS n_all, sum(p_retailprice) OVER () AS x_all FROM part),
        c AS (SELECT 'blank name' AS "check", count(*) FILTER (p_size <= 1 OR p_name IS NULL) AS n, sum(p_retailprice) FILTER (p_size <= 1 OR p_name IS NULL) * 100 / max(x_all) AS share, 'error' AS bad, 'ok' AS good FROM p
              UNION ALL SELECT 'blank p_brand', count(*) FILTER (p_brand IS NULL), sum(p_retailprice) FILTER (p_brand IS NULL) * 100 / max(x_all), 'error', 'ok' FROM p
              UNION ALL SELECT 'to review', count(*) FILTER (p_size <= 10), sum(p_retailprice) FILTER (p_size <= 10) * 100 / max(x_all), 'warning', 'ok' FROM p
              UNION ALL SELECT 'repeated key', count(*) - count(DISTINCT p_partkey % 1900), 0, 'warning', 'ok' FROM p
              UNION ALL SELECT 'price range', count(*) FILTER (l_extendedprice / l_quantity < 1000 OR l_extendedprice / l_quantity > 4000), 100.0 * count(*) FILTER (l_extendedprice / l_quantity < 1000 OR l_extendedprice / l_quantity > 4000) / count(*), 'warning', 'ok' FROM lineitem),
        r AS (SELECT "check", CASE WHEN n > 0 THEN bad ELSE good END AS severity, n, round(coalesce(share, 0), 2) AS share FROM c
              UNION ALL SELECT 'mapped share', CASE WHEN 100 * sum(p_retailprice) FILTER (p_size > 10) / sum(p_retailprice) < 80 THEN 'warning' ELSE 'info' END, count(*) FILTER (p_size > 10), round(100 * sum(p_retailprice) FILTER (p_size > 10) / sum(p_retailprice), 2) FROM part
              UNION ALL SELECT 'amount not positive', CASE WHEN 100.0 * count(*) FILTER (l_linenumber <= 1) / count(*) > 1 THEN 'warning' ELSE 'info' END, count(*) FILTER (l_linenumber <= 1), round(100.0 * count(*) FILTER (l_linenumber <= 1) / count(*), 2) FROM lineitem)
        FROM r UNION ALL SELECT 'overall', CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END, 0, 0 FROM r""",
    "line_numbers_quality": """WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax', 'l_returnflag']) AS "column", unnest([l_quantity, l_extendedprice, nullif(l_tax - 0.02::DOUBLE, 0), NULL]) AS x FROM lineitem),
        q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY ALL)
        SELECT "column", count(*) AS n_total, count(*) - count(x) AS n_null, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outlier,
        round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max FROM l JOIN q USING ("column") GROUP BY ALL""",
    "review_dates": "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS VARCHAR) AS next_review FROM orders",
    "next_supplier_id": "SELECT 'Supplier#' || lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), 9, '0') AS id FROM supplier",
    "signals_daily": _signals_sql("d AS (SELECT 'all' AS key, day, sum(s) AS s, avg(p) AS p, sum(v) AS v FROM n GROUP BY ALL)", "day", 90, 30),
    "signals_weekly": _signals_sql("d AS (FROM n)", "date_trunc('week', day)", 52, 8),
    "signals_monthly": _signals_sql("d AS (FROM n)", "date_trunc('month', day)", 24, 6),
    "tracking_checks": f"""WITH {_F}, s AS (SELECT nation, year(day) * 10 + quarter(day) AS q, sum(amt) AS s FROM f GROUP BY ALL),
        d AS (SELECT n_name AS nation, year(o_orderdate) * 10 + quarter(o_orderdate) AS q, sum(o_totalprice * CASE n_nationkey % 5 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 1.5::DOUBLE END) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        t AS (SELECT nation, s, d, round(100 * s / nullif(d, 0), 1) AS t FROM s JOIN d USING (nation, q)),
        g AS (SELECT nation, avg(t) AS mean, max(t) AS most, CASE WHEN count(t) > 2 THEN stddev_samp(t) END AS std, count(t) AS n, count(*) FILTER (t > 100) AS above, count(*) FILTER (t > 200 OR t < 0) AS extreme, avg(s) / avg(d) AS u FROM t GROUP BY nation),
        w AS (SELECT *, array_to_string(list_filter([CASE WHEN u > 10 THEN 'unit' END, CASE WHEN mean > 100 THEN 'scope' END, CASE WHEN extreme > 0 OR std > 40 THEN 'quarters' END, CASE WHEN above * 2 > n AND mean > 80 THEN 'double' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g)
        SELECT nation, round(mean, 4) AS mean, round(most, 4) AS most, round(std, 4) AS std, n, above, extreme, CASE WHEN u > 10 OR mean > 150 THEN 'critical' WHEN mean > 100 OR extreme > 0 OR std > 40 THEN 'warning' WHEN reasons <> '' THEN 'caution' ELSE 'ok' END AS severity, reasons FROM w""",
    "alpha_panel": f"""WITH {_F}, k AS (SELECT code, sku, ym, any_value(cat) AS cat, sum(amt) AS amt, sum(qty) AS qty FROM f GROUP BY code, sku, ym), a AS (SELECT *, make_date(ym // 100, ym % 100, 1) AS mo FROM k),
        b AS (SELECT *, mo < (min(mo) OVER (PARTITION BY sku)) + INTERVAL 12 MONTH AS new FROM a),
        g AS (SELECT code, ym, CAST(mo AS DATE) AS mo, sum(amt) AS sales, sum(qty) AS quantity, coalesce(sum(amt) FILTER (new), 0) AS nw, coalesce(sum(amt) FILTER (cat = 'PROMO'), 0) AS tr FROM b GROUP BY ALL),
        h AS (SELECT *, round(100 * sales / sum(sales) OVER (PARTITION BY ym), 4) AS share, round(sales / quantity, 1) AS asp, round(100 * nw / sales, 2) AS newproduct_share, round(100 * tr / sales, 2) AS trend_share,
              CASE WHEN row_number() OVER w >= 3 THEN sum(sales) OVER (w ROWS 2 PRECEDING) END AS s3 FROM g WINDOW w AS (PARTITION BY code ORDER BY mo))
        SELECT h.code, h.ym, CAST(last_day(h.mo) + 15 AS VARCHAR) AS available_date, round(h.sales, 4) AS sales, h.quantity, h.share, h.asp, h.newproduct_share, h.trend_share, round(100 * round(h.sales / y.sales - 1, 4), 4) + 0 AS sales_yoy, round(100 * round(h.sales / m.sales - 1, 4), 4) + 0 AS sales_mom,
        round(100 * round(h.s3 / q.s3 - 1, 4), 4) + 0 AS sales_3m, round(100 * round(h.asp / y.asp - 1, 4), 4) + 0 AS asp_yoy, round(100 * round(h.asp / m.asp - 1, 4), 4) + 0 AS asp_mom, round(h.share - m.share, 4) + 0 AS share_mom, round(h.share - y.share, 4) + 0 AS share_yoy, round(h.trend_share - y.trend_share, 2) + 0 AS trend_share_yoy
        FROM h LEFT JOIN h y ON y.code = h.code AND y.mo = h.mo - INTERVAL 1 YEAR LEFT JOIN h m ON m.code = h.code AND m.mo = h.mo - INTERVAL 1 MONTH LEFT JOIN h q ON q.code = h.code AND q.mo = h.mo - INTERVAL 3 MONTH""",
    "delivery_facts": f"""WITH {_F}, g AS (SELECT CASE grouping(sku) + grouping(brand) WHEN 0 THEN 'sku' WHEN 1 THEN 'brand' ELSE 'company' END AS tier, company, brand, sku, ym, ym // 100 * 12 + ym % 100 AS mn, sum(amt) AS sales, sum(qty) AS quantity
            FROM f GROUP BY GROUPING SETS ((company, brand, sku, ym), (company, brand, ym), (company, ym))),
        h AS (SELECT *, max(sales) OVER (PARTITION BY tier, company, brand, sku ORDER BY mn RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS y, max(sales) OVER (PARTITION BY tier, company, brand, sku ORDER BY mn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS m FROM g)
        SELECT tier, company, brand, sku, ym, CAST(last_day(make_date(ym // 100, ym % 100, 1)) + 15 AS VARCHAR) AS available_date, quantity, round(sales, 4) AS sales, round(100 * (sales / nullif(y, 0) - 1), 4) + 0 AS yoy, round(100 * (sales / nullif(m, 0) - 1), 4) + 0 AS mom FROM h""",
    "basic_sales": f"WITH {_F} SELECT CAST(day AS VARCHAR) AS day, company, company || '_' || brand AS brand, 'all' AS channel, round(sum(amt), 4) AS amount, sum(qty) AS quantity, count(*) AS lines, '' AS people FROM f GROUP BY ALL",
    "basic_info": f"WITH {_F} SELECT DISTINCT company, company || '_' || brand AS brand FROM f WHERE brand <> 'Brand#1' UNION SELECT company, company || '_Total' FROM f",
    "brand_categories": f"WITH {_F}, c AS (SELECT company, brand, cat, count(*) AS n FROM f GROUP BY ALL) SELECT company, brand, cat AS category, n FROM c QUALIFY row_number() OVER (PARTITION BY company, brand ORDER BY n DESC, cat) = 1",
    "shifted_overlay": f"""WITH {_F}, p AS (SELECT company AS key, ym, sum(amt) AS s, sum(amt) / nullif(sum(qty), 0) AS p FROM f GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ym) AS j FROM p)
        SELECT a.key, a.ym, round(100 * b.s / z.s, 4) AS sales, round(100 * a.p / z.p, 4) AS price FROM o a JOIN o z ON z.key = a.key AND z.j = 1 LEFT JOIN o b ON b.key = a.key AND b.j = a.j - 3""",
    "event_scores": "SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY user_id",
    "eight_features": f"""WITH {_X} SELECT code, ym, round(yoy, 4) + 0 AS yoy, round(yoy - y1, 4) + 0 AS delta, round(CASE WHEN list_count(last3) >= 2 THEN list_avg(last3) END, 4) + 0 AS smooth3,
        round(CASE WHEN list_count(last6) >= 3 THEN (yoy - list_avg(last6)) / nullif(list_stddev_samp(last6), 0) END, 4) + 0 AS z6, round(ty, 4) + 0 AS tx_yoy, round(ln(atv), 4) + 0 AS atv, round(ay, 4) + 0 AS atv_yoy, round(yoy - ty, 4) + 0 AS price_effect FROM x""",
    "neutral_growth": f"""WITH {_X}, p AS (SELECT code, ym, tx AS cap, CASE WHEN nation <> 'NATION_3' THEN nation END AS sector, sign(yoy) * ln(1 + abs(yoy)) AS v FROM x),
        w AS (SELECT p.*, CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END AS u FROM p JOIN (SELECT ym, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY ym) USING (ym)),
        z AS (SELECT *, CASE WHEN sector IS NOT NULL THEN (u - avg(u) OVER g) / nullif(stddev_samp(u) OVER g, 0) END AS z FROM w WINDOW g AS (PARTITION BY ym, sector)),
        r AS (SELECT *, CASE WHEN z IS NOT NULL THEN ((SELECT count(*) FROM z b WHERE b.ym = z.ym AND b.sector = z.sector AND b.z < z.z) + (SELECT count(*) + 1 FROM z b WHERE b.ym = z.ym AND b.sector = z.sector AND b.z = z.z) / 2) / (count(z.z) OVER (PARTITION BY ym, sector)) END AS r FROM z),
        e AS (SELECT ym, min(cap) AS lo, list_distinct([quantile_cont(cap, 0.2), quantile_cont(cap, 0.4), quantile_cont(cap, 0.6), quantile_cont(cap, 0.8)]) AS e FROM p GROUP BY ym),
        q AS (SELECT r.*, len(list_filter(e, lambda b: b > lo AND cap > b)) AS q FROM r JOIN e USING (ym))
        SELECT code, ym, round(CASE WHEN sector IS NOT NULL THEN r - avg(r) OVER (PARTITION BY ym, sector, q) END, 6) + 0 AS factor FROM q""",
    "neutral_change": f"""WITH {_X}, p AS (SELECT code, ym, nation, yoy - y1 AS v FROM x),
        w AS (SELECT p.*, CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END AS u FROM p JOIN (SELECT ym, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY ym) USING (ym))
        SELECT code, ym, round((u - avg(u) OVER g) / nullif(stddev_samp(u) OVER g, 0), 6) + 0 AS factor FROM w WINDOW g AS (PARTITION BY ym, nation)""",
    "tracking_quality": f"""WITH {_F}, s AS (SELECT nation, year(day) * 10 + quarter(day) AS q, sum(amt) AS s FROM f GROUP BY ALL),
        d AS (SELECT n_name AS nation, year(o_orderdate) * 10 + quarter(o_orderdate) AS q, sum(o_totalprice) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        j AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY q) AS j FROM s JOIN d USING (nation, q)), c AS (SELECT b.nation, b.s / nullif(a.s, 0) - 1 AS a, b.d / nullif(a.d, 0) - 1 AS b FROM j b JOIN j a ON a.nation = b.nation AND a.j = b.j - 1),
        g AS (SELECT nation, count(*) AS n, 100 * avg(CASE WHEN sign(a) = sign(b) THEN 1.0::DOUBLE ELSE 0 END) AS m, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) ELSE 0 END AS r FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY nation),
        v AS (SELECT nation, count(*) AS k, CASE WHEN count(*) >= 2 AND avg(s / d) > 0 THEN 1 / (1 + stddev_samp(s / d) / avg(s / d)) ELSE 0 END AS st FROM j GROUP BY nation)
        SELECT nation, n, round(m, 1) AS match, round(r, 3) AS corr, round(st, 3) AS stability, round(0.5::DOUBLE * m + 30 * abs(r) + 20 * st, 1) AS quality FROM g JOIN v USING (nation) WHERE k >= 4 AND n >= 3""",
    "alpha_scores": """WITH k AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT k, CASE WHEN k % 5 > 0 THEN least(1, greatest(0, (k % 61 * 0.977::DOUBLE - 5) / 50)) END AS m, CASE WHEN k % 3 > 0 THEN least(1, greatest(0, (k % 83 * 0.977::DOUBLE - 10) / 60)) ELSE 0 END AS y,
            CASE WHEN k % 7 > 0 THEN least(1, greatest(0, (k % 97 * 0.977::DOUBLE - 20) / 60)) END AS d, CASE WHEN k % 4 > 0 THEN least(1, (k % 15 * 0.977::DOUBLE) / CASE WHEN k % 2 > 0 THEN greatest(1, k % 12) ELSE 12 END) END AS a, CASE WHEN k % 6 > 0 THEN least(10, greatest(0, ((k % 11) / 10 - 0.5::DOUBLE) * 20)) ELSE 0 END AS b FROM k)
        SELECT k AS s_suppkey, round(coalesce(round(40 * m + 40 * y, 1), 0) + coalesce(round(35 * d, 1), 0) + coalesce(round((1 - a) * 25, 1), 0) + round(b, 1), 1) AS points, [0.5, 0.65, 0.82, 1][(m IS NOT NULL)::INT + (d IS NOT NULL)::INT + (a IS NOT NULL)::INT + 1]::DOUBLE AS sure FROM p""",
    "supplier_isins": f"""WITH {_I} SELECT k AS s_suppkey, CASE WHEN k % 5 > 0 AND k % 3 > 0 AND k % 2 = 0 THEN body || c END AS isin, CASE WHEN k % 5 > 0 AND k % 3 > 0 AND k % 2 = 0 THEN 'main' END AS market,
        CASE WHEN k % 5 = 0 THEN 'no match' WHEN k % 3 = 0 THEN 'unlisted' WHEN k % 2 = 0 THEN 'exchange' ELSE 'not on exchange' END AS found FROM i""",
    "upcoming_orders": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS DATE) <= (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) + 30",
}
