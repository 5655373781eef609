"""Queries of the choice of companies, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import choice, universe
from quillon.sources.roles import facts, table

_REGIONS = ("ramen", "alcohol", "holding", "other", "dairy")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: their nation is the sub-sector, its region the segment; a balance below 0 means unlisted."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey <> 7")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    segment = F.get(F.array(*map(F.lit, _REGIONS)), F.col("n_regionkey").cast("int"))
    return s.select(F.col("s_name").alias("company"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), (F.col("s_acctbal") >= 0).alias("listed"), segment.alias("segment"), F.col("n_name").alias("sub_sector"), "s_acctbal")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = facts(spark, sf_dir, {"code", "sku", "amt"}).where("sku % 2 = 0").groupBy("code").agg((1e9 * F.round(F.round(F.sum("amt"), 4), 2)).alias("cap"))  # four digits first: halves of a cent must not hang on the order of adding
    return choice.score_candidates(_suppliers(spark, sf_dir).drop("s_acctbal"), caps)


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("company", F.round("size", 6).alias("size"), F.round("sector_rep", 6).alias("sector_rep"), "segment_score", "listed_score", "score", "rank")


def selected_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed ones alone; suppliers with a balance of 9,500 or more are pinned out, those of under -900 are pinned in."""
    s = _suppliers(spark, sf_dir)
    pins = s.where("s_acctbal >= 9500 OR s_acctbal < 0").select("company", F.when(F.col("s_acctbal") >= 9500, "excluded").when(F.col("s_acctbal") < -900, "selected").otherwise(" ").alias("status"))
    return choice.select_universe(_scored(spark, sf_dir), listed_only=True, pins=pins).select("company", "rank", "status", "pinned", "reason")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend from the discount, news from lines, new products from the parts sold at high tax, consensus from the balance."""
    s = _suppliers(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    each = lines.groupBy(F.col("s_name").alias("company")).agg((F.sum(F.round(100 * F.col("l_discount"))) / F.count("*") - 5).alias("trend"), F.count("*").alias("news"), F.count_distinct(F.when(F.col("l_tax") > 0.05, F.col("l_partkey"))).alias("products"))
    consensus = s.where("s_acctbal > 5000").select("company", (F.col("s_acctbal") / 10000).alias("dispersion"), F.lit(None).cast("double").alias("revision"))
    return universe.scored_signals(universe.signals_of(s.drop("code"), each.where("trend > 0"), each, each.where("news > 50"), consensus))


def segment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.segment_notes(_signals(spark, sf_dir)).withColumn("heat", F.round("heat", 6))


def recommended_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.recommendation_summary(universe.recommendations(_signals(spark, sf_dir)))


def recommended_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.with_reasons(universe.recommendations(_signals(spark, sf_dir))).select("company", "action", "why")


def trend_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as keywords, the share of their lines with a discount of 0.05 or more as momentum."""
    f = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    trends = f.groupBy(F.col("p_name").alias("keyword")).agg(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)).alias("momentum"))
    return choice.trend_packages(trends, (*choice.SPICY, "red"))


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean order of each nation's customers by day."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = choice.snapshots(o.groupBy(F.col("n_name").alias("key"), F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("value")))
    return out.select("key", F.col("day").cast("string").alias("day"), *(F.round(c, 4).alias(c) for c in out.columns[2:]))


QUERIES = {f.__name__: f for f in (scored_candidates, selected_universe, segment_notes, recommended_summary, recommended_reasons, trend_themes, order_snapshots)}

_C = """c AS (SELECT s_suppkey AS k, s_name AS company, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_acctbal, s_acctbal >= 0 AS listed, n_name AS sub, ['ramen', 'alcohol', 'holding', 'other', 'dairy'][n_regionkey + 1] AS segment
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey <> 7)"""
_S = _C + """, m AS (SELECT l_suppkey AS k, 1e9::DOUBLE * round(sum(l_extendedprice * (1 - l_discount)), 2) AS cap FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL), a AS (SELECT c.*, coalesce(cap, 0)::DOUBLE AS cap, ln(1 + coalesce(cap, 0)) AS lg FROM c LEFT JOIN m USING (k)),
    p AS (SELECT *, coalesce((lg - min(lg) OVER ()) / nullif(max(lg) OVER () - min(lg) OVER (), 0), 0.5::DOUBLE) AS size, CASE WHEN sub IS NULL THEN 0.3::DOUBLE ELSE 1::DOUBLE / row_number() OVER (PARTITION BY sub ORDER BY cap DESC, company) END AS rep,
          CASE segment WHEN 'ramen' THEN 1 WHEN 'alcohol' THEN 0.9::DOUBLE WHEN 'dairy' THEN 0.6::DOUBLE WHEN 'holding' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS seg FROM a),
    s AS (SELECT *, round(100 * (0.4::DOUBLE * size + 0.25::DOUBLE * rep + 0.2::DOUBLE * seg + 0.15::DOUBLE * listed::INT), 1) AS score FROM p), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, company) AS rank FROM s)"""
_H = _C + """, l AS (SELECT l_suppkey AS k, sum(round(100 * l_discount)) / count(*) - 5 AS t, count(*) AS n, count(DISTINCT l_partkey) FILTER (l_tax > 0.05::DOUBLE) AS m FROM lineitem GROUP BY ALL),
    h AS (SELECT c.*, list_avg([CASE WHEN t > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1, t) END, least(1, ln(1 + n) / ln(501)), CASE WHEN n > 50 THEN least(1, m / 4) END]) AS heat, t > 0 AS st, n IS NOT NULL AS sn, s_acctbal > 5000 AS sc FROM c LEFT JOIN l USING (k))"""

ORACLE = {
    "scored_candidates": f"WITH {_S} SELECT company, round(size, 6) AS size, round(rep, 6) AS sector_rep, seg AS segment_score, listed::INT::DOUBLE AS listed_score, score, rank FROM r",
    "selected_universe": f"""WITH {_S}, o AS (SELECT *, CASE WHEN listed THEN row_number() OVER (PARTITION BY listed ORDER BY rank) END <= 20 AS chosen FROM r), w AS (SELECT *, row_number() OVER (PARTITION BY coalesce(chosen, false) ORDER BY rank) AS j FROM o)
        SELECT company, rank, CASE WHEN s_acctbal >= 9500 THEN 'excluded' WHEN s_acctbal < -900 OR chosen THEN 'selected' WHEN j <= 10 THEN 'watch' ELSE 'excluded' END AS status, s_acctbal >= 9500 OR s_acctbal < -900 AS pinned,
               concat_ws(', ', CASE WHEN listed THEN 'listed (' || code || ')' ELSE 'unlisted' END, sub || ' place ' || round(rep, 2), 'segment ' || segment, CASE WHEN cap > 0 THEN 'cap ' || CAST(round(cap / 1e12::DOUBLE, 2) AS DECIMAL(18, 2)) || 'T' END, 'score ' || score) AS reason FROM w""",
    "segment_notes": f"""WITH {_H}, g AS (SELECT segment, avg(heat) AS heat, count(*) AS n, segment IN ('ramen', 'alcohol', 'dairy') AS deep FROM h WHERE segment IS NOT NULL GROUP BY segment)
        SELECT segment, round(heat, 6) AS heat, n, deep, CASE WHEN heat IS NULL THEN 'no signals' WHEN NOT deep THEN 'companies and brands suffice' WHEN heat >= 0.6::DOUBLE THEN 'deep dive first' ELSE 'fit for deep dives' END AS note FROM g""",
    "recommended_summary": f"""WITH {_H}, g AS (SELECT coalesce(st, false) AS st, sn, sc FROM h)
        SELECT count(*) AS n, count(*) FILTER (st OR sn OR sc) AS with_signal, count(*) FILTER (st AND (sn OR sc)) AS high, count(*) FILTER ((st OR sn OR sc) AND NOT (st AND (sn OR sc))) AS medium, count(*) FILTER (NOT (st OR sn OR sc)) AS low,
               concat_ws(',', CASE WHEN bool_or(NOT (st OR sn OR sc)) THEN 'some without signals' END, CASE WHEN NOT bool_or(st) THEN 'no trends' END, CASE WHEN NOT bool_or(sc) THEN 'no consensus' END) AS lacks FROM g""",
    "recommended_reasons": f"""WITH {_H}, g AS (SELECT company, coalesce(segment, 'no segment') AS segment, listed, heat >= 0.6::DOUBLE AS hot, 'heat ' || CAST(round(heat, 2) AS DECIMAL(18, 2)) AS h, CASE WHEN sc THEN s_acctbal / 10000 END AS o FROM h),
        a AS (SELECT *, CASE WHEN o >= 0.6::DOUBLE THEN 'uncertain consensus ' || CAST(round(o, 2) AS DECIMAL(18, 2)) END AS u, CASE WHEN h IS NULL THEN 1 WHEN hot AND NOT listed THEN 4 WHEN hot AND segment IN ('ramen', 'alcohol', 'dairy') THEN 2 WHEN hot THEN 3 WHEN o >= 0.6::DOUBLE THEN 5 ELSE 6 END AS j FROM g)
        SELECT company, ['collect data', 'deep dive', 'brand tracker', 'watch unlisted', 'consensus gap', 'keep'][j] AS action,
               CASE j WHEN 1 THEN 'no outside signals' WHEN 2 THEN concat_ws(', ', h, segment || ' fits deep dives', 'listed', u) WHEN 3 THEN h || ', listed, ' || segment || ' is not for deep dives' WHEN 4 THEN h || ', unlisted' WHEN 5 THEN u ELSE h || ', nothing special' END AS why FROM a""",
    "trend_themes": """WITH k AS (SELECT p_name AS k, avg(CASE WHEN l_discount >= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING m > 0.2::DOUBLE),
        t AS (SELECT 'rising' AS theme, * FROM k UNION ALL SELECT 'spicy', * FROM k WHERE regexp_matches(lower(k), '불닭|매운|마라|spicy|buldak|hot|mala|red')), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY m DESC, k) AS j FROM t)
        SELECT theme, string_agg(k, ', ' ORDER BY j) AS drivers, count(*) AS n FROM r WHERE j <= 5 GROUP BY theme""",
    "order_snapshots": """WITH d AS (SELECT n_name AS key, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        l AS (SELECT key, max(day) AS day, list(x ORDER BY day DESC) AS x FROM d GROUP BY key HAVING count(*) >= 2)
        SELECT key, CAST(day AS VARCHAR) AS day, round(x[1], 4) AS last, round(x[2], 4) AS prev, """
    + ", ".join(f"CASE WHEN len(x) >= {k} THEN round(list_avg(x[1:{k}]), 4) END AS ma{k}" for k in (5, 20, 60, 200))
    + ", "
    + ", ".join(f"round(100 * (x[1] / nullif(x[{k + 1}], 0) - 1), 4) AS pct{k}" for k in (1, 5, 20, 60))
    + " FROM l",
}
