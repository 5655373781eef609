"""Queries of the signal studies, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import market, studies
from quillon.operators.market_queries import _F
from quillon.operators.ranks import settled
from quillon.sources.roles import facts, table


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies: sales of their suppliers by day."""
    f = facts(spark, sf_dir, {"dt", "sector", "amt"})
    return f.groupBy(F.col("sector").alias("company"), F.col("dt").alias("day")).agg(F.sum("amt").alias("sales"), F.count("*").alias("tx"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean order of a nation's customers by day as its price, their number as volume; none for region 3."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("n_nationkey").cast("string").alias("code"), F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("volume"))


def _rows(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("key"))
    prices = _prices(spark, sf_dir).join(nation, "code").drop("code")
    return settled(studies.merged(_sales(spark, sf_dir).withColumnRenamed("company", "key"), prices, freq))


_SCORES = ("freq", "n", "lag", "corr", "hit_rate", "sample", "persistence", "stability", "volume_corr", "spikes", "score", "grade", "strength")


def company_market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 4 have no code."""
    codes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"), F.when(F.col("n_regionkey") < 4, F.col("n_nationkey").cast("string")).otherwise(" ").alias("code"))
    return studies.company_signals(_sales(spark, sf_dir), _prices(spark, sf_dir), codes).select("company", "status", *_SCORES)


def universe_market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales against the mean order of a day."""
    index = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("volume"))
    return studies.universe_signals(_sales(spark, sf_dir), index).select(*_SCORES)


def volume_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.lag_table(_rows(spark, sf_dir, "month"), "tx_growth", "volume_change", market.FREQUENCIES["month"][0])


def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.rolling_pair(_rows(spark, sf_dir, "week"), studies.WINDOWS["week"][0])
    return out.select("key", F.col("period").cast("string").alias("period"), *((F.round(c, 4) + 0).alias(c) for c in ("roll_short", "roll_long")))


def event_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of the greatest growth of sales, and of volume."""
    rows, horizons = _rows(spark, sf_dir, "week"), studies.WINDOWS["week"][1]
    both = [studies.event_study(rows, c, horizons).withColumn("kind", F.lit(c)) for c in ("growth", "volume_change")]
    return both[0].unionByName(both[1]).select("kind", "key", "horizon", "n_events", F.round("threshold", 4).alias("threshold"), "n", F.round("ret", 4).alias("ret"))


QUERIES = {f.__name__: f for f in (company_market_signals, universe_market_signals, volume_lags, rolling_windows, event_studies)}


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"


def _merged_sql(freq: str) -> str:
    """Whole calendars of both series (``n``: sales, ``p``: prices), then the rows where growth and return are known."""
    at = f"CAST(date_trunc('{freq}', day) AS DATE)"
    calendar = lambda of: f"SELECT key, unnest(CAST(range(CAST(min({at}) AS TIMESTAMP), CAST(max({at}) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 {freq}) AS DATE[])) AS t FROM {of} GROUP BY key"
    days = f"r_{freq} AS (SELECT key, day AS t, arg_max(p, day) AS p, sum(v) AS v FROM p GROUP BY ALL)"
    filled = f"k_{freq} AS ({calendar('p')}), r_{freq} AS (SELECT k.key, k.t, arg_max(p, day) AS p, coalesce(sum(v), 0) AS v FROM k_{freq} k LEFT JOIN p ON p.key = k.key AND {at} = k.t GROUP BY ALL)"
    return f"""c_{freq} AS ({calendar('n')}), g_{freq} AS (SELECT c.key, c.t, coalesce(sum(s), 0) AS s, coalesce(sum(x), 0) AS x FROM c_{freq} c LEFT JOIN n ON n.key = c.key AND {at} = c.t GROUP BY ALL),
        x_{freq} AS (SELECT key, t, 100 * (s / nullif(lag(s) OVER w, 0) - 1) AS x, 100 * (x / nullif(lag(x) OVER w, 0) - 1) AS u FROM g_{freq} WINDOW w AS (PARTITION BY key ORDER BY t)),
        {days if freq == 'day' else filled},
        y_{freq} AS (SELECT key, t, p, 100 * (p / last_value(p IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) AS y, 100 * (v / nullif(lag(v) OVER (PARTITION BY key ORDER BY t), 0) - 1) AS z FROM r_{freq}),
        m_{freq} AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS j FROM x_{freq} JOIN y_{freq} USING (key, t) WHERE x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL)"""


def _scores_sql(freq: str, most: int, short: int) -> str:
    return f"""{_merged_sql(freq)},
        l_{freq} AS (SELECT a.key, b.j - a.j AS lag, round({_corr('a.x', 'b.y')}, 4) AS corr, round(100 * avg(CASE WHEN sign(a.x) = sign(b.y) THEN 1.0::DOUBLE ELSE 0 END), 1) AS hit_rate, count(*) AS sample
              FROM m_{freq} a JOIN (SELECT unnest(range({most + 1})) AS d) ON true JOIN m_{freq} b ON a.key = b.key AND b.j = a.j + d GROUP BY ALL),
        b_{freq} AS (SELECT * FROM l_{freq} WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(corr) DESC, lag) = 1),
        o_{freq} AS (SELECT b.key, b.j, {_corr('a.x', 'a.y')} AS r FROM m_{freq} b JOIN (SELECT unnest(range({short})) AS d) ON true JOIN m_{freq} a ON a.key = b.key AND a.j = b.j - d WHERE b.j >= {short} GROUP BY ALL),
        q_{freq} AS (SELECT key, round(100 * avg(CASE WHEN r > 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FILTER (r IS NOT NULL), 1) AS persistence, CASE WHEN stddev_samp(r) > 0 THEN round(1 / (1 + stddev_samp(r)), 3) WHEN count(r) > 0 THEN 1 END AS stability FROM o_{freq} GROUP BY key),
        v_{freq} AS (SELECT key, round({_corr('x', 'z')}, 3) AS volume_corr FROM m_{freq} WHERE z IS NOT NULL GROUP BY key), u_{freq} AS (SELECT key, count(*) AS n, count(*) FILTER (z > 50) AS spikes FROM m_{freq} GROUP BY key HAVING count(*) >= 4),
        w_{freq} AS (SELECT key, '{freq}' AS freq, n, lag, corr, hit_rate, sample, persistence, stability, volume_corr, spikes,
              round(least(100, 35 * abs(corr) + greatest(0, (hit_rate - 50) / 2) + coalesce(persistence / 5, 10) + least(10, 20 * abs(coalesce(volume_corr, 0))) + 10 * coalesce(nullif(stability, 0), 0.5)), 1) AS score
              FROM u_{freq} JOIN b_{freq} USING (key) LEFT JOIN q_{freq} USING (key) LEFT JOIN v_{freq} USING (key))"""


_GRADES = "CASE WHEN score >= 70 THEN 'A' WHEN score >= 50 THEN 'B' WHEN score >= 30 THEN 'C' WHEN score IS NOT NULL THEN 'D' END AS grade, CASE WHEN abs(corr) >= 0.5 THEN 'strong' WHEN abs(corr) >= 0.3 THEN 'middle' WHEN corr IS NOT NULL THEN 'weak' END AS strength"
_ALL = ", ".join(_scores_sql(f, *market.FREQUENCIES[f]) for f in ("week", "month", "day")) + ", w AS (FROM w_week UNION ALL FROM w_month UNION ALL FROM w_day)"
_NATIONS = f"""{_F}, n AS (SELECT nation AS key, day, sum(amt) AS s, count(*) AS x FROM f GROUP BY ALL),
    p AS (SELECT n_name AS key, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS p, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3 GROUP BY ALL)"""

ORACLE = {
    "company_market_signals": f"""WITH {_NATIONS}, {_ALL}, k AS (SELECT n_name AS company, CASE WHEN n_regionkey = 4 THEN 'no code' WHEN n_name NOT IN (SELECT key FROM p) THEN 'no prices' END AS st FROM nation),
        b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE freq WHEN 'week' THEN 0 WHEN 'month' THEN 1 ELSE 2 END) = 1)
        SELECT company, coalesce(st, CASE WHEN freq IS NULL THEN 'insufficient' ELSE 'ok' END) AS status, b.* EXCLUDE (key), {_GRADES} FROM k LEFT JOIN b ON key = company AND st IS NULL""",
    "universe_market_signals": f"""WITH {_F}, n AS (SELECT 'all' AS key, day, sum(amt) AS s, count(*) AS x FROM f GROUP BY ALL), p AS (SELECT 'all' AS key, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS p, count(*) AS v FROM orders GROUP BY ALL), {_ALL}
        SELECT * EXCLUDE (key), {_GRADES} FROM w""",
    "volume_lags": f"""WITH {_NATIONS}, {_merged_sql('month')}, h AS (SELECT key, u, z, row_number() OVER (PARTITION BY key ORDER BY t) AS j, count(*) OVER (PARTITION BY key) AS n FROM m_month WHERE u IS NOT NULL AND z IS NOT NULL),
        l AS (SELECT a.key, CAST(b.j - a.j AS INTEGER) AS lag, round({_corr('a.u', 'b.z')}, 4) AS corr, count(*) AS n FROM h a JOIN h b ON a.key = b.key AND b.j BETWEEN a.j AND a.j + 24 WHERE a.n >= 4 GROUP BY ALL) FROM l WHERE corr IS NOT NULL""",
    "rolling_windows": f"""WITH {_NATIONS}, {_merged_sql('week')}, r AS (SELECT b.key, b.t, b.j, d, a.x, a.y FROM m_week b JOIN (SELECT unnest(range(26)) AS d) ON true JOIN m_week a ON a.key = b.key AND a.j = b.j - d),
        s AS (SELECT key, t, {_corr('x', 'y')} AS c FROM r WHERE j >= 8 AND d < 8 GROUP BY ALL), l AS (SELECT key, t, {_corr('x', 'y')} AS c FROM r WHERE j >= 26 GROUP BY ALL)
        SELECT m.key, CAST(m.t AS VARCHAR) AS period, round(s.c, 4) + 0 AS roll_short, round(l.c, 4) + 0 AS roll_long FROM m_week m LEFT JOIN s USING (key, t) LEFT JOIN l USING (key, t)""",
    "event_studies": f"""WITH {_NATIONS}, {_merged_sql('week')}, a AS (SELECT 'growth' AS kind, key, j, x AS e FROM m_week UNION ALL SELECT 'volume_change', key, j, z FROM m_week),
        h AS (SELECT kind, key, quantile_cont(e, 0.9) AS cut FROM a GROUP BY ALL HAVING count(e) >= 5), i AS (SELECT kind, key, cut, j, unnest([1, 2, 4, 12]) AS horizon FROM a JOIN h USING (kind, key) WHERE e >= cut),
        c AS (SELECT i.kind, i.key, i.cut, i.j, i.horizon, CASE WHEN count(m.y) = i.horizon THEN 100 * (product(1 + m.y / 100) - 1) END AS r FROM i LEFT JOIN m_week m ON m.key = i.key AND m.j BETWEEN i.j + 1 AND i.j + i.horizon GROUP BY i.kind, i.key, i.cut, i.j, i.horizon)
        SELECT kind, key, CAST(horizon AS INTEGER) AS horizon, count(*) AS n_events, round(max(cut), 4) AS threshold, count(r) AS n, round(avg(r), 4) AS ret FROM c GROUP BY kind, key, horizon""",
}
