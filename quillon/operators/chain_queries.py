"""Queries of the factor research chain, with SQL written apart from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chain
from quillon.operators.market_queries import _X
from quillon.operators.ranks import settled
from quillon.sources.roles import facts, table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suppliers by region: their monthly sales, the mean price of their units by day, that of all orders, and their sectors."""
    lines = facts(spark, sf_dir, {"dt", "code", "amt", "qty"}).repartition("code")  # a code's days stay together, as it is read by code
    f = settled(lines.groupBy("code", "dt").agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty"), F.count("*").alias("tx")).sortWithinPartitions("code", "dt"))
    panel = f.groupBy("code", (F.year("dt") * 100 + F.month("dt")).alias("ym")).agg(F.sum("amt").alias("sales"), F.sum("tx").alias("tx"))
    prices = f.select("code", F.col("dt").alias("day"), (F.col("amt") / F.nullif("qty", F.lit(0.0))).alias("price"))
    index = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    sectors = s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("n_regionkey").alias("sector"))
    return panel, prices, index, sectors


def _chain(spark: SparkSession, sf_dir: str, features: Sequence[str] = chain.FEATURES, horizons: dict[str, int] = chain.HORIZONS, kinds: Sequence[str] = chain.KINDS) -> tuple[DataFrame, DataFrame]:
    """Signals of monthly sales, and returns of the price against that of all orders; those that are read."""
    panel, prices, index, sectors = _tables(spark, sf_dir)
    found = settled(chain.signals(panel, prices, sectors, features))
    return found, settled(chain.targets(prices, index, sectors, found.select("day"), horizons, kinds))


def factor_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, prices, index, sectors = _tables(spark, sf_dir)
    found = chain.wide_signals(panel, prices, sectors).drop("sector")
    out = chain.wide_lag_decay(chain.wide_targets(prices, index, sectors, found.select("day"), found=found))
    return out.select("feature", "kind", "horizon", "n", *(F.round(c, 4).alias(c) for c in ("ic", "sd", "icir", "t", "hit")))


def _backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest reads one feature and one target, so only these go through the chain."""
    return chain.backtest(*_chain(spark, sf_dir, ("yoy",), {"1m": chain.HORIZONS["1m"]}, ("sector_rel",)), "yoy", "sector_rel", "1m")


def factor_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _backtest(spark, sf_dir)
    return out.select("ym", "n", *((F.round(c, 4) + 0).alias(c) for c in ("low", "high", "ls", "turnover", "net")))


def factor_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chain.performance(_backtest(spark, sf_dir))
    return out.select("n", *((F.round(c, 4) + 0).alias(c) for c in out.columns[1:]))


QUERIES = {f.__name__: f for f in (factor_decay, factor_backtest, factor_performance)}

_H = "unnest([{h: '1m', n: 21}, {h: '3m', n: 63}, {h: '6m', n: 126}])"
#: v: scaled signals; gl: returns of all kinds
_V = _X + f""", pr AS (SELECT code, n_nationkey, day, sum(amt) / nullif(sum(qty), 0) AS p FROM f GROUP BY ALL), sc AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, n_regionkey AS sector FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
    sg AS (SELECT *, last_day(make_date(ym // 100, ym % 100, 1)) AS e FROM x), sd AS (SELECT *, CAST(e + CASE dayofweek(e) WHEN 6 THEN 6 WHEN 0 THEN 5 ELSE 7 END AS DATE) AS sd FROM sg),
    ht AS (SELECT sd.* EXCLUDE (nation), pr.day FROM sd ASOF JOIN pr ON sd.code = pr.code AND sd.sd <= pr.day WHERE pr.day - sd.sd <= 10),
    lg AS (SELECT code, ym, day, unnest([{{k: 'yoy', v: yoy}}, {{k: 'delta', v: yoy - y1}}, {{k: 'smooth3', v: CASE WHEN list_count(last3) >= 2 THEN list_avg(last3) END}}, {{k: 'z6', v: CASE WHEN list_count(last6) >= 3 THEN (yoy - list_avg(last6)) / nullif(list_stddev_samp(last6), 0) END}},
           {{k: 'tx_yoy', v: ty}}, {{k: 'atv', v: atv}}, {{k: 'atv_yoy', v: ay}}, {{k: 'price_effect', v: yoy - ty}}]) AS u FROM ht),
    ln AS (SELECT code, ym, day, u.k AS feature, u.v AS x, sector FROM lg LEFT JOIN sc USING (code)),
    cl AS (SELECT ln.*, least(greatest(x, lo), hi) AS c FROM ln JOIN (SELECT ym, feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM ln GROUP BY ALL) USING (ym, feature) WHERE x IS NOT NULL AND sector IS NOT NULL),
    v AS (SELECT code, ym, day, feature, sector, round((c - avg(c) OVER w) / nullif(stddev_samp(c) OVER w, 0), 9) AS v FROM cl WINDOW w AS (PARTITION BY ym, feature, sector)),
    po AS (SELECT code, day, p, row_number() OVER (PARTITION BY code ORDER BY day) AS j FROM pr), io AS (SELECT day, p, row_number() OVER (ORDER BY day) AS j FROM (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS p FROM orders GROUP BY 1)), hz AS (SELECT s.h, s.n FROM (SELECT {_H} AS s)),
    ra AS (SELECT a.code, a.day, h, sector, 100 * (c.p / nullif(b.p, 0) - 1) AS r FROM po a JOIN hz ON true JOIN po b ON b.code = a.code AND b.j = a.j + 1 JOIN po c ON c.code = a.code AND c.j = a.j + 1 + n LEFT JOIN sc ON sc.code = a.code),
    ix AS (SELECT a.day, h, 100 * (c.p / nullif(b.p, 0) - 1) AS m FROM io a JOIN hz ON true JOIN io b ON b.j = a.j + 1 JOIN io c ON c.j = a.j + 1 + n), md AS (SELECT day, h, sector, median(r) AS md FROM ra WHERE sector IS NOT NULL GROUP BY ALL),
    gw AS (SELECT code, ra.day, ra.h, unnest([{{k: 'raw', v: r}}, {{k: 'excess', v: r - m}}, {{k: 'sector_rel', v: r - md}}]) AS u FROM ra LEFT JOIN ix ON ix.day = ra.day AND ix.h = ra.h LEFT JOIN md ON md.day = ra.day AND md.h = ra.h AND md.sector = ra.sector),
    gl AS (SELECT code, day, h AS horizon, u.k AS kind, round(u.v, 9) AS t FROM gw WHERE u.v IS NOT NULL)"""
_B = _V + """, k AS (SELECT code, ym, sector, v, t FROM v JOIN gl USING (code, day) WHERE feature = 'yoy' AND kind = 'sector_rel' AND horizon = '1m' AND v IS NOT NULL),
    ed AS (SELECT ym, sector, min(v) AS lo, list_distinct([quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8)]) AS e FROM k GROUP BY ALL HAVING count(*) >= 5),
    q AS (SELECT k.*, 1 + len(list_filter(e, lambda b: b > lo AND k.v > b)) AS q, dense_rank() OVER (ORDER BY ym) AS j FROM k JOIN ed USING (ym, sector)),
    mo AS (SELECT a.ym, count(*) AS n, avg(a.t) FILTER (a.q = 1) AS low, avg(a.t) FILTER (a.q = 5) AS high, count(*) FILTER (b.q <> a.q) / (SELECT count(DISTINCT code) FROM q) AS turnover FROM q a LEFT JOIN q b ON b.code = a.code AND b.j = a.j - 1 GROUP BY a.ym),
    bt AS (SELECT *, high - low AS ls, high - low - 0.3::DOUBLE * turnover AS net FROM mo)"""

ORACLE = {
    "factor_decay": f"""WITH {_V}, k AS (SELECT feature, kind, horizon, ym, v AS a, t AS b FROM v JOIN gl USING (code, day) WHERE v IS NOT NULL),
        r AS (SELECT feature, kind, horizon, ym, CAST(2 * rank() OVER (PARTITION BY feature, kind, horizon, ym ORDER BY a) + count(*) OVER (PARTITION BY feature, kind, horizon, ym, a) - 1 AS BIGINT) AS a,
              CAST(2 * rank() OVER (PARTITION BY feature, kind, horizon, ym ORDER BY b) + count(*) OVER (PARTITION BY feature, kind, horizon, ym, b) - 1 AS BIGINT) AS b FROM k),
        m AS (SELECT feature, kind, horizon, ym, CAST(count(*) * sum(a * b) - sum(a) * sum(b) AS DOUBLE) AS ab, CAST(count(*) * sum(a * a) - sum(a) * sum(a) AS DOUBLE) AS aa, CAST(count(*) * sum(b * b) - sum(b) * sum(b) AS DOUBLE) AS bb FROM r GROUP BY ALL HAVING count(*) >= 5),
        i AS (SELECT *, ab / sqrt(aa * bb) AS ic FROM m WHERE aa > 0 AND bb > 0), s AS (SELECT feature, kind, horizon, count(*) AS n, avg(ic) AS ic, coalesce(stddev_samp(ic), 0) AS sd, avg((ic > 0)::INT) AS hit FROM i GROUP BY ALL)
        SELECT feature, kind, horizon, n, round(ic, 4) AS ic, round(sd, 4) AS sd, CASE WHEN sd > 1e-9::DOUBLE THEN round(ic / sd, 4) ELSE 0 END AS icir, CASE WHEN sd > 1e-9::DOUBLE THEN round(ic / (sd / sqrt(n)), 4) ELSE 0 END AS t, round(hit, 4) AS hit FROM s""",
    "factor_backtest": f"WITH {_B} SELECT ym, n, " + ", ".join(f"round({c}, 4) + 0 AS {c}" for c in ("low", "high", "ls", "turnover", "net")) + " FROM bt",
    "factor_performance": f"""WITH {_B}, c AS (SELECT *, sum(ls) OVER (ORDER BY ym) AS cum FROM bt), d AS (SELECT *, CASE WHEN ls IS NOT NULL THEN cum - max(cum) OVER (ORDER BY ym) END AS dd FROM c)
        SELECT count(ls) AS n, round(coalesce(sqrt(12) * avg(ls) / nullif(stddev_samp(ls), 0), 0), 4) + 0 AS sharpe, round(coalesce(sqrt(12) * avg(net) / nullif(stddev_samp(net), 0), 0), 4) + 0 AS sharpe_net, round(12 * avg(ls), 4) + 0 AS annual,
               round(avg((ls > 0)::INT), 4) + 0 AS hit, round(avg(turnover), 4) + 0 AS turnover, round(coalesce(min(dd), 0), 4) + 0 AS max_drawdown FROM d""",
}
