"""Expected results of plans in DuckDB's own terms (dates, lists, as-of joins), written from the definitions and apart from
the plans' text. Where a plan is listed here, it is compared with this instead of with its own rendering."""

_T = """t AS (SELECT s_name AS company, n_name AS sector, p_brand AS brand, p_type AS cat, l_partkey AS sku, CAST(l_suppkey AS VARCHAR) AS supp, CAST(l_shipdate AS DATE) AS dt,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS mo, l_extendedprice * (1 - l_discount) AS amt, l_quantity AS qty
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN part ON p_partkey = l_partkey)"""
_M = _T + ", m AS (SELECT company, mo, sum(amt) AS amt, sum(qty) AS qty, count(*) AS tx FROM t GROUP BY company, mo)"
#: each month with the row before it
_P = _M + ", p AS (SELECT a.*, b.amt AS amt0, b.tx AS tx0, b.mo AS mo0 FROM m a ASOF LEFT JOIN m b ON a.company = b.company AND a.mo > b.mo)"
#: each month with the list of its company's values up to it
_L = _M + ", l AS (SELECT company, mo, amt, list(amt) OVER (PARTITION BY company ORDER BY mo) AS a FROM m)"
_YM = "CAST(strftime(mo, '%Y%m') AS INTEGER) AS ym"

ORACLES = {
    "growth_monthly": f"""WITH {_P}, g AS (SELECT company, mo, amt, (amt - amt0) * 100 / nullif(amt0, 0) AS mom FROM p)
        SELECT a.company, CAST(strftime(a.mo, '%Y%m') AS INTEGER) AS ym, round(a.amt, 4) AS amt, round(a.mom, 4) AS mom, round(a.mom - b.mom, 4) AS accel FROM g a ASOF LEFT JOIN g b ON a.company = b.company AND a.mo > b.mo""",
    "yoy_by_calendar": f"""WITH {_M} SELECT company, {_YM}, round(amt, 4) AS amt,
        round(100 * (amt / nullif((SELECT y.amt FROM m y WHERE y.company = m.company AND y.mo = m.mo - INTERVAL 1 YEAR), 0) - 1), 4) AS yoy,
        round(100 * (amt / nullif((SELECT y.amt FROM m y WHERE y.company = m.company AND y.mo = m.mo - INTERVAL 1 MONTH), 0) - 1), 4) AS mom FROM m""",
    "pct_change_12_rows": f"WITH {_L} SELECT company, {_YM}, CASE WHEN len(a) > 12 THEN round(100 * (amt / nullif(a[len(a) - 12], 0) - 1), 4) END AS pct FROM l",
    "momentum": f"WITH {_L}, x AS (SELECT company, mo, a, list_avg(a[-3:]) AS m3, CASE WHEN len(a) > 1 THEN list_avg(a[greatest(1, len(a) - 3):len(a) - 1]) END AS before FROM l) SELECT company, {_YM}, round(m3, 4) AS m3, round(m3 - before, 4) AS momentum FROM x",
    "rolling_z": f"WITH {_L}, x AS (SELECT company, mo, amt, a[-6:] AS w FROM l) SELECT company, {_YM}, CASE WHEN len(w) >= 3 THEN round((amt - list_avg(w)) / nullif(list_aggregate(w, 'stddev_samp'), 0), 4) END AS z FROM x",
    "rolling_sum_full": f"WITH {_L} SELECT company, {_YM}, CASE WHEN len(a) >= 12 THEN round(list_sum(a[-12:]), 4) END AS ttm FROM l",
    "rebase_100": f"WITH {_L} SELECT company, {_YM}, round(100 * amt / nullif(a[1], 0), 4) AS idx FROM l",
    "moving_average_daily": f"WITH {_T}, d AS (SELECT company, dt, sum(amt) AS amt FROM t GROUP BY ALL), l AS (SELECT company, dt, amt, list(amt) OVER (PARTITION BY company ORDER BY dt) AS a FROM d) SELECT company, CAST(dt AS VARCHAR) AS dt, round(amt, 4) AS amt, round(list_avg(a[-7:]), 6) AS ma7 FROM l",
    "weekly_rollup": f"WITH {_T} SELECT CAST(dt + CAST(7 - isodow(dt) AS INTEGER) AS VARCHAR) AS week_end, company, round(sum(amt), 4) AS amt, count(*) AS n_tx FROM t GROUP BY ALL",
    "demand_decomposition": f"""WITH {_P}, e AS (SELECT company, mo, amt - amt0 AS total, amt0 / tx0 * (tx - tx0) AS vol, tx0 * (amt / tx - amt0 / tx0) AS price, (tx - tx0) * (amt / tx - amt0 / tx0) AS mix FROM p WHERE tx0 IS NOT NULL)
        SELECT company, {_YM}, round(total, 6) + 0 AS total, round(vol, 6) + 0 AS vol, round(price, 6) + 0 AS price, round(mix, 6) + 0 AS mix,
        CASE WHEN abs(vol) / (abs(vol) + abs(price) + abs(mix)) >= 0.6 THEN 'volume' WHEN abs(price) / (abs(vol) + abs(price) + abs(mix)) >= 0.6 THEN 'price' ELSE 'mixed' END AS driver FROM e""",
    "trailing_yoy": f"""WITH {_T}, s AS (SELECT company, sum(amt) FILTER (dt > hi - 365) AS recent, sum(amt) FILTER (dt <= hi - 365 AND dt > hi - 730) AS prior FROM t, (SELECT max(dt) AS hi FROM t) GROUP BY company)
        SELECT company, round(recent, 4) AS recent, round(prior, 4) AS prior, round(100 * (recent - prior) / nullif(abs(prior), 0), 4) AS yoy FROM s WHERE recent IS NOT NULL AND prior IS NOT NULL""",
    "ttm_momentum": f"""WITH {_M}, k AS (SELECT list_reverse_sort(list_distinct(list(mo))) AS months FROM m), s AS (SELECT company, sum(amt) FILTER (list_contains(months[1:12], mo)) AS ttm, sum(amt) FILTER (list_contains(months[13:24], mo)) AS prior FROM m, k GROUP BY company)
        SELECT company, round(ttm, 4) AS ttm, round(prior, 4) AS prior, round(100 * (ttm / nullif(prior, 0) - 1), 4) AS chg FROM s""",
    "global_anomaly": f"""WITH {_M}, s AS (SELECT company, avg(amt) AS a, stddev_samp(amt) AS d FROM m GROUP BY company), z AS (SELECT company, mo, (amt - a) / nullif(d, 0) AS z FROM m JOIN s USING (company))
        SELECT company, {_YM}, round(z, 4) AS z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS label FROM z WHERE abs(z) > 2""",
    "standalone_quarters": f"""WITH {_T}, q AS (SELECT company, year(dt) AS yr, quarter(dt) AS qn, sum(amt) AS x FROM t GROUP BY ALL), c AS (SELECT a.company, a.yr, a.qn, a.x, (SELECT sum(b.x) FROM q b WHERE b.company = a.company AND b.yr = a.yr AND b.qn <= a.qn) AS ytd, EXISTS (SELECT 1 FROM q b WHERE b.company = a.company AND b.yr = a.yr AND b.qn = a.qn - 1) AS has FROM q a)
        SELECT company, CAST(yr AS INTEGER) AS yr, CAST(qn AS INTEGER) AS qn, round(ytd, 4) AS ytd, round(x, 4) AS standalone FROM c WHERE qn = 1 OR has""",
    "market_share_monthly": f"""WITH {_M}, s AS (SELECT company, mo, amt, 100 * amt / nullif((SELECT sum(b.amt) FROM m b WHERE b.mo = a.mo), 0) AS share FROM m a),
        r AS (SELECT *, (SELECT count(*) + 1 FROM s b WHERE b.mo = s.mo AND b.amt > s.amt) AS rnk FROM s)
        SELECT r.company, CAST(strftime(r.mo, '%Y%m') AS INTEGER) AS ym, round(r.share, 4) AS share, CAST(rnk AS INTEGER) AS rnk, round(r.share - b.share, 4) AS share_chg FROM r ASOF LEFT JOIN s b ON r.company = b.company AND r.mo > b.mo""",
    "new_product_share": f"""WITH {_T}, f AS (SELECT sku, min(mo) AS born FROM t GROUP BY sku) SELECT company, {_YM}, round(100 * coalesce(sum(amt) FILTER (mo < born + INTERVAL 12 MONTH), 0) / nullif(sum(amt), 0), 4) AS new_share FROM t JOIN f USING (sku) GROUP BY company, mo""",
    "forward_compound": f"""WITH {_T}, p AS (SELECT lpad(supp, 6, '0') AS code, mo, sum(amt) / nullif(sum(qty), 0) AS px FROM t GROUP BY ALL), l AS (SELECT code, list(mo ORDER BY mo) AS mos, list(px ORDER BY mo) AS pxs FROM p GROUP BY code), e AS (SELECT code, mos, pxs, unnest(range(1, len(mos) + 1)) AS i FROM l)
        SELECT code, CAST(strftime(mos[i], '%Y%m') AS INTEGER) AS ym, round(100 * (pxs[i + 4] / nullif(pxs[i + 1], 0) - 1), 4) AS fwd3 FROM e""",
    "score_companies": f"""WITH {_T}, c AS (SELECT company, any_value(sector) AS sector, sum(amt) AS amt, count(*) AS n, count(DISTINCT mo) AS months FROM t GROUP BY company),
        x AS (SELECT c.*, (SELECT count(*) FROM c d WHERE d.sector = c.sector AND (d.amt > c.amt OR d.amt = c.amt AND d.company <= c.company)) AS place FROM c),
        b AS (SELECT min(ln(1 + amt)) AS a0, max(ln(1 + amt)) AS a1, min(ln(1 + n)) AS n0, max(ln(1 + n)) AS n1, max(months) AS m1 FROM c),
        s AS (SELECT company, round(30 * (ln(1 + amt) - a0) / (a1 - a0) + 30 * 0.6 + 20 * (0.7 * months / m1 + 0.3 * (ln(1 + n) - n0) / (n1 - n0)) + 20::DOUBLE / place, 1) AS score FROM x, b)
        SELECT company, CAST(score AS DOUBLE) AS score, CASE WHEN place <= 20 THEN 'core' WHEN place <= 30 THEN 'watch' ELSE 'out' END AS tier FROM (SELECT *, row_number() OVER (ORDER BY score DESC, company) AS place FROM s)""",
    "quintiles": f"""WITH {_M}, y AS (SELECT a.company, a.mo, 100 * (a.amt / nullif(b.amt, 0) - 1) AS yoy, 100 * ((c.amt / nullif(c.qty, 0)) / nullif(a.amt / nullif(a.qty, 0), 0) - 1) AS fwd FROM m a LEFT JOIN m b ON a.company = b.company AND b.mo = a.mo - INTERVAL 1 YEAR LEFT JOIN m c ON a.company = c.company AND c.mo = a.mo + INTERVAL 1 MONTH),
        e AS (SELECT mo, list_distinct(quantile_cont(yoy, [0.2, 0.4, 0.6, 0.8])) AS edges, min(yoy) AS e0 FROM y WHERE yoy IS NOT NULL GROUP BY mo HAVING count(*) >= 5),
        q AS (SELECT mo, 1 + len(list_filter(edges, lambda x: yoy > x AND x > e0)) AS q, fwd FROM y JOIN e USING (mo) WHERE yoy IS NOT NULL)
        SELECT {_YM}, CAST(q AS INTEGER) AS q, count(*) AS n, round(avg(fwd), 4) AS fwd FROM q GROUP BY mo, q""",
}
