"""Growth, rolling windows and decompositions along a company's periods."""

_MONTHLY = "m AS (SELECT company, ym, MONTHNO(ym) AS mn, sum(amt) AS amt, sum(qty) AS qty, count(*) AS tx FROM {f} GROUP BY company, ym)"

PLANS = {
    # the flagship: month over month and its acceleration
    "growth_monthly": f"""
        WITH {_MONTHLY}, g AS (SELECT company, ym, amt, 100 * (amt / nullif(lag(amt) OVER (PARTITION BY company ORDER BY ym), 0) - 1) AS mom FROM m)
        SELECT company, ym, round(amt, 4) AS amt, round(mom, 4) AS mom, round(mom - lag(mom) OVER (PARTITION BY company ORDER BY ym), 4) AS accel FROM g""",
    "growth_weekly": """
        WITH w AS (SELECT company, WEEKEND(dt) AS wk, sum(amt) AS amt FROM {f} GROUP BY company, WEEKEND(dt)),
             g AS (SELECT company, wk, amt, 100 * (amt / nullif(lag(amt) OVER (PARTITION BY company ORDER BY wk), 0) - 1) AS wow FROM w)
        SELECT company, TEXT(wk) AS wk, round(amt, 4) AS amt, round(wow, 4) AS wow, round(wow - lag(wow) OVER (PARTITION BY company ORDER BY wk), 4) AS accel FROM g""",
    "moving_average_daily": """
        WITH d AS (SELECT company, dt, sum(amt) AS amt FROM {f} GROUP BY company, dt)
        SELECT company, TEXT(dt) AS dt, round(amt, 4) AS amt, round(avg(amt) OVER (PARTITION BY company ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7 FROM d""",
    # by calendar: the value of the same month a year before, whether or not rows are missing between
    "yoy_by_calendar": f"""
        WITH {_MONTHLY}
        SELECT a.company, a.ym, round(a.amt, 4) AS amt, round(100 * (a.amt / nullif(y.amt, 0) - 1), 4) AS yoy, round(100 * (a.amt / nullif(p.amt, 0) - 1), 4) AS mom
        FROM m a LEFT JOIN m y ON a.company = y.company AND a.mn - 12 = y.mn LEFT JOIN m p ON a.company = p.company AND a.mn - 1 = p.mn""",
    "pct_change_12_rows": f"""
        WITH {_MONTHLY} SELECT company, ym, round(100 * (amt / nullif(lag(amt, 12) OVER (PARTITION BY company ORDER BY ym), 0) - 1), 4) AS pct FROM m""",
    # a missing value repeats the last one before growth is taken
    "pct_change_padded": f"""
        WITH {_MONTHLY}, n AS (SELECT company, ym, CASE WHEN ym % 5 = 0 THEN NULL ELSE amt END AS x FROM m),
             p AS (SELECT company, ym, x, LASTSEEN(x, PARTITION BY company ORDER BY ym) AS v FROM n)
        SELECT company, ym, round(x, 2) AS x, round(v / nullif(lag(v) OVER (PARTITION BY company ORDER BY ym), 0) - 1, 6) AS pct FROM p""",
    "momentum": f"""
        WITH {_MONTHLY}, a AS (SELECT company, ym, avg(amt) OVER (PARTITION BY company ORDER BY ym ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3 FROM m)
        SELECT company, ym, round(m3, 4) AS m3, round(m3 - lag(m3) OVER (PARTITION BY company ORDER BY ym), 4) AS momentum FROM a""",
    "rolling_z": f"""
        WITH {_MONTHLY} SELECT company, ym, round(CASE WHEN count(amt) OVER w >= 3 THEN (amt - avg(amt) OVER w) / nullif(stddev_samp(amt) OVER w, 0) END, 4) AS z
        FROM m WINDOW w AS (PARTITION BY company ORDER BY ym ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "rolling_iqr_mask": f"""
        WITH {_MONTHLY}, q AS (SELECT company, ym, amt, count(amt) OVER w AS n, PCTL(amt, 0.25) OVER w AS q1, PCTL(amt, 0.75) OVER w AS q3
            FROM m WINDOW w AS (PARTITION BY company ORDER BY ym ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
        SELECT company, ym, n >= 3 AND (amt < q1 - 1.5 * (q3 - q1) OR amt > q3 + 1.5 * (q3 - q1)) AS outlier FROM q""",
    "rolling_sum_full": f"""
        WITH {_MONTHLY} SELECT company, ym, round(CASE WHEN count(amt) OVER w = 12 THEN sum(amt) OVER w END, 4) AS ttm
        FROM m WINDOW w AS (PARTITION BY company ORDER BY ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "anomaly_events": f"""
        WITH {_MONTHLY}, z AS (SELECT company, ym, amt, count(*) OVER (PARTITION BY company) AS n, CASE WHEN count(amt) OVER w >= 3 THEN (amt - avg(amt) OVER w) / nullif(stddev_samp(amt) OVER w, 0) END AS z
            FROM m WINDOW w AS (PARTITION BY company ORDER BY ym ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
        SELECT company, ym, round(amt, 4) AS amt, round(z, 4) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind,
               CASE WHEN abs(z) >= 5 THEN 'critical' WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity
        FROM z WHERE n >= 3 AND abs(z) >= :threshold""",
    "global_anomaly": f"""
        WITH {_MONTHLY}, g AS (SELECT company, ym, amt, (amt - avg(amt) OVER (PARTITION BY company)) / nullif(stddev_samp(amt) OVER (PARTITION BY company), 0) AS z FROM m)
        SELECT company, ym, round(z, 4) AS z, CASE WHEN z > 2 THEN 'high' WHEN z < -2 THEN 'low' ELSE 'normal' END AS label FROM g WHERE abs(z) > 2""",
    # change of sales = volume + price + mix
    "demand_decomposition": f"""
        WITH {_MONTHLY}, l AS (SELECT company, ym, amt, tx, amt / nullif(tx, 0) AS atv, lag(amt) OVER w AS amt0, lag(tx) OVER w AS tx0 FROM m WINDOW w AS (PARTITION BY company ORDER BY ym)),
             e AS (SELECT *, amt0 / nullif(tx0, 0) AS atv0 FROM l WHERE tx0 IS NOT NULL),
             x AS (SELECT company, ym, amt - amt0 AS total, atv0 * (tx - tx0) AS vol, tx0 * (atv - atv0) AS price, (tx - tx0) * (atv - atv0) AS mix FROM e)
        SELECT company, ym, round(total, 6) + 0 AS total, round(vol, 6) + 0 AS vol, round(price, 6) + 0 AS price, round(mix, 6) + 0 AS mix,
               CASE WHEN abs(vol) >= 0.6 * (abs(vol) + abs(price) + abs(mix)) THEN 'volume' WHEN abs(price) >= 0.6 * (abs(vol) + abs(price) + abs(mix)) THEN 'price' ELSE 'mixed' END AS driver FROM x""",
    "derived_metrics": f"""
        WITH {_MONTHLY} SELECT company, ym, round(amt / nullif(tx, 0), 4) AS atv, round(amt / nullif(qty, 0), 4) AS asp, round(qty / nullif(tx, 0), 4) AS per_tx FROM m""",
    "trailing_yoy": """
        WITH e AS (SELECT max(dt) AS hi FROM {f}),
             s AS (SELECT company, sum(CASE WHEN DAYS(hi, dt) < 365 THEN amt END) AS recent, sum(CASE WHEN DAYS(hi, dt) >= 365 AND DAYS(hi, dt) < 730 THEN amt END) AS prior FROM {f} CROSS JOIN e GROUP BY company)
        SELECT company, round(recent, 4) AS recent, round(prior, 4) AS prior, round(100 * (recent - prior) / nullif(abs(prior), 0), 4) AS yoy FROM s WHERE recent IS NOT NULL AND prior IS NOT NULL""",
    "ttm_momentum": f"""
        WITH {_MONTHLY}, k AS (SELECT ym, row_number() OVER (ORDER BY ym DESC) AS r FROM (SELECT DISTINCT ym FROM m) d),
             s AS (SELECT m.company, sum(CASE WHEN r <= 12 THEN amt END) AS ttm, sum(CASE WHEN r > 12 AND r <= 24 THEN amt END) AS prior FROM m JOIN k ON m.ym = k.ym GROUP BY m.company)
        SELECT company, round(ttm, 4) AS ttm, round(prior, 4) AS prior, round(100 * (ttm / nullif(prior, 0) - 1), 4) AS chg FROM s""",
    "share_shift": """
        WITH y AS (SELECT company, YEARNO(ym) AS yr, sum(amt) AS amt FROM {f} GROUP BY company, YEARNO(ym)),
             k AS (SELECT YEARNO(ym) AS yr FROM {f} GROUP BY YEARNO(ym) HAVING count(DISTINCT ym) = 12), e AS (SELECT min(yr) AS lo, max(yr) AS hi FROM k),
             s AS (SELECT company, yr, 100 * amt / nullif(sum(amt) OVER (PARTITION BY yr), 0) AS share FROM y)
        SELECT company, round(max(CASE WHEN yr = lo THEN share END), 4) AS first_share, round(max(CASE WHEN yr = hi THEN share END), 4) AS last_share,
               round(max(CASE WHEN yr = hi THEN share END) - max(CASE WHEN yr = lo THEN share END), 4) AS shift FROM s CROSS JOIN e GROUP BY company""",
    "drawdown": f"""
        WITH {_MONTHLY}, r AS (SELECT company, ym, mn, amt / nullif(lag(amt) OVER (PARTITION BY company ORDER BY ym), 0) - 1 AS ret FROM m),
             c AS (SELECT company, ym, sum(ret) OVER (PARTITION BY company ORDER BY ym ROWS UNBOUNDED PRECEDING) AS cum FROM r WHERE ret IS NOT NULL)
        SELECT company, ym, round(cum, 4) AS cum, round(cum - max(cum) OVER (PARTITION BY company ORDER BY ym ROWS UNBOUNDED PRECEDING), 4) AS drawdown FROM c""",
    "rebase_100": f"""
        WITH {_MONTHLY} SELECT company, ym, round(100 * amt / nullif(first_value(amt) OVER (PARTITION BY company ORDER BY ym ROWS UNBOUNDED PRECEDING), 0), 4) AS idx FROM m""",
    "rsi": """
        WITH d AS (SELECT dt, avg(amt) AS x FROM {f} GROUP BY dt), c AS (SELECT dt, x, x - lag(x) OVER (ORDER BY dt) AS ch FROM d),
             g AS (SELECT dt, count(ch) OVER w AS n, avg(CASE WHEN ch > 0 THEN ch WHEN ch IS NOT NULL THEN 0 END) OVER w AS up, avg(CASE WHEN ch < 0 THEN -ch WHEN ch IS NOT NULL THEN 0 END) OVER w AS down
                   FROM c WINDOW w AS (ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
        SELECT TEXT(dt) AS dt, round(CASE WHEN n < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi FROM g""",
    "indicator_snapshot": """
        WITH d AS (SELECT dt, avg(amt) AS x FROM {f} GROUP BY dt)
        SELECT TEXT(dt) AS dt, round(x, 2) AS last, round(CASE WHEN count(x) OVER a = 5 THEN avg(x) OVER a END, 2) AS ma5, round(CASE WHEN count(x) OVER b = 20 THEN avg(x) OVER b END, 2) AS ma20,
               round(CASE WHEN count(x) OVER c = 60 THEN avg(x) OVER c END, 2) AS ma60, round(100 * (x / nullif(lag(x, 20) OVER (ORDER BY dt), 0) - 1), 4) AS pct20
        FROM d WINDOW a AS (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "new_product_share": f"""
        WITH s AS (SELECT company, sku, ym, MONTHNO(ym) AS mn, sum(amt) AS amt FROM {{f}} GROUP BY company, sku, ym),
             n AS (SELECT company, ym, amt, mn - min(mn) OVER (PARTITION BY sku) AS age FROM s)
        SELECT company, ym, round(100 * sum(CASE WHEN age < 12 THEN amt ELSE 0 END) / nullif(sum(amt), 0), 4) AS new_share FROM n GROUP BY company, ym""",
    "first_business_day": """
        WITH d AS (SELECT DISTINCT dt, ym FROM {f} WHERE DOW(dt) NOT IN (0, 6)), l AS (SELECT dt, ym, lag(ym) OVER (ORDER BY dt) AS before FROM d)
        SELECT TEXT(dt) AS dt, ym FROM l WHERE before IS NULL OR before <> ym""",
    "quarterly_growth": """
        WITH q AS (SELECT company, QUARTERNO(ym) AS q, sum(amt) AS amt, count(DISTINCT ym) AS months FROM {f} GROUP BY company, QUARTERNO(ym))
        SELECT a.company, a.q, round(a.amt, 2) AS amt, round(100 * (a.amt / nullif(b.amt, 0) - 1), 4) AS qoq, round(100 * (a.amt / nullif(c.amt, 0) - 1), 4) AS yoy
        FROM q a LEFT JOIN q b ON a.company = b.company AND a.q - 1 = b.q LEFT JOIN q c ON a.company = c.company AND a.q - 4 = c.q WHERE a.months = 3""",
    # half-year and year totals back to single quarters; a quarter without its predecessor is dropped
    "standalone_quarters": """
        WITH q AS (SELECT company, YEARNO(ym) AS yr, CAST(ceil((ym % 100) / 3.0) AS INT) AS qn, sum(amt) AS amt FROM {f} GROUP BY company, YEARNO(ym), CAST(ceil((ym % 100) / 3.0) AS INT)),
             c AS (SELECT company, yr, qn, sum(amt) OVER (PARTITION BY company, yr ORDER BY qn) AS ytd FROM q),
             l AS (SELECT company, yr, qn, ytd, lag(ytd) OVER w AS before, lag(qn) OVER w AS qb FROM c WINDOW w AS (PARTITION BY company, yr ORDER BY qn))
        SELECT company, yr, qn, round(ytd, 4) AS ytd, round(CASE WHEN qn = 1 THEN ytd ELSE ytd - before END, 4) AS standalone FROM l WHERE qn = 1 OR qb = qn - 1""",
}
