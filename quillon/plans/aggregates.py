"""Profiles, panels, rankings, shares and coverage."""

PLANS = {
    # one pass over the table: volume, span, cardinalities, how much of the amount has a company
    "profile_stats": """
        SELECT count(*) AS n_rows, min(ym) AS first_ym, max(ym) AS last_ym, count(DISTINCT company) AS n_companies,
               count(DISTINCT brand) AS n_brands, count(DISTINCT sku) AS n_skus, count(DISTINCT cat1) AS n_cat1, count(DISTINCT ym) AS n_months,
               round(sum(amt), 4) AS amt, round(sum(CASE WHEN company IS NOT NULL THEN amt END), 2) AS mapped_amt, round(sum(qty), 2) AS qty
        FROM {f}""",
    "category_options": "SELECT cat1, count(DISTINCT sku) AS n_skus, round(sum(amt), 4) AS amt FROM {f} GROUP BY cat1",
    "distinct_skus": """
        SELECT company, brand, cat1, sku, count(*) AS n_rows, min(ym) AS first_ym, round(sum(amt), 4) AS amt
        FROM {f} GROUP BY company, brand, cat1, sku""",
    "monthly_panel": """
        SELECT ym, company, brand, round(sum(amt), 4) AS amt, round(sum(qty), 2) AS qty, count(*) AS n_tx,
               round(sum(amt) / nullif(sum(qty), 0), 4) AS asp FROM {f} GROUP BY ym, company, brand""",
    "sku_monthly": "SELECT ym, sku, company, round(sum(amt), 4) AS amt, round(sum(qty), 2) AS qty, count(*) AS n_tx FROM {f} GROUP BY ym, sku, company",
    "daily_panel": """
        SELECT ym * 100 + day(dt) AS ymd, company, cat1, round(sum(amt), 4) AS amt, round(sum(qty), 2) AS qty, count(*) AS n_tx
        FROM {f} GROUP BY ym * 100 + day(dt), company, cat1""",
    "annual_company": "SELECT YEARNO(ym) AS yr, company, round(sum(amt), 4) AS amt, count(DISTINCT ym) AS n_months FROM {f} GROUP BY YEARNO(ym), company",
    "annual_brand": "SELECT YEARNO(ym) AS yr, company, brand, round(sum(amt), 4) AS amt FROM {f} GROUP BY YEARNO(ym), company, brand",
    "category_category_filter": "SELECT ym, company, round(sum(amt), 4) AS amt FROM {f} WHERE cat1 = :category OR cat1 LIKE :pattern GROUP BY ym, company",
    # without an entity, periods without sales are there with 0
    "daily_total_filled": """
        WITH d AS (SELECT dt, sum(amt) AS amt FROM {f} GROUP BY dt),
             e AS (SELECT min(dt) AS lo, max(dt) AS hi FROM d), s AS (SELECT DATES(lo, hi) AS dt FROM e)
        SELECT TEXT(s.dt) AS dt, round(coalesce(d.amt, 0), 2) AS amt FROM s LEFT JOIN d ON s.dt = d.dt""",
    "weekly_rollup": "SELECT TEXT(WEEKEND(dt)) AS week_end, company, round(sum(amt), 4) AS amt, count(*) AS n_tx FROM {f} GROUP BY WEEKEND(dt), company",
    # a price proxy per company and day, then open / high / low / close per month
    "ohlc_resample": """
        WITH d AS (SELECT company, dt, ym, avg(amt / nullif(qty, 0)) AS px, sum(qty) AS vol FROM {f} GROUP BY company, dt, ym)
        SELECT company, ym, round(ARGMIN(px, dt), 6) AS open, round(max(px), 6) AS high, round(min(px), 6) AS low, round(ARGMAX(px, dt), 6) AS close,
               round(sum(vol), 2) AS volume FROM d GROUP BY company, ym""",
    "month_end_close": """
        WITH d AS (SELECT company, dt, ym, avg(amt / nullif(qty, 0)) AS px FROM {f} GROUP BY company, dt, ym),
             m AS (SELECT company, ym, ARGMAX(px, dt) AS close FROM d GROUP BY company, ym)
        SELECT company, ym, round(close, 6) AS close, round((close / nullif(lag(close) OVER (PARTITION BY company ORDER BY ym), 0) - 1) * 100, 6) AS ret FROM m""",
    "quarter_end_close": """
        WITH d AS (SELECT company, dt, QUARTERNO(ym) AS q, avg(amt / nullif(qty, 0)) AS px FROM {f} GROUP BY company, dt, QUARTERNO(ym))
        SELECT company, q, round(ARGMAX(px, dt), 6) AS close FROM d GROUP BY company, q""",
    "mode_name": "SELECT company, MODE(brand) AS brand, MODE(cat1) AS cat1 FROM {f} GROUP BY company",
    # share rounded first, concentration from the rounded share; ties share a rank
    "brand_share_hhi": """
        WITH b AS (SELECT brand, sum(amt) AS amt FROM {f} GROUP BY brand),
             s AS (SELECT brand, amt, round(100 * amt / nullif(sum(amt) OVER (), 0), 2) AS share FROM b)
        SELECT brand, round(amt, 4) AS amt, share, CAST(rank() OVER (ORDER BY amt DESC) AS INT) AS rnk, round(sum(share * share) OVER (), 2) AS hhi FROM s""",
    "sku_pareto": """
        WITH s AS (SELECT sku, sum(amt) AS amt FROM {f} GROUP BY sku),
             r AS (SELECT sku, amt, row_number() OVER (ORDER BY amt DESC, sku) AS pos, sum(amt) OVER (ORDER BY amt DESC, sku ROWS UNBOUNDED PRECEDING) AS run, sum(amt) OVER () AS total FROM s)
        SELECT count(*) AS n_skus, count(CASE WHEN run - amt < 0.8 * total THEN 1 END) AS n_to_80, round(max(100 * amt / nullif(total, 0)), 4) AS top_share FROM r""",
    "category_hierarchy": """
        WITH g AS (SELECT cat1, brand, sum(amt) AS amt, CAST(grouping(cat1) * 2 + grouping(brand) AS INT) AS lvl FROM {f} GROUP BY GROUPING SETS ((cat1, brand), (cat1), ()))
        SELECT cat1, brand, lvl, round(amt, 4) AS amt, round(100 * amt / nullif(max(CASE WHEN lvl = 1 THEN amt END) OVER (PARTITION BY cat1), 0), 4) AS share_of_parent FROM g""",
    "category_hhi_monthly": """
        WITH c AS (SELECT cat1, ym, company, sum(amt) AS amt FROM {f} GROUP BY cat1, ym, company),
             s AS (SELECT *, amt / nullif(sum(amt) OVER (PARTITION BY cat1, ym), 0) AS share FROM c)
        SELECT cat1, ym, round(sum(share * share) * 10000, 2) AS hhi, count(DISTINCT company) AS n_companies, round(max(share) * 100, 4) AS top_share, ARGMAX(company, amt) AS top_company
        FROM s GROUP BY cat1, ym""",
    "brand_share_in_company": """
        WITH b AS (SELECT company, brand, ym, sum(amt) AS amt FROM {f} GROUP BY company, brand, ym)
        SELECT company, brand, ym, round(100 * amt / nullif(sum(amt) OVER (PARTITION BY company, ym), 0), 4) AS share FROM b""",
    "market_share_monthly": """
        WITH c AS (SELECT ym, company, sum(amt) AS amt FROM {f} GROUP BY ym, company),
             s AS (SELECT ym, company, 100 * amt / nullif(sum(amt) OVER (PARTITION BY ym), 0) AS share, CAST(rank() OVER (PARTITION BY ym ORDER BY amt DESC) AS INT) AS rnk FROM c)
        SELECT ym, company, round(share, 4) AS share, rnk, round(share - lag(share) OVER (PARTITION BY company ORDER BY ym), 4) AS share_chg FROM s""",
    # a company's three largest brands by name, the rest as one row, and the company itself
    "layout_rollup": """
        WITH b AS (SELECT company, brand, sum(amt) AS amt FROM {f} GROUP BY company, brand),
             k AS (SELECT company, amt, CASE WHEN row_number() OVER (PARTITION BY company ORDER BY amt DESC, brand) <= 3 THEN brand ELSE 'other' END AS label FROM b)
        SELECT company, coalesce(label, 'all') AS label, round(sum(amt), 4) AS amt FROM k GROUP BY GROUPING SETS ((company), (company, label))""",
    "top_brands_per_company": """
        WITH b AS (SELECT company, brand, sum(amt) AS amt FROM {f} GROUP BY company, brand),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY amt DESC, brand) AS INT) AS pos FROM b)
        SELECT company, brand, round(amt, 4) AS amt, pos FROM r WHERE pos <= 3""",
    "top_bottom": """
        WITH s AS (SELECT company, sum(amt) AS amt FROM {f} GROUP BY company),
             r AS (SELECT company, amt, CAST(row_number() OVER (ORDER BY amt DESC, company) AS INT) AS best, CAST(row_number() OVER (ORDER BY amt, company DESC) AS INT) AS worst FROM s)
        SELECT company, round(amt, 4) AS amt, best, worst FROM r WHERE best <= 10 OR worst <= 10""",
    "sales_coverage": """
        SELECT cat1, round(100 * sum(CASE WHEN MATCHES(brand, :covered) THEN amt ELSE 0 END) / nullif(sum(amt), 0), 4) AS covered_pct,
               count(DISTINCT CASE WHEN NOT MATCHES(brand, :covered) THEN sku END) AS open_skus FROM {f} GROUP BY cat1""",
    "duplicate_rows": """
        WITH k AS (SELECT company, sku, dt, count(*) AS n FROM {f} GROUP BY company, sku, dt)
        SELECT sum(n) AS n_rows, count(*) AS n_keys, sum(n) - count(*) AS n_duplicates FROM k""",
    "value_counts": "SELECT sector, cat1, count(*) AS n FROM {f} GROUP BY sector, cat1",
    "coefficient_of_variation": """
        WITH m AS (SELECT company, ym, sum(amt) AS amt FROM {f} GROUP BY company, ym)
        SELECT company, count(*) AS n, round(stddev_samp(amt) / nullif(avg(amt), 0), 4) AS cv, round(avg(amt), 2) AS mean FROM m GROUP BY company""",
    "iqr_outliers": """
        WITH q AS (SELECT PCTL(amt, 0.25) AS q1, PCTL(amt, 0.75) AS q3 FROM {f})
        SELECT round(q1, 2) AS q1, round(q3, 2) AS q3, count(CASE WHEN amt < q1 - 1.5 * (q3 - q1) OR amt > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_out
        FROM {f} CROSS JOIN q GROUP BY q1, q3""",
    "medians": "SELECT sector, round(PCTL(amt, 0.5), 2) AS median_amt, round(PCTL(qty, 0.9), 2) AS p90_qty FROM {f} GROUP BY sector",
    "asp_outliers": """
        WITH m AS (SELECT sku, ym, sum(amt) / nullif(sum(qty), 0) AS asp FROM {f} GROUP BY sku, ym)
        SELECT sku, ym, round(asp, 4) AS asp FROM m WHERE asp < :least OR asp > :most""",
    "year_pivot": """
        SELECT company, round(sum(CASE WHEN YEARNO(ym) = 1996 THEN amt END), 2) AS y1996, round(sum(CASE WHEN YEARNO(ym) = 1997 THEN amt END), 2) AS y1997,
               round(sum(CASE WHEN YEARNO(ym) = 1998 THEN amt END), 2) AS y1998 FROM {f} GROUP BY company""",
    # 6 data-quality checks in one pass, a score of 100 less deductions
    "quality_score": """
        WITH s AS (SELECT count(*) AS n, sum(CASE WHEN amt IS NULL THEN 1 ELSE 0 END) AS null_amt, sum(CASE WHEN amt < 0 THEN 1 ELSE 0 END) AS neg_amt, sum(CASE WHEN qty IS NULL OR qty <= 0 THEN 1 ELSE 0 END) AS bad_qty,
               sum(CASE WHEN company IS NULL THEN 1 ELSE 0 END) AS null_company, count(DISTINCT ym) AS months FROM {f})
        SELECT LONG(n) AS n, LONG(null_amt) AS null_amt, LONG(neg_amt) AS neg_amt, LONG(bad_qty) AS bad_qty, months,
               round(greatest(0, 100 - least(30, 100.0 * null_amt / n) - least(20, 100.0 * neg_amt / n) - least(20, 100.0 * bad_qty / n) - CASE WHEN months < 12 THEN 15 ELSE 0 END), 2) AS score FROM s""",
    # scale and rows on a log scale, 0.5 where all are equal; listed companies have a code; rank within the sector
    "score_companies": """
        WITH c AS (SELECT company, max(code) AS code, max(sector) AS sector, ln(1 + sum(coalesce(amt, 0))) AS a, sum(coalesce(amt, 0)) AS amt, ln(1 + count(*)) AS n, count(DISTINCT ym) AS months FROM {f} WHERE company IS NOT NULL GROUP BY company),
             b AS (SELECT min(a) AS a0, max(a) AS a1, min(n) AS n0, max(n) AS n1, greatest(1, max(months)) AS m1 FROM c),
             w AS (SELECT company, amt, coalesce((a - a0) / nullif(a1 - a0, 0), 0.5) AS scale, CASE WHEN code <> '' THEN 0.6 ELSE 0 END AS investable, 0.7 * months / m1 + 0.3 * coalesce((n - n0) / nullif(n1 - n0, 0), 0.5) AS coverage,
                   CASE WHEN coalesce(sector, '') = '' THEN 0.3 ELSE 1.0 / row_number() OVER (PARTITION BY sector ORDER BY amt DESC, company) END AS rep FROM c CROSS JOIN b),
             s AS (SELECT company, round(100 * (0.3 * scale + 0.3 * investable + 0.2 * coverage + 0.2 * rep), 1) AS score FROM w),
             h AS (SELECT company, score FROM s ORDER BY score DESC, company LIMIT 30),
             r AS (SELECT company, row_number() OVER (ORDER BY score DESC, company) AS pos FROM h)
        SELECT s.company, CAST(score AS DOUBLE) AS score, CASE WHEN pos <= 20 THEN 'core' WHEN pos <= 30 THEN 'watch' ELSE 'out' END AS tier FROM s LEFT JOIN r ON s.company = r.company""",
}
