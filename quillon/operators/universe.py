"""Which companies and products to look at: recommendations from outside signals, use cases, catalog ranks, reviews, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import percentiles, positions, settled

# Segments whose products decide, levels from which heat and opportunity are high, counts at which news and
# new products have their full score.
DEEP_SEGMENTS = ("ramen", "alcohol", "snack", "beverage", "dairy")
HEAT_HIGH = OPPORTUNITY_HIGH = 0.60
PRODUCTS_FULL, NEWS_FULL = 4, 500
# Weight of a catalog column, and the range of it that counts from 0 to 1; value of missing ones.
QUALITY_PARTS = {"signal_score": (0.50, 0.0, 1.0, 0.0), "ic": (0.20, -0.10, 0.30, 0.0), "backtest_sharpe": (0.15, 0.0, 3.0, 0.0), "hit_ratio_pct": (0.15, 40.0, 70.0, 50.0)}


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _mean(*parts: Column) -> Column:
    """Mean of the parts that aren't null; null without any."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.try_divide(total, n)


def signals_of(companies: DataFrame, trends: DataFrame, news: DataFrame, products: DataFrame, consensus: DataFrame) -> DataFrame:
    """``companies`` with trend (mean), news (sum), products, revision and dispersion by company; null where there is none. The
    other tables have ``company`` and ``trend``, ``news``, ``products``, or ``revision, dispersion``."""
    out = companies
    for df, column, how in ((trends, "trend", F.avg), (news, "news", F.sum), (products, "products", F.max)):
        out = out.join(df.where("company IS NOT NULL").groupBy("company").agg(how(column).alias(column)), "company", "left")
    one = consensus.where("company IS NOT NULL").groupBy("company").agg(F.max("revision").alias("revision"), F.max("dispersion").alias("dispersion"))
    return out.join(one, "company", "left")


def scored_signals(df: DataFrame) -> DataFrame:
    """``df`` with heat, opportunity, priority and status from trend, news, products, revision and dispersion, on scales that
    don't depend on the other rows."""
    trend = 0.5 + 0.5 * _clip(F.col("trend"), -1.0, 1.0)
    news = _clip(F.log1p("news") / F.log1p(F.lit(NEWS_FULL)))
    heat = _mean(trend, news, _clip(F.col("products") / PRODUCTS_FULL))
    opportunity = _mean(_clip(F.col("dispersion")), _clip(F.abs("revision")))
    given = lambda name, *columns: F.when(F.coalesce(*columns).isNotNull(), F.lit(name))
    status = F.concat_ws(",", given("trend", "trend"), given("news", "news"), given("newprod", "products"), given("consensus", "dispersion", "revision"))
    df = df.withColumns({"heat": heat, "opportunity": opportunity, "status": F.when(status == "", "none").otherwise(status)})
    return df.withColumn("priority", F.round(F.coalesce(0.65 * F.col("heat") + 0.35 * F.col("opportunity"), F.col("heat")), 3))


def recommendations(scored: DataFrame) -> DataFrame:
    """An action and a confidence for each row of ``scored_signals`` (with ``segment, listed``)."""
    hot, listed = F.col("heat") >= HEAT_HIGH, F.coalesce("listed", F.lit(False))
    action = (
        F.when(F.col("heat").isNull(), "collect data")
        .when(hot & F.coalesce(F.col("segment").isin(*DEEP_SEGMENTS), F.lit(False)) & listed, "deep dive")
        .when(hot & listed, "brand tracker")
        .when(hot, "watch unlisted")
        .when(F.col("opportunity") >= OPPORTUNITY_HIGH, "consensus gap")
        .otherwise("keep")
    )
    parts = F.split("status", ",")
    sure = F.array_contains(parts, "trend") & (F.array_contains(parts, "consensus") | F.array_contains(parts, "news"))
    return scored.withColumns({"action": action, "confidence": F.when(sure, "high").when(F.col("status") != "none", "medium").otherwise("low")})


def catalog_quality(df: DataFrame) -> Column:
    """Quality of catalog rows from the columns that the table has, their weights filled up to 1; 0 without any."""
    given = {c: part for c, part in QUALITY_PARTS.items() if c in df.columns}
    total = sum(weight for weight, *_ in given.values())
    score = F.lit(0.0)
    for c, (weight, low, high, missing) in given.items():
        x = F.coalesce(F.col(c).try_cast("double"), F.lit(missing))
        score = score + weight / total * (x if c == "signal_score" else _clip((x - low) / (high - low)))
    return score


def best_companies(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of best quality."""
    return df.withColumn("quality", catalog_quality(df)).orderBy(F.desc("quality"), "company").limit(n)


def _year_windows(panel: DataFrame) -> DataFrame:
    """``panel`` with ``last`` (the latest twelve months) and ``prior`` (the twelve before), empty where it has under 24 months."""
    months = panel.agg(F.array_sort(F.collect_set("ym")).alias("__m"))  # one row over a calendar
    of = lambda start: F.array_contains(F.slice("__m", start, 12), F.col("ym"))
    return panel.join(F.broadcast(months)).where("size(__m) >= 24").withColumns({"last": of(-12), "prior": of(-24)}).drop("__m")


def _found(df: DataFrame, kind: str, entity: str, value: Column, material: Column) -> DataFrame:
    ticker = F.coalesce("code", F.lit("")) != ""
    sure = F.when(ticker & material, "high").when(ticker, "medium").otherwise("low")
    return df.select(F.lit(kind).alias("usecase"), F.col(entity).cast("string").alias("entity"), "code", value.alias("value"), F.when(value >= 0, "up").otherwise("down").alias("direction"), sure.alias("confidence"))


def use_cases(panel: DataFrame, skus: DataFrame, top: int = 6, low: int = 3, new_months: int = 18) -> DataFrame:
    """Ranked findings: brands that gain or lose over twelve months, new products that sell, companies whose share moved between
    the first and the last full year, and brands whose price changed. ``panel``: ``company, brand, code, ym, amt, qty`` by month;
    ``skus``: ``sku, code, first, last`` (dates) and ``amt``. At most ``top`` of each kind (and ``low`` losers); the median that
    makes a brand material is that of its kind's brands."""
    when = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)))
    sums = _year_windows(panel).groupBy("company", "brand", "code").agg(when("last", "amt").alias("a1"), when("prior", "amt").alias("a0"), when("last", "qty").alias("q1"), when("prior", "qty").alias("q0"))
    sums = settled(sums)

    def material(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(percentiles(df, [], "a1", {"median": 0.5})))  # one row

    gains = material(sums.where("a1 > 0 AND a0 > 0").withColumn("v", 100 * (F.col("a1") / F.col("a0") - 1)))
    ends = gains.orderBy(F.desc("v"), "company", "brand").limit(top).unionByName(gains.orderBy("v", F.desc("company"), F.desc("brand")).limit(low)).distinct()
    prices = material(sums.where("a1 > 0 AND q1 > 0 AND q0 > 0 AND a0 <> 0").withColumn("v", 100 * (F.col("a1") / F.col("q1") / (F.col("a0") / F.col("q0")) - 1)))
    month = lambda d: F.year(d) * 12 + F.month(d)
    latest = skus.agg(F.max(month("last")).alias("now"))  # one row
    fresh = skus.join(F.broadcast(latest)).withColumn("live", F.col("now") - month("first")).where(F.col("live") <= new_months)
    fresh = fresh.withColumn("v", F.col("amt") / F.greatest("live", F.lit(1)))
    year = F.floor(F.col("ym") / 100)
    years = panel.groupBy(year.alias("y")).agg(F.count_distinct("ym").alias("n")).where("n >= 12").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    yearly = panel.groupBy("company", "code", year.alias("y")).agg(F.sum("amt").alias("amt")).join(F.broadcast(years)).where("y0 < y1 AND y IN (y0, y1)")
    share = yearly.join(yearly.groupBy("y").agg(F.sum("amt").alias("all")), "y").withColumn("s", 100 * F.try_divide("amt", "all"))
    at = lambda c: F.max(F.when(F.col("y") == F.col(c), F.col("s")))
    moved = share.groupBy("company", "code").agg(at("y1").alias("s1"), F.coalesce(at("y0"), F.lit(0.0)).alias("s0")).where("s1 IS NOT NULL").withColumn("v", F.col("s1") - F.col("s0"))
    tenth = F.round("v", 1)
    found = (
        _found(ends, "momentum", "brand", tenth, F.col("a1") >= F.col("median"))
        .unionByName(_found(fresh.orderBy(F.desc("v"), "sku").limit(top), "new_hit", "sku", F.round("v", 0), F.lit(True)))
        .unionByName(_found(moved.orderBy(F.desc(F.abs("v")), "company").limit(top), "share_shift", "company", tenth, F.lit(True)))
        .unionByName(_found(prices.orderBy(F.desc(F.abs("v")), "company", "brand").limit(top), "price", "brand", tenth, F.col("a1") >= F.col("median")))
    )
    level = F.element_at(F.create_map(F.lit("high"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("low"), F.lit(1)), F.col("confidence"))
    order = [F.desc(level), F.desc(F.abs("value")), "usecase", "entity", "code"]
    return found.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # at most 3 * top + top + low rows


def review_queue(df: DataFrame, keys: list[str], amount: str, known: Column) -> DataFrame:
    """Keys that aren't ``known`` in any row, with their sales, share of all sales in percent, place by sales and the share of
    the queue up to them. Running sums are dealt into steps, so that no task orders all keys. Sums are rounded to four digits, as the
    last ones of a double depend on the order of adding: equal sales go by their keys."""
    sums = df.groupBy(*keys).agg(F.round(F.sum(F.coalesce(F.col(amount), F.lit(0.0))), 4).alias("sales"), F.max(F.coalesce(known, F.lit(False))).alias("__known"))
    sums = settled(sums)
    total = sums.agg(F.nullif(F.sum("sales"), F.lit(0.0)).alias("__total"))  # one row
    placed = positions(sums.where("NOT __known"), "sales", keys).join(F.broadcast(total))
    part = lambda x: F.round(100 * F.col(x) / F.coalesce("__total", F.lit(1.0)), 2)
    return placed.select(*keys, "sales", part("sales").alias("sales_pct"), part("run").alias("cum_pct"), F.col("pos").alias("place"))


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: list[str], column: str, confidence: str | None = None) -> DataFrame:
    """``df`` with ``column`` replaced by what ``overrides`` (one row a key) holds for its keys; blank ones change nothing.
    ``confidence`` becomes high where it was replaced."""
    given = overrides.select(*keys, F.nullif(F.trim(column), F.lit("")).alias("__new")).where("__new IS NOT NULL")
    out = df.join(given, keys, "left").withColumn(column, F.coalesce("__new", column))
    if confidence:
        out = out.withColumn(confidence, F.when(F.col("__new").isNotNull(), "high").otherwise(F.col(confidence)))
    return out.select(*df.columns)


def quality_checks(master: DataFrame, panel: DataFrame, required: list[str], key: str, price: tuple[float, float] = (100.0, 100_000.0)) -> DataFrame:
    """``check, severity, n, share``: blank required columns (error), rows to review, repeated keys, prices out of range, amounts
    of 0 or less and the share of sales that is mapped, then ``overall`` with the worst severity. ``master``: ``amt, mapped``
    and the columns named; ``panel``: ``price, amt``. Shares are of sales, or of rows for the panel. Data of an overall ``error``
    or ``critical`` should not be delivered."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    amount = F.coalesce("amt", F.lit(0.0))
    review = ~F.coalesce("mapped", F.lit(False))
    counted = [F.struct(F.lit(f"blank {c}").alias("check"), F.count_if(blank(c)).alias("n"), F.sum(F.when(blank(c), amount)).alias("x"), F.sum(amount).alias("all")) for c in required]
    counted.append(F.struct(F.lit("to review").alias("check"), F.count_if(review).alias("n"), F.sum(F.when(review, amount)).alias("x"), F.sum(amount).alias("all")))
    counted.append(F.struct(F.lit("mapped share").alias("check"), F.count_if(~review).alias("n"), F.sum(F.when(~review, amount)).alias("x"), F.sum(amount).alias("all")))
    rows = master.agg(F.array(*counted).alias("r")).select(F.inline("r"))
    double = master.groupBy(key).agg(F.count("*").alias("n")).agg(F.lit("repeated key").alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("all"))
    odd, low = ~F.col("price").between(*price), F.col("amt") <= 0
    of_rows = lambda name, flag: F.struct(F.lit(name).alias("check"), F.count_if(flag).alias("n"), F.count_if(flag).cast("double").alias("x"), F.count("*").cast("double").alias("all"))
    both = panel.agg(F.array(of_rows("price range", odd), of_rows("amount not positive", low)).alias("r")).select(F.inline("r"))
    each = rows.unionByName(double).unionByName(both).select("check", "n", F.round(F.coalesce(F.try_divide(100 * F.col("x"), F.col("all")), F.lit(0.0)), 2).alias("share"))
    bad = F.col("n") > 0
    severity = (
        F.when(F.col("check").startswith("blank "), F.when(bad, "error").otherwise("ok"))
        .when(F.col("check") == "mapped share", F.when(F.col("share") < 80, "warning").otherwise("info"))
        .when(F.col("check") == "amount not positive", F.when(F.col("share") > 1, "warning").otherwise("info"))
        .otherwise(F.when(bad, "warning").otherwise("ok"))
    )
    rated = each.withColumn("severity", severity)
    grades = F.array(*map(F.lit, ("ok", "info", "warning", "error", "critical")))
    worst = rated.agg(F.max(F.array_position(grades, F.col("severity"))).alias("w")).select(F.lit("overall").alias("check"), F.element_at(grades, F.col("w").cast("int")).alias("severity"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"))
    return rated.select("check", "severity", "n", "share").unionByName(worst)


def numeric_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: counts of rows, nulls (what isn't a number counts as null), negative values, zeros and values over 1.5
    quartile ranges from the quartiles (from four values on), mean, deviation and extremes."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    quarters = percentiles(long, ["column"], "x", {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    odd = (F.col("x") < F.col("q1") - reach) | (F.col("x") > F.col("q3") + reach)
    rows = long.join(F.broadcast(quarters), "column")  # a row a column
    return rows.groupBy("column").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("x").isNull()).alias("n_null"), F.count_if(F.col("x") < 0).alias("n_negative"), F.count_if(F.col("x") == 0).alias("n_zero"),
        F.when(F.count("x") >= 4, F.count_if(odd)).otherwise(0).alias("n_outlier"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )


def next_review(day: Column, months: int = 6) -> Column:
    """The day ``months`` later, or the last one of its month where that is shorter."""
    return F.add_months(day, months)


def next_id(df: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """One row with the id after the greatest number behind the prefix; the first one for an empty table."""
    number = F.max(F.when(F.col(column).startswith(prefix), F.substring(column, len(prefix) + 1, 18).try_cast("long")))
    text = (F.coalesce(number, F.lit(0)) + 1).cast("string")
    return df.agg(F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")).alias("id"))
