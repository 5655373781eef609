"""What a dashboard says of companies: anomalies of sales and counts, demand, one score of both with growth, and how sound the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import percentiles

# Severities by absolute z-score, bands of the score, weights of the demand score (of changes from -50 to 50 percent, of the
# acceleration from -20 to 20 points), what severe events cost, and how far fewer analyses than three draw the score to 50.
SEVERITIES = ((5.0, "critical"), (4.0, "high"), (3.0, "medium"))
BANDS = ((75, "strong buy"), (60, "buy"), (45, "neutral"), (30, "caution"))
DEMAND = (("sales_chg", 0.30, 50.0), ("tx_chg", 0.25, 50.0), ("ticket_chg", 0.20, 50.0), ("sales_accel", 0.25, 20.0))
COSTS = {"critical": 10, "high": 5, "medium": 2}
TRUST = {1: 0.6, 2: 0.8}


def anomalies(panel: DataFrame, method: str = "z", threshold: float = 2.5, window: int = 6) -> DataFrame:
    """Events of ``panel`` (``company, period, sales, tx``; one row a period): ``company, period, metric, kind, actual, expected, deviation, z, severity``. A
    value is out of line by its z-score against the window that ends with it (``z``, over ``threshold``), by 1.5 interquartile
    ranges beyond that window's quartiles (``iqr``), or by either (``both``). Windows need three values, companies three periods;
    windows without spread mark nothing, and null values neither count nor are marked."""
    if method not in ("z", "iqr", "both"):
        raise ValueError("method: z, iqr or both")
    rows = panel.select("company", "period", F.col("sales").cast("double").alias("sales"), F.col("tx").cast("double").alias("tx")).unpivot(["company", "period"], ["sales", "tx"], "metric", "x")
    every = W.partitionBy("company", "metric")
    w = every.orderBy("period").rowsBetween(1 - window, 0)
    least = min(3, window)
    mean, spread = F.avg("x").over(w), F.nullif(F.stddev_samp("x").over(w), F.lit(0.0))
    q1, q3 = F.percentile("x", F.lit(0.25)).over(w), F.percentile("x", F.lit(0.75)).over(w)
    rows = rows.withColumns({"periods": F.count(F.lit(1)).over(every), "n": F.count("x").over(w), "mean": mean, "sd": spread, "q1": q1, "q3": q3})
    enough = (F.col("n") >= least) & (F.col("periods") >= 3) & F.col("x").isNotNull()
    z = F.when(enough, F.round((F.col("x") - F.col("mean")) / F.col("sd"), 2))
    iqr = F.nullif(F.col("q3") - F.col("q1"), F.lit(0.0))
    by_z = F.coalesce(F.abs(z) > threshold, F.lit(False))
    by_iqr = enough & F.coalesce((F.col("x") < F.col("q1") - 1.5 * iqr) | (F.col("x") > F.col("q3") + 1.5 * iqr), F.lit(False))
    marked = rows.withColumn("z", z).where({"z": by_z, "iqr": by_iqr, "both": by_z | by_iqr}[method])
    expected = F.rint("mean")
    severity = F.coalesce(*(F.when(F.abs("z") >= at, name) for at, name in SEVERITIES), F.lit("low"))
    deviation = F.round(100 * (F.col("x") - expected) / F.nullif(expected, F.lit(0.0)), 1)
    return marked.select("company", "period", "metric", F.when(F.col("x") >= F.col("mean"), "rise").otherwise("fall").alias("kind"), F.rint("x").alias("actual"), expected.alias("expected"), deviation.alias("deviation"), "z", severity.alias("severity"))


def demand(panel: DataFrame) -> DataFrame:
    """``panel`` (``company, period, sales, tx``) with changes against the row before in percent (``sales_chg, tx_chg, ticket_chg``), their change
    (``sales_accel``), the parts of the change of sales (``volume, price, mix``), what drove it, and ``demand_score``: of the means of each
    company's last three rows, those that aren't known counting as the middle. Changes from 0 are null."""
    w = W.partitionBy("company").orderBy("period")
    before = lambda c: F.lag(c).over(w)
    change = lambda c: 100 * (F.col(c) / F.nullif(before(c), F.lit(0.0)) - 1)
    rows = panel.select("company", "period", F.col("sales").cast("double").alias("sales"), F.col("tx").cast("double").alias("tx"))
    rows = rows.withColumn("ticket", F.when(F.col("tx") > 0, F.col("sales") / F.col("tx")))
    rows = rows.withColumns({"sales_chg": change("sales"), "tx_chg": change("tx"), "ticket_chg": change("ticket"), "d": F.col("sales") - before("sales"), "dx": F.col("tx") - before("tx"), "dt": F.col("ticket") - before("ticket"), "tx0": before("tx"), "ticket0": before("ticket")})
    rows = rows.withColumns({"sales_accel": F.col("sales_chg") - before("sales_chg"), "volume": F.col("ticket0") * F.col("dx"), "price": F.col("tx0") * F.col("dt"), "mix": F.col("dx") * F.col("dt")})
    v, p, d = F.col("volume"), F.col("price"), F.col("d")
    share = lambda x: x / F.greatest(F.abs(d), F.lit(1.0))
    rise = F.when(share(v) >= 0.6, "volume").when(share(p) >= 0.6, "price").when((v > 0) & (p > 0), "volume and price").otherwise("other")
    fall = F.when((v < 0) & (p < 0), "both fall").when(F.abs(v) >= F.abs(p), "volume falls").otherwise("price falls")
    rows = rows.withColumns({"driver": F.when(v.isNull() | p.isNull() | d.isNull() | (d == 0), "").when(d > 0, rise).otherwise(fall), "__r": F.row_number().over(W.partitionBy("company").orderBy(F.desc("period")))})
    company = W.partitionBy("company")

    def scaled(name: str, weight: float, reach: float) -> Column:
        mean = F.avg(F.when(F.col("__r") <= 3, F.col(name))).over(company)
        return weight * F.when(mean.isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (mean + reach) / (2 * reach) * 100)))

    score = sum((scaled(*rule) for rule in DEMAND), F.lit(0.0))
    return rows.withColumn("demand_score", F.round(score, 1)).select("company", "period", "sales", "tx", "sales_chg", "tx_chg", "ticket_chg", "sales_accel", "volume", "price", "mix", "driver", "demand_score")


def alpha_points(mom: Column, demand_score: Column, critical: Column, high: Column, medium: Column, analyses: int = 3) -> Column:
    """0 to 100: growth of the last period (-30 % to 30 % for 0 to 40), demand (0 to 35), and 25 less what severe events cost. What isn't
    known counts half; with fewer than three analyses the score lies nearer to 50."""
    growth = F.when(mom.isNull(), 20.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(40.0), (mom + 30) / 60 * 40)))
    wanted = F.when(demand_score.isNull(), 17.5).otherwise(demand_score * 0.35)
    cost = F.least(F.lit(25), critical * COSTS["critical"] + high * COSTS["high"] + medium * COSTS["medium"])
    points, trust = growth + wanted + 25 - cost, TRUST.get(analyses, 1.0)
    score = points if trust == 1.0 else 50 + (points - 50) * trust  # halves of the last digit are common: no step that blurs them
    return F.round(10 * F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))) / 10


def band(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= at, name) for at, name in BANDS), F.lit("risk"))


def dashboard(panel: DataFrame, method: str = "z", threshold: float = 2.5, window: int = 6) -> DataFrame:
    """A row per company of ``panel`` (``company, period, sales, tx``): growth and acceleration of its last period, trend, driver, demand score,
    events, and the score of it all with its band."""
    last = demand(panel).groupBy("company").agg(F.max_by(F.struct("sales_chg", "sales_accel", "driver", "demand_score"), "period").alias("l"))
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    events = anomalies(panel, method, threshold, window).groupBy("company").agg(F.count("*").alias("events"), *map(count, COSTS))
    rows = last.join(events, "company", "left").na.fill(0, ["events", *COSTS])
    mom, accel = F.round("l.sales_chg", 1), F.round("l.sales_accel", 1)
    trend = F.when(F.col("l.sales_accel") > 2, "accelerates").when(F.col("l.sales_chg") > 5, "grows").when(F.col("l.sales_accel") < -2, "slows").otherwise("flat")
    score = alpha_points(mom, F.col("l.demand_score"), *(F.col(s) for s in COSTS))
    return rows.select("company", mom.alias("mom"), accel.alias("accel"), trend.alias("trend"), F.col("l.driver").alias("driver"), F.col("l.demand_score").alias("demand_score"), "events", "critical", score.alias("score"), band(score).alias("band"))


def data_quality(df: DataFrame, date: str, sales: str, tx: str | None = None) -> DataFrame:
    """``check, severity, n, cut`` and in every row the ``score``: 100 less the cuts of missing dates, sales and counts, repeated rows, negative and zero
    sales, outliers by interquartile ranges, and too few rows with both date and sales. All rows are looked at; their order isn't.
    The quartiles and the number of repeated rows are worked out at once, the rest when the result is used."""
    rows = df.select(F.col(date).alias("d"), F.col(sales).cast("double").alias("s"), (F.lit(0) if tx is None else F.col(tx)).alias("t"))
    repeated = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0] or 0
    edges = percentiles(rows.where("s IS NOT NULL"), [], "s", {"q1": 0.25, "q3": 0.75}).first() or (0.0, 0.0)
    reach = 1.5 * (edges[1] - edges[0])
    some = lambda c, name: F.count(F.when(c, 1)).alias(name)
    one = rows.agg(
        F.count("*").alias("total"), some(F.col("d").isNull(), "no_date"), some(F.col("s").isNull(), "no_sales"), some(F.col("t").isNull(), "no_tx"), some(F.col("s") < 0, "negative"), some(F.col("s") == 0, "zero"),
        some(F.col("s").isNotNull(), "known"), some(F.col("d").isNotNull() & F.col("s").isNotNull(), "usable"), some((F.col("s") < edges[0] - reach) | (F.col("s") > edges[1] + reach), "outliers"),
    ).withColumn("repeated", F.lit(repeated))
    percent = lambda name: 100.0 * F.col(name) / F.nullif(F.col("total"), F.lit(0))
    share = lambda name, most, part: F.floor(F.least(F.lit(float(most)), percent(name) * part))
    check = lambda name, bad, n, cut: F.struct(F.lit(name).alias("check"), F.when(n > 0, bad).otherwise("ok").alias("severity"), n.cast("long").alias("n"), F.when(n > 0, cut).otherwise(0).cast("int").alias("cut"))
    c = F.col
    outliers = F.when(c("known") >= 4, c("outliers")).otherwise(0)
    few = F.when(c("usable") < 10, 30).when(c("usable") < 30, 15).when(c("usable") < 100, 5).otherwise(0)
    usable = F.struct(F.lit("usable_rows").alias("check"), F.when(few == 30, "critical").when(few == 15, "warning").when(few == 5, "info").otherwise("ok").alias("severity"), c("usable").cast("long").alias("n"), few.cast("int").alias("cut"))
    checks = [
        check("no_date", "error", c("no_date"), share("no_date", 30, 0.5)), check("no_sales", "error", c("no_sales"), share("no_sales", 25, 0.4)), *([] if tx is None else [check("no_tx", "warning", c("no_tx"), share("no_tx", 5, 0.05))]),
        check("repeated", "warning", c("repeated"), F.when(percent("repeated") > 5, 10).otherwise(5)), check("negative", "warning", c("negative"), F.lit(5)), check("zero", "info", c("zero"), F.when(percent("zero") > 5, 5).otherwise(2)),
        check("outliers", "info", outliers, F.when(percent("outliers") > 10, 5).when(percent("outliers") > 5, 3).otherwise(0)), usable,
    ]
    listed = one.select(F.array(*checks).alias("cs"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.aggregate("cs", F.lit(0), lambda a, x: a + x["cut"])))
    return listed.select(score.alias("score"), F.explode("cs").alias("x")).select("x.*", "score")
