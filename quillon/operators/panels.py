"""Operators on keyed panels: scaling, ranks within groups, splits, overlays, contracts and logs of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What one of each unit is worth in won.
UNITS = {"원": 1, "천원": 1_000, "만원": 10_000, "백만원": 1_000_000, "억원": 100_000_000, "십억원": 1_000_000_000}


def to_won(amount: Column, unit: Column) -> Column:
    """``amount`` of a unit in won; unknown units pass."""
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), unit)
    return amount * F.coalesce(factor, F.lit(1))


def min_max(df: DataFrame, column: str, out: str, missing: float | None = 0.0) -> DataFrame:
    """``column`` from 0 to 1, 0.5 where all values are equal; null values become ``missing`` (None: they stay null). The
    bounds are one row that is joined, not a window over the table."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    x = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    x = F.when(F.col(column).isNotNull(), x)
    rows = df.join(F.broadcast(bounds))  # one row
    return rows.withColumn(out, x if missing is None else F.coalesce(x, F.lit(missing))).drop("__lo", "__hi")


def representativeness(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``sector_rep``: 1 / rank within the group, 0.3 for rows of a blank group."""
    blank = F.coalesce(F.trim(group), F.lit("")) == ""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    ranked = df.where(~blank).withColumn("sector_rep", 1 / rank)
    return ranked.unionByName(df.where(blank).withColumn("sector_rep", F.lit(0.3)))


def bucket_mean_removed(df: DataFrame, column: str, buckets: list[str], out: str) -> DataFrame:
    """``column`` less the mean of its bucket; means are small aggregates joined back, so that a hot bucket is combined
    before it moves."""
    means = df.groupBy(*buckets).agg(F.avg(column).alias("__mean"))
    on = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in buckets]
    joined = df.alias("a").join(means.alias("b"), on)
    return joined.select("a.*", (F.col(f"a.{column}") - F.col("b.__mean")).alias(out))


def train_split(df: DataFrame, key: str, order: str, share: float = 0.6) -> DataFrame:
    """``is_train``: the first ``share`` of each key's rows in order, the cut itself included."""
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn("is_train", F.row_number().over(W.partitionBy(key).orderBy(order)) <= F.floor(n * share) + 1)


def tail_means(df: DataFrame, key: str, order: str, column: str, rows: int = 3) -> DataFrame:
    """``tail_mean`` of each key: the mean of its last ``rows`` values."""
    last = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= rows)
    return df.join(last.groupBy(key).agg(F.avg(column).alias("tail_mean")), key)


def sequence_codes(df: DataFrame, group: str, name: str, prefix: str, width: int = 3) -> DataFrame:
    """``code``: prefix and the number of the name among its group's names, in their order."""
    return df.withColumn("code", F.concat(F.lit(prefix), F.lpad(F.dense_rank().over(W.partitionBy(group).orderBy(name)).cast("string"), width, "0")))


def prefix_lookup(df: DataFrame, code: str, prefixes: DataFrame, sizes: tuple[int, ...] = (6, 4, 3, 2)) -> DataFrame:
    """``df`` with the ``value`` of the longest prefix of ``code`` in ``prefixes`` (prefix, value), blank without one."""
    each = df.select(code).distinct().withColumn("prefix", F.explode(F.array_distinct(F.array(*(F.substring(code, 1, n) for n in sizes)))))
    best = each.join(prefixes, "prefix").groupBy(code).agg(F.max_by("value", F.length("prefix")).alias("value"))
    return df.join(best, code, "left").withColumn("value", F.coalesce("value", F.lit("")))


def contract_state(start: Column, end: Column, today: Column) -> Column:
    """Running from the start to the end (open, if there is none), expired after it, else planned."""
    return F.when(end < today, "expired").when(start <= today, "running").otherwise("planned")


def owner_payouts(df: DataFrame, amount: str, shares: str) -> DataFrame:
    """One row per owner of the array ``shares`` (owner, ratio): the amount times the ratio."""
    each = df.withColumn("__s", F.explode(shares))
    return each.select(*(c for c in df.columns if c != shares), F.col("__s.owner").alias("owner"), (F.col(amount) * F.col("__s.ratio")).alias("payout"))


def change_log(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change``: keys added, removed, or with another row than before."""
    columns = [c for c in old.columns if c != key]
    a, b = (df.select(key, F.struct(*columns).alias(n)) for df, n in ((old, "__old"), (new, "__new")))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def lead_table(sales: DataFrame, disclosed: DataFrame, key: str, quarter: str) -> DataFrame:
    """Sales against disclosed amounts by key and quarter number: growth of both over four quarters (that of the disclosed
    series before the join), their gap, the tracking ratio in percent and whether they moved the same way."""

    def growth(df: DataFrame, x: str) -> DataFrame:
        before = df.select(key, (F.col(quarter) + 4).alias(quarter), F.col(x).alias("__b"))
        return df.join(before, [key, quarter], "left").select(key, quarter, x, (100 * (F.col(x) / F.nullif(F.col("__b"), F.lit(0)) - 1)).alias(f"{x}_yoy"))

    both = growth(sales, "sales").join(growth(disclosed, "disclosed"), [key, quarter])
    gap = F.col("sales_yoy") - F.col("disclosed_yoy")
    ratio = 100 * F.col("sales") / F.nullif(F.col("disclosed"), F.lit(0))
    return both.withColumns({"gap": gap, "tracking": ratio, "same_way": F.signum("sales_yoy") == F.signum("disclosed_yoy")})


def market_brief(prices: DataFrame, key: str, day: str, price: str, value: str, sessions: int = 5, long: int = 20, year: int = 252) -> DataFrame:
    """The last row of each key: return over ``sessions`` rows, mean value of the short window against the long one with a
    label (1.3 and 0.7), and the price's place between the year's extremes."""
    w = W.partitionBy(key).orderBy(day)
    back = lambda n: w.rowsBetween(1 - n, 0)
    ratio = F.avg(value).over(back(sessions)) / F.nullif(F.avg(value).over(back(long)), F.lit(0))
    low, high = F.min(price).over(back(year)), F.max(price).over(back(year))
    rows = prices.select(
        key, day, (100 * (F.col(price) / F.nullif(F.lag(price, sessions).over(w), F.lit(0)) - 1)).alias("ret"), ratio.alias("value_ratio"),
        (100 * (F.col(price) - low) / F.nullif(high - low, F.lit(0))).alias("position"), F.row_number().over(W.partitionBy(key).orderBy(F.desc(day))).alias("__r"),
    ).where("__r = 1").drop("__r")
    return rows.withColumn("flow", F.when(F.col("value_ratio") >= 1.3, "up").when(F.col("value_ratio") <= 0.7, "down").otherwise("flat"))
