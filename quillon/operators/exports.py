"""Tables as others want them: masters under any header, daily rows with English names, sheets after a template, views over all companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Headers that stand for the columns of a user's master (lower case, without underscores), the master's columns, words of the
# names of sheets by kind (the first kind that fits counts; dictionaries are left out), and headers that stand for columns by kind.
MASTER_HEADERS = {
    "name": ("name", "회사명", "company", "companyname", "brand", "brandname"), "stock_code": ("stockcode", "종목코드", "ticker", "code", "단축코드"),
    "isin": ("isin", "isucd", "securitycode"), "market": ("market", "시장"),
}
MASTER_COLUMNS = ("isin", "stock_code", "name", "name_full", "name_eng", "market", "secgroup")
SHEETS = {
    "dictionary": ("dictionary", "사전"), "TR_BASIC": ("기본매출", "tr_basic", "basic", "sales"), "List": ("기본정보", "회사정보", "list"), "DEMOGRAPHIC": ("인구", "demograph"),
    "RETENTION": ("재구매", "retention"), "PANEL": ("패널", "panel"), "Information": ("information", "정보"),
}
HEADERS = {
    "List": {
        "공시명": "disclosure_name", "회사명": "company_name_en", "회사": "company_name_en", "company": "company_name_en", "브랜드명": "brand_label", "브랜드": "brand_label", "brand": "brand_label",
        "법인등록번호": "jurir_no", "jurir_no": "jurir_no", "isin": "isin", "ticker": "ticker", "종목코드": "ticker", "gics": "gics_sub_industry",
    },
    "TR_BASIC": {
        "거래일": "date", "거래일자": "date", "date": "date", "회사명": "company_en", "회사": "company_en", "company": "company_en", "브랜드명": "brand_label", "브랜드": "brand_label", "brand": "brand_label",
        "채널": "channel", "channel": "channel", "거래금액": "sales_amount", "매출": "sales_amount", "sales": "sales_amount", "거래수량": "sales_qty", "수량": "sales_qty", "qty": "sales_qty",
        "거래건수": "sales_cnt", "건수": "sales_cnt", "거래자수": "buyers", "buyers": "buyers",
    },
}


def user_master(df: DataFrame) -> DataFrame:
    """A user's mapping table, whatever its headers, with ``MASTER_COLUMNS`` as text ('' where there is nothing): codes of six digits, the
    full name filled by the name. Of several columns that stand for one the first counts. Without a name, or without code
    and ISIN, it raises."""
    found: dict[str, str] = {}
    for c in df.columns:
        plain = c.strip().lower().replace("_", "")
        target = next((t for t, headers in MASTER_HEADERS.items() if plain in headers), c if c in MASTER_COLUMNS else None)
        if target:
            found.setdefault(target, c)
    if "name" not in found or not {"stock_code", "isin"} & set(found):
        raise ValueError("a master needs a column of names and one of codes or ISINs")
    text = lambda t: F.trim(F.coalesce(F.col(f"`{found[t]}`").cast("string"), F.lit(""))) if t in found else F.lit("")
    out = df.select(*(text(t).alias(t) for t in MASTER_COLUMNS))
    code = F.when((F.col("stock_code") != "") & (F.length("stock_code") < 6), F.lpad("stock_code", 6, "0")).otherwise(F.col("stock_code"))
    return out.withColumns({"stock_code": code, "name_full": F.coalesce(F.nullif("name_full", F.lit("")), "name")})


def enriched_daily(daily: DataFrame, keys: DataFrame, regions: DataFrame, categories: DataFrame, lag_days: int = 15) -> DataFrame:
    """``daily`` (``date`` as YYYYMMDD, ``region, barcode, cat_l1, cat_l2, cat_l3``, measures) with ``available_date``, the columns of ``keys`` by barcode, and English
    names of the region (``region, region_en``) and the categories (``category, category_en``) that fall back to the names themselves. The
    three sides are joined by equal keys, each once: of rows with one key the first name in order counts."""
    one = lambda t, key, value: t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(value).alias("__v"))
    out = daily.withColumn("available_date", F.date_add(F.to_date(F.col("date").cast("string"), "yyyyMMdd"), lag_days).cast("string"))
    first = keys.groupBy(F.col("barcode").cast("string").alias("__b")).agg(*(F.min(c).alias(c) for c in keys.columns if c != "barcode"))
    out = out.join(first, F.col("barcode").cast("string") == F.col("__b"), "left").drop("__b")
    for column, names in [("region", one(regions, "region", "region_en")), *((f"cat_l{i}", one(categories, "category", "category_en")) for i in (1, 2, 3))]:
        out = out.join(names, F.col(column) == F.col("__k"), "left").withColumn(f"{column}_en", F.coalesce("__v", column)).drop("__k", "__v")
    return out


def sheet_kind(name: str) -> str | None:
    """What a sheet of this name holds; None for dictionaries, which aren't delivered."""
    kind = next((k for k, words in SHEETS.items() if any(w in name.lower() for w in words)), "OTHER")
    return None if kind == "dictionary" else kind


def template_plan(sheets: dict[str, list[str]]) -> list[dict]:
    """``sheet, kind, columns`` (name, from) of every sheet of a template, in its order, from the sheets' headers: a header that stands for
    no column comes from '' and stays blank; blank headers and sheets without headers are left out."""
    out = []
    for name, headers in sheets.items():
        kind, known = sheet_kind(name), HEADERS.get(sheet_kind(name), {})
        columns = [{"name": h, "from": known.get(h.strip()) or known.get(h.strip().lower()) or ""} for h in headers if h.strip()]
        if kind and columns:
            out.append({"sheet": name, "kind": kind, "columns": columns})
    return out


def by_template(frames: dict[str, DataFrame], plan: list[dict]) -> dict[str, DataFrame]:
    """The sheets of a plan from the tables of their kinds: columns in the template's order and under its names (a repeated name gets
    ``_2, _3, ...``), '' where the table lacks one; kinds without a table have no sheet."""
    out = {}
    for sheet in plan:
        df = frames.get(sheet["kind"])
        if df is None:
            continue
        used: dict[str, int] = {}
        columns = []
        for c in sheet["columns"]:
            used[c["name"]] = used.get(c["name"], 0) + 1
            named = c["name"] if used[c["name"]] == 1 else f"{c['name']}_{used[c['name']]}"
            columns.append((F.col(f"`{c['from']}`") if c["from"] in df.columns else F.lit("")).alias(named))
        out[sheet["sheet"]] = df.select(*columns)
    return out


def with_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which none of the columns is null or, among floats, not a number."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull() for c in columns), F.lit(True)))


def new_products(df: DataFrame, first_day: str, since: int = 20230101) -> Column:
    """Was the product first sold on or after a day (YYYYMMDD)? Unknown days are not."""
    return F.coalesce(F.col(first_day).cast("long") >= since, F.lit(False))


def excess_returns(returns: DataFrame, benchmark: DataFrame, day: str) -> DataFrame:
    """``returns`` (day, ``ret`` and others) with the ``benchmark_ret`` of its day and the ``excess``, both null on days without one."""
    index = benchmark.select(F.col(day).alias("__d"), F.col("ret").alias("benchmark_ret"))
    return returns.join(index, F.col(day) == F.col("__d"), "left").drop("__d").withColumn("excess", F.col("ret") - F.col("benchmark_ret"))


def demand_signal(volume: Column, price: Column, edge: float = 5.0) -> Column:
    """What moved demand, by the changes of volume and price in percent against an edge; ``unknown`` while one isn't known."""
    up, down = lambda x: x >= edge, lambda x: x < -edge
    return (
        F.when(volume.isNull() | price.isNull(), "unknown").when(up(volume) & up(price), "volume and price").when(up(volume) & down(price), "volume, price falls").when(up(volume), "volume")
        .when(up(price) & down(volume), "price, volume falls").when(up(price), "price").when(down(volume) & down(price), "both fall").when(down(volume), "volume falls").when(down(price), "price falls").otherwise("steady")
    )


def top_by_sales(df: DataFrame, key: str, sales: str, n: int) -> DataFrame:
    """``key, sales, share`` of the ``n`` keys with the highest sums (ties: the first in order); shares in percent of all sales, those of rows
    without a key among them. Null and blank keys aren't listed."""
    total = df.agg(F.sum(sales)).first()[0] or 1.0
    sums = df.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.sum(sales).alias("sales"))
    return sums.orderBy(F.desc_nulls_last("sales"), key).limit(n).withColumn("share", 100 * F.col("sales") / F.lit(total))


def market_universe(markets: dict[str, DataFrame], caps: DataFrame, n: int | None = None) -> DataFrame:
    """``code, name, market, cap``: the securities of all markets (``code, name``; a code in several belongs to the first) with their market value
    (``code, cap``; the highest), the largest first, unknown ones last; the first ``n``, if given."""
    listed = reduce(DataFrame.unionByName, (df.select("code", "name", F.lit(m).alias("market"), F.lit(i).alias("__i")) for i, (m, df) in enumerate(markets.items())))
    first = listed.where("code IS NOT NULL").groupBy("code").agg(F.min_by(F.struct("name", "market"), F.struct("__i", "name")).alias("s")).select("code", "s.*")
    out = first.join(caps.groupBy("code").agg(F.max("cap").alias("cap")), "code", "left")
    return out if n is None else out.orderBy(F.desc_nulls_last("cap"), "code").limit(n)


def all_company_earnings(quarters: DataFrame, disclosed: DataFrame) -> DataFrame:
    """``quarter, sales, qoq, yoy, disclosed, report``: sales of all companies a quarter (``company, quarter, sales``) with growth against the row before and
    the fourth before it, and what companies disclosed for it (``company, quarter, disclosed, report``): the sum, and the first report of
    the first company that has one. Only quarters with sales have rows."""
    w = W.orderBy("quarter")  # one row a quarter
    total = quarters.groupBy("quarter").agg(F.sum("sales").alias("sales"))
    growth = lambda k: 100 * (F.col("sales") / F.nullif(F.lag("sales", k).over(w), F.lit(0.0)) - 1)
    said = disclosed.groupBy("quarter").agg(F.sum("disclosed").alias("disclosed"), F.min_by("report", F.when(F.col("report").isNotNull(), F.struct("company", "report"))).alias("report"))
    return total.withColumns({"qoq": growth(1), "yoy": growth(4)}).join(said, "quarter", "left")
