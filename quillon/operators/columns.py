"""Columns of many tables profiled, scored against standard columns and assigned to them one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

# Words of a column's name that tell its kind, by kind, in the order in which kinds are tried.
KINDS = {
    "isin": ("isin", "isu_cd", "security", "sec_code"),
    "stock_code": ("stock", "ticker", "stk", "종목코드", "단축코드", "stock_code"),
    "corp_code": ("법인등록번호", "법인번호", "법인id", "사업자등록번호", "사업자번호", "사업자", "jurir_no", "jurirno", "bizr_no", "bizrno", "corp_id", "corp_no", "corpcode"),
    "name_eng": ("영문명", "영문회사명", "영문 회사명", "영문기업명", "name_eng", "nameeng", "corp_eng", "corpeng", "eng_name", "engname", "corp_name_eng", "english", "englishname", "english_name"),
    "company": ("company", "corp", "회사", "기업", "법인", "업체", "거래처", "client", "vendor", "고객사", "company_name", "corp_name", "grp_acnt", "account_name", "회사명", "기업명"),
    "brand": ("brand", "브랜드", "상표", "maker", "제조", "brand_name", "grp_item"),
    "sku": ("sku", "item", "product", "상품", "제품", "품목", "goods", "아이템", "sku_name", "item_name", "product_name"),
    "category": ("category", "cate", "카테고리", "분류", "구분", "genre", "type", "class", "category_name", "lrcl", "mdcl", "smcl", "sector", "섹터", "업종", "industry", "segment"),
    "date": ("date", "day", "ymd", "yyyymmdd", "거래일", "일자", "날짜", "기준일", "년월일", "transaction_date", "주문일", "결제일", "tx_date"),
    "amount": ("amount", "amt", "revenue", "sales", "value", "price", "매출", "금액", "거래액", "판매액", "결제액", "sale_amt", "sales_amount"),
    "count": ("count", "cnt", "tx_cnt", "number_of_tx", "거래건수", "건수", "주문수", "결제건수", "n_tx"),
    "quantity": ("qty", "quantity", "수량", "ea", "개수", "sale_qty"),
    "region": ("sido", "region", "지역", "시도", "주소"),
    "gender": ("gender", "성별", "sex"),
    "age": ("age", "연령", "나이"),
}
# Kinds that are numbers, names and codes; endings of the names of columns with names and with codes; scores.
NUMBERS, NAMES, CODES = ("amount", "count", "quantity"), ("company", "brand", "sku", "category"), ("stock_code", "isin")
NAME_LIKE, CODE_LIKE = r"(?i)(_nm|이름|명|_name)$", r"(?i)(_cd|코드|_code)$"
SAME, KIND_AND_PART, KIND, PART, TYPE = 100, 80, 60, 30, 10


def column_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[\s_\-.,/()]+", ""))


def _plain(word: str) -> str:
    return "".join(c for c in word.lower() if c not in "_-.,/()" and not c.isspace())


def column_kind(name: str) -> str:
    """The first kind one of whose words is in the name, as it stands or without spaces and punctuation; ``text`` if none is."""
    low, key = name.lower(), _plain(name)
    return next((kind for kind, words in KINDS.items() if any(w.lower() in low or _plain(w) in key for w in words)), "text")


def _dtype(kind: DataType) -> str:
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return "datetime"
    if isinstance(kind, NumericType):
        return "float" if kind.typeName() in ("double", "float", "decimal") else "int"
    return "bool" if kind.typeName() == "boolean" else "object"


def column_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, place, column, dtype, sample, null_pct, n_unique``: one row per column of each table (n_unique: approximate; sample: the smallest
    text). A table is read once, and gives one row of aggregates. Nested columns are ``object`` without sample and count."""
    out = None
    for name, df in tables.items():
        rows = []
        for i, field in enumerate(df.schema.fields):
            x = F.col(f"`{field.name}`")
            flat = field.dataType.typeName() not in ("array", "map", "struct", "variant")
            missing = F.round(F.try_divide(F.lit(100.0) * F.count_if(x.isNull()), F.count("*")), 2)
            sample = F.min(x.cast("string")) if flat else F.lit(None).cast("string")
            rows.append(F.struct(F.lit(i).alias("place"), F.lit(field.name).alias("column"), F.lit(_dtype(field.dataType)).alias("dtype"), sample.alias("sample"), missing.alias("null_pct"), (F.approx_count_distinct(x) if flat else F.lit(None).cast("long")).alias("n_unique")))
        one = df.agg(F.array(*rows).alias("r")).select(F.lit(name).alias("table"), F.explode("r").alias("r")).select("table", "r.*")
        out = one if out is None else out.unionByName(one)
    return out


def pair_scores(profiles: DataFrame, standard: list[str]) -> DataFrame:
    """``table, i, std_col, kind, j, raw_col, score``: how well each column of a table fits each standard column, pairs over 0 only.
    Equal names score 100; else a word of the standard column's kind in the name, a part of one name that is the other, and the
    column's type count together; endings for names and codes speak for or against some kinds."""
    wanted = [(i, s, column_kind(s), _plain(s), "\n".join(map(_plain, KINDS.get(column_kind(s), ())))) for i, s in enumerate(standard)]
    each = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("i", "std_col", "kind", "a", "words"), w, strict=True))) for w in wanted))
    pairs = profiles.select("table", F.col("place").alias("j"), F.col("column").alias("raw_col"), "dtype", "sample", F.explode(each).alias("s")).select("*", "s.*")
    pairs = pairs.withColumn("b", column_key(F.col("raw_col")))
    kind = F.exists(F.split("words", "\n"), lambda w: (w != "") & F.contains("b", w))
    part = (F.length("a") >= 2) & (F.length("b") >= 2) & (F.contains("a", "b") | F.contains("b", "a"))
    k = F.col("kind")
    typed = F.when(k == "date", (F.col("dtype") == "datetime") | F.coalesce(F.col("sample").rlike(r"^\d{8}"), F.lit(False))).when(k.isin(*NUMBERS), F.col("dtype").isin("int", "float")).when(k.isin(*NAMES), F.col("dtype") == "object").otherwise(False)
    named, coded = F.col("raw_col").rlike(NAME_LIKE), F.col("raw_col").rlike(CODE_LIKE)
    bonus = F.when(k.isin(*NAMES), F.when(named, 15).when(coded, -15)).when(k.isin(*CODES) & coded, 10).when(k.isin(*NUMBERS) & coded, -10)
    bonus = F.coalesce(bonus, F.lit(0))
    by_type = lambda n: F.when(typed, n).otherwise(0)
    score = F.when(F.col("a") == F.col("b"), SAME).when(kind & part, KIND_AND_PART + by_type(5) + bonus).when(kind, KIND + by_type(5) + bonus).when(part, PART + by_type(10) + bonus).when(typed, TYPE + bonus).otherwise(0)
    pairs = pairs.withColumn("score", F.when((F.length("std_col") > 0) & (F.length("raw_col") > 0), F.greatest(F.lit(0), score)).otherwise(0))
    return pairs.where("score > 0").select("table", "i", "std_col", "kind", "j", "raw_col", "score")


def map_columns(spark: SparkSession, tables: dict[str, DataFrame], standard: list[str]) -> DataFrame:
    """``table, std_col, kind, raw_col, score, candidates``: a row for each table and standard column. The pairs of a table are gone through
    from the highest score (then in the order of the standard columns, then of the table's) and taken if neither side is taken yet;
    a standard column that gets none has null and 0. ``candidates``: up to five columns by score. What is folded for a table is as
    many rows as it has pairs of columns."""
    pairs = pair_scores(column_profiles(tables), standard)
    listed = pairs.groupBy("table").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "i", "j", "raw_col"))).alias("p"))
    start = F.struct(F.array().cast("array<int>").alias("si"), F.array().cast("array<int>").alias("sj"), F.array().cast("array<struct<i:int,raw_col:string,score:int>>").alias("got"))

    def take(t: Column, p: Column) -> Column:
        free = ~F.array_contains(t["si"], p["i"]) & ~F.array_contains(t["sj"], p["j"])
        one = F.struct(p["i"].alias("i"), p["raw_col"].alias("raw_col"), (-p["o"]).alias("score"))
        return F.when(free, F.struct(F.array_append(t["si"], p["i"]).alias("si"), F.array_append(t["sj"], p["j"]).alias("sj"), F.array_append(t["got"], one).alias("got"))).otherwise(t)

    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("std_col"), F.lit(column_kind(x)).alias("kind")) for i, x in enumerate(standard)))
    folded = listed.select("table", "p", F.aggregate("p", start, take, lambda t: t["got"]).alias("got"))
    names = spark.createDataFrame([(t,) for t in tables], "table string").join(folded, "table", "left").select("*", F.explode(wanted).alias("w")).select("*", "w.*")
    mine = lambda xs: F.filter(xs, lambda x: x["i"] == F.col("i"))
    got, near = F.get(mine("got"), F.lit(0)), F.transform(F.slice(mine("p"), 1, 5), lambda x: x["raw_col"])
    out = names.select("table", "std_col", "kind", got["raw_col"].alias("raw_col"), got["score"].alias("score"), near.alias("candidates"))
    return out.select("table", "std_col", "kind", "raw_col", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
