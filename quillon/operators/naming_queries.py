"""Queries of the operators on names: similar spellings, dictionaries, product names, column names; with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import columns, mastering, products, similar
from quillon.sources import types
from quillon.sources.roles import table


def _words(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias(name))


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar word of the answers for every word that only users write."""
    turns = table(spark, sf_dir, "conversations")
    theirs = _words(turns.where("role = 'assistant'"), "text", "word").distinct()
    mine = _words(turns.where("role = 'user'"), "text", "asked").distinct().join(theirs, F.col("asked") == F.col("word"), "left_anti")
    return similar.closest(mine, "asked", theirs, "word").select(F.col("a").alias("asked"), F.col("b").alias("answer"), F.round("ratio", 4).alias("ratio"))


#: What the words of the table of parts are called in Korean, so that its names are of the kind that the operators read.
TYPES = {"ECONOMY": "순한맛", "STANDARD": "오리지널", "PROMO": "매운맛", "SMALL": "김치치즈", "MEDIUM": "", "LARGE": "짜장"}
NOUNS = {"anvil": "큰사발면", "gear": "사발", "gizmo": "컵", "ring": "봉지", "bolt": "캔", "plate": "병 신제품", "rod": "큰컵", "widget": ""}


def _words_of(x: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in words.items() for v in kv)), x)


def _korean_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with ``name``: brand, name, flavour and package form, and size."""
    part = table(spark, sf_dir, "part")
    form = _words_of(F.substring_index("p_name", " ", -1), NOUNS)
    return part.withColumn("name", F.concat_ws(" ", "p_brand", "p_name", F.concat(_words_of(F.col("p_type"), TYPES), form), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") > 40, "g x2").otherwise(" 입"))))


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names taken apart, and put together again in English."""
    parts = _korean_parts(spark, sf_dir)
    brands = parts.select(F.col("p_brand").alias("brand"))
    out = mastering.parse_product_names(parts, "name", brands)
    english = mastering.assemble_english(F.col("brand"), F.col("base_product"), F.col("flavor"), F.col("format"), F.col("package_size"))
    return out.select("p_partkey", "brand", "base_product", "flavor", "format", "package_size", english.alias("english"))


def _dictionary(spark: SparkSession) -> DataFrame:
    words = mastering.FORMS | {"큰컵": "Big Cup", "짜장": "Jjajang", "김치": "Kimchi", "치즈": "Cheese", "매운맛": "Spicy", "매운": "Spicy", "오리지널": "Original", "큰": "Big"}
    return spark.createDataFrame([(w, e, r) for r, (w, e) in enumerate(words.items())], "word string, english string, rank int")


def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names with the words of a dictionary in English."""
    out = mastering.translated(_korean_parts(spark, sf_dir), "name", _dictionary(spark))
    return out.select("p_partkey", F.array_join("parts", "|").alias("parts"), "rest", "known")


def _masters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Master, special names and seeds out of the parts: the brands of the dearest parts, the totals, and brands with their cheapest part."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy(F.col("p_type").alias("company"), F.col("p_brand").alias("brand")).agg(F.max("p_retailprice").alias("top"), F.min("p_size").alias("least"), F.count("*").alias("n"))
    english = F.concat(F.initcap("company"), F.lit(" "), F.regexp_replace("brand", "#", " No. "))
    master = brands.where("top > 1050").select("company", "brand", F.concat(F.upper("company"), F.lit(":"), F.col("brand")).alias("id"), english.alias("english"), F.array(F.lower("brand")).alias("aliases"))
    special = spark.createDataFrame([("전체", "Total"), ("기타", "Etc"), ("Brand#7", "Etc")], "brand string, english string")
    own = brands.where("n >= 12").select("company", "brand", F.concat(F.lit("Seed "), F.col("brand")).alias("english"))
    shared = brands.where("least = 1").select(F.lit(None).cast("string").alias("company"), "brand", F.lit("Common Seed").alias("english"))
    return master, special, own.unionByName(shared)


def brands_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's brand by master, special names, seeds, or its own letters."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("slug"))
    out = mastering.resolve_brands(rows, "p_type", "p_brand", "slug", *_masters(spark, sf_dir))
    return out.select("p_partkey", "brand_id", "brand_en", F.array_join("aliases", "|").alias("aliases"), "curated")


def sku_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master of all parts: English names, codes, and how sure the mapping is; ids made of the codes."""
    n = F.coalesce(F.col("name"), F.lit(""))
    rows = _korean_parts(spark, sf_dir).select(
        F.col("p_type").alias("company"), F.col("p_brand").alias("brand"), F.lower("p_type").alias("company_slug"), F.col("name").alias("sku_name"),
        F.concat(_words_of(F.substring_index("p_name", " ", -1), NOUNS), F.lit(" "), _words_of(F.col("p_type"), TYPES), F.lit(" 2입")).alias("variant"),
        products.package_form(F.lit(""), n).alias("package_format"), F.when(F.col("p_size") > 40, 2).otherwise(1).alias("pack_count"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("size_value"), F.lit("g").alias("size_unit"), F.col("p_partkey").alias("barcode"),
    )
    master, special, seeds = _masters(spark, sf_dir)
    out = mastering.sku_master(rows, _dictionary(spark), master, special, seeds)
    ids = mastering.allocate_ids(out, "barcode", "sku_slug").select(F.col("key").alias("barcode"), F.col("id").alias("code"))
    return out.join(ids, "barcode").select("barcode", "sku_id", "sku_name_en", "sku_slug", "mapping_confidence", "mapping_status", "code")


def _text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a file of text would have them: dates in several forms, separators, blanks, codes with zeros."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer"), F.date_format(d, "yyyyMMdd").alias("day"),
        F.concat(F.date_format(d, "yyyyMM"), F.lit(".0")).alias("month"), F.when(F.col("o_orderstatus") != "P", F.date_format(d, "yyyy/MM/dd")).otherwise(" ").alias("closed"),
        F.format_number("o_totalprice", 2).alias("price"), F.format_number(F.floor("o_totalprice"), 0).alias("won"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("no").alias("filled"),
        F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") > 1000, F.date_format(d, "yyyy-MM-dd")).otherwise("soon").alias("mixed"),
    )


def order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the orders' text columns; a hundredth of a column's values may be something else."""
    return types.type_table(spark, types.infer_types(_text_orders(spark, sf_dir), tolerance=0.01))


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders read back from text by the types found in it."""
    rows = _text_orders(spark, sf_dir)
    out = types.typed(rows, types.infer_types(rows, tolerance=0.01))
    return out.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in out.dtypes))


STANDARD = ("Ship Date", "Sales Amount", "Quantity", "Company Name", "Brand", "Item Name", "Category", "Order Count", "Type", "p_name", "Segment Code", "key")
MAPPED = ("lineitem", "orders", "part", "customer", "supplier", "events")


def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of six tables that fit standard columns best."""
    out = columns.map_columns(spark, {t: table(spark, sf_dir, t) for t in MAPPED}, list(STANDARD))
    return out.withColumn("candidates", F.array_join("candidates", "|"))


QUERIES = {f.__name__: f for f in (similar_words, product_names, translated_names, brands_resolved, sku_master, order_types, typed_orders, column_mapping)}


def _case(x: str, words: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


def _values(words: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}', {r})" for r, (k, v) in enumerate(words.items()))


_PARTS = f"""parts AS (SELECT *, p_brand || ' ' || p_name || ' ' || {_case("p_type", TYPES)} || {_case("string_split(p_name, ' ')[-1]", NOUNS)} || ' ' || p_size || CASE WHEN p_size > 40 THEN 'g x2' ELSE ' 입' END AS name FROM part)"""
_WORDS = mastering.FORMS | {"큰컵": "Big Cup", "짜장": "Jjajang", "김치": "Kimchi", "치즈": "Cheese", "매운맛": "Spicy", "매운": "Spicy", "오리지널": "Original", "큰": "Big"}
#: Dictionary words taken out of every text of ``t (k, s)`` one rank after the other.
_FOLD = f"""d (word, english, rank) AS (VALUES {_values(_WORDS)}),
             fold AS (SELECT k, s, [] :: VARCHAR[] AS parts, 0 AS step FROM t
                      UNION ALL SELECT k, CASE WHEN contains(s, word) THEN replace(s, word, ' ') ELSE s END, CASE WHEN contains(s, word) THEN list_append(parts, english) ELSE parts END, step + 1 FROM fold JOIN d ON rank = step),
             folded AS (SELECT k, parts, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS rest FROM fold WHERE step = {len(_WORDS)})"""
_BRANDS = """b AS (SELECT p_type AS company, p_brand AS brand, max(p_retailprice) AS top, min(p_size) AS least, count(*) AS n FROM part GROUP BY ALL),
             common AS (SELECT DISTINCT brand FROM b WHERE least = 1)"""
_ENGLISH_BRAND = """CASE WHEN top > 1050 THEN upper(company[1]) || lower(company[2:]) || ' ' || replace(b.brand, '#', ' No. ')
                         WHEN b.brand = 'Brand#7' THEN 'Etc' WHEN n >= 12 THEN 'Seed ' || b.brand WHEN common.brand IS NOT NULL THEN 'Common Seed' ELSE b.brand END"""
_SLUG = "trim(upper(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g')), '_')"

ORACLE = {
    "similar_words": """
        WITH w AS (SELECT DISTINCT role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
             q AS (SELECT w AS asked FROM w WHERE role = 'user' AND w NOT IN (SELECT w FROM w WHERE role = 'assistant')),
             p AS (SELECT asked, w AS answer, 1 - levenshtein(asked, w) / greatest(length(asked), length(w)) AS ratio
                   FROM q JOIN w ON role = 'assistant' AND length(w) BETWEEN 0.8 * length(asked) AND 1.25 * length(asked))
        SELECT asked, arg_min(answer, (-ratio, answer)) AS answer, round(max(ratio), 4) AS ratio FROM p WHERE ratio >= 0.8 - 1e-9 GROUP BY asked""",
    "product_names": f"""
        WITH {_PARTS}, f (word, english, r) AS (VALUES {_values(mastering.FORMS)}), v (word, english, r) AS (VALUES {_values(mastering.FLAVOURS)}),
             b AS (SELECT p.p_partkey, p.name, arg_max(o.p_brand, length(o.p_brand)) AS brand FROM parts p JOIN (SELECT DISTINCT p_brand FROM part) o ON starts_with(p.name, o.p_brand) GROUP BY ALL),
             s AS (SELECT *, trim(substr(name, length(brand) + 1)) AS x, regexp_extract(trim(substr(name, length(brand) + 1)), '(?i)(\\d+(\\.\\d+)?\\s*(kg|g|ml|l|ℓ|개|입|팩|박스|포))([^\\pL\\pN_]|$)', 1) AS size FROM b),
             t AS (SELECT *, trim(CASE WHEN size = '' THEN x ELSE substr(x, 1, instr(x, size) - 1) || substr(x, instr(x, size) + length(size)) END) AS y FROM s),
             g AS (SELECT p_partkey, arg_min(word, (-length(word), r)) AS form FROM t JOIN f ON contains(y, word) GROUP BY p_partkey),
             u AS (SELECT t.*, form, trim(CASE WHEN form IS NULL THEN y ELSE replace(y, form, '') END) AS z FROM t LEFT JOIN g USING (p_partkey)),
             h AS (SELECT p_partkey, arg_min(word, (-length(word), r)) AS flavor FROM u JOIN v ON contains(z, word) GROUP BY p_partkey),
             w AS (SELECT u.*, flavor, nullif(trim(regexp_replace(CASE WHEN flavor IS NULL THEN z ELSE replace(z, flavor, '') END, '\\s+', ' ', 'g')), '') AS base FROM u LEFT JOIN h USING (p_partkey))
        SELECT p_partkey, brand, base AS base_product, flavor, form AS format, nullif(size, '') AS package_size, concat_ws(' ', brand, base, v.english, f.english, nullif(size, '')) AS english
        FROM w LEFT JOIN f ON f.word = form LEFT JOIN v ON v.word = flavor""",
    "translated_names": f"""
        WITH RECURSIVE {_PARTS}, t AS (SELECT p_partkey AS k, name AS s FROM parts), {_FOLD}
        SELECT k AS p_partkey, array_to_string(parts, '|') AS parts, rest, NOT regexp_matches(rest, '[가-힣]') AS known FROM folded""",
    "brands_resolved": f"""
        WITH {_BRANDS}
        SELECT p_partkey, CASE WHEN top > 1050 THEN company || ':' || b.brand ELSE CASE WHEN p_size > 25 THEN p_type ELSE 'UNKNOWN' END || '_' || {_SLUG.format(_ENGLISH_BRAND)} END AS brand_id,
               {_ENGLISH_BRAND} AS brand_en, CASE WHEN top > 1050 THEN lower(b.brand) || '|' || b.brand ELSE b.brand END AS aliases, top > 1050 OR b.brand = 'Brand#7' OR n >= 12 OR common.brand IS NOT NULL AS curated
        FROM part JOIN b ON company = p_type AND b.brand = p_brand LEFT JOIN common ON common.brand = p_brand""",
    "sku_master": f"""
        WITH RECURSIVE {_PARTS}, {_BRANDS}, m AS (SELECT b.*, {_ENGLISH_BRAND} AS english, common.brand IS NOT NULL OR top > 1050 OR b.brand = 'Brand#7' OR n >= 12 AS curated FROM b LEFT JOIN common ON common.brand = b.brand),
             t AS (SELECT p_partkey AS k, trim({_case("string_split(p_name, ' ')[-1]", NOUNS)} || ' ' || {_case("p_type", TYPES)} || ' ') AS s FROM part), {_FOLD},
             v AS (SELECT p_partkey, p_type, p_size, name, english, curated, rest, CASE WHEN top > 1050 THEN company || ':' || m.brand ELSE lower(p_type) || '_' || {_SLUG.format("english")} END AS brand_id,
                          list_filter(string_split(array_to_string(list_append(list_filter(parts, lambda y, i: list_position(parts, y) = i), replace(replace(rest, '신제품', 'Sinjepum'), '순한맛', 'Sunhanmas')), ' '), ' '), lambda w: w <> '' AND NOT list_contains(string_split(lower(english), ' '), lower(w))) AS words,
                          CASE WHEN contains(name, '캔') THEN 'Can' WHEN contains(name, '병') THEN 'Bottle' WHEN contains(name, '봉지') THEN 'Bag' WHEN contains(name, '큰사발') THEN 'Big Bowl' WHEN contains(name, '사발') THEN 'Bowl' WHEN contains(name, '큰컵') THEN 'Big Cup' WHEN contains(name, '컵') THEN 'Cup' END AS form
                   FROM parts JOIN m ON m.company = p_type AND m.brand = p_brand JOIN folded ON k = p_partkey),
             x AS (SELECT *, array_to_string(words, ' ') AS variant FROM v),
             y AS (SELECT p_partkey, english, curated, NOT regexp_matches(rest, '[가-힣]') AS known,
                          concat_ws(' ', english, nullif(variant, ''), CASE WHEN NOT contains(lower(variant), lower(form)) THEN form END, CASE WHEN p_size > 25 THEN p_size || 'g' END, CASE WHEN p_size > 40 THEN '2-Pack' END) AS sku_name_en,
                          concat_ws('_', brand_id, nullif({_SLUG.format("variant")}, ''), CASE WHEN contains(name, '큰사발') THEN 'BIGBOWL' WHEN contains(name, '큰컵') THEN 'BIGCUP' WHEN contains(name, '사발') THEN 'BOWL' WHEN form = 'Can' THEN 'CAN' WHEN form = 'Bottle' THEN 'BTL' WHEN form = 'Bag' THEN 'BAG' ELSE 'NA' END, CASE WHEN p_size > 40 THEN '2P' END) AS sku_slug FROM x)
        SELECT p_partkey AS barcode, p_partkey :: VARCHAR AS sku_id, sku_name_en, sku_slug, CASE WHEN curated AND known THEN 'high' WHEN curated THEN 'medium' ELSE 'low' END AS mapping_confidence,
               CASE WHEN curated AND known THEN 'verified' WHEN curated THEN 'auto_mapped' ELSE 'needs_review' END AS mapping_status,
               sku_slug || coalesce('__' || nullif(row_number() OVER (PARTITION BY sku_slug ORDER BY p_partkey), 1), '') AS code FROM y""",
    "order_types": """
        WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS open, count(*) FILTER (o_totalprice <= 1000) AS small FROM orders)
        SELECT unnest(['key', 'customer', 'day', 'month', 'closed', 'price', 'won', 'filled', 'priority', 'mixed']) AS column,
               unnest(['long', 'string', 'date', 'date', 'date', 'double', 'long', 'boolean', 'string', CASE WHEN small <= 0.01 * n THEN 'date' ELSE 'string' END]) AS kind,
               unnest([NULL, NULL, 'yyyyMMdd', 'yyyyMM', 'yyyy/MM/dd', NULL, NULL, NULL, NULL, CASE WHEN small <= 0.01 * n THEN 'yyyy-MM-dd' END]) AS form, n AS rows,
               unnest([0, 0, 0, 0, open, 0, 0, 0, 0, 0]) AS nulls, unnest([0, 0, 0, 0, 0, 0, 0, 0, 0, CASE WHEN small <= 0.01 * n THEN small ELSE 0 END]) AS unread FROM n""",
    "typed_orders": """
        SELECT o_orderkey AS key, lpad(o_custkey :: VARCHAR, 8, '0') AS customer, o_orderdate :: DATE :: VARCHAR AS day, date_trunc('month', o_orderdate) :: DATE :: VARCHAR AS month,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate :: DATE :: VARCHAR END AS closed, round_even(o_totalprice, 2) AS price, floor(o_totalprice) :: BIGINT AS won, o_orderstatus = 'F' AS filled,
               o_orderpriority AS priority, CASE WHEN o_totalprice > 1000 THEN o_orderdate :: DATE :: VARCHAR END AS mixed FROM orders""",
    "column_mapping": f"""
        WITH RECURSIVE c AS (SELECT table_name AS t, column_index AS j, column_name AS r, replace(lower(column_name), '_', '') AS b, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'object' END AS d
                   FROM duckdb_columns() WHERE table_name IN {MAPPED}),
             s (i, s, kind) AS (VALUES (0, 'Ship Date', 'date'), (1, 'Sales Amount', 'amount'), (2, 'Quantity', 'quantity'), (3, 'Company Name', 'company'), (4, 'Brand', 'brand'), (5, 'Item Name', 'sku'), (6, 'Category', 'category'), (7, 'Order Count', 'count'), (8, 'Type', 'category'), (9, 'p_name', 'text'), (10, 'Segment Code', 'category'), (11, 'key', 'text')),
             k (kind, pattern, numeric, named) AS (VALUES ('date', 'date|day|ymd', false, false), ('amount', 'amount|amt|revenue|sales|value|price', true, false), ('quantity', 'qty|quantity|ea', true, false), ('count', 'count|cnt|numberoftx|ntx', true, false), ('company', 'company|corp|client|vendor|accountname|grpacnt', false, true),
                   ('brand', 'brand|maker|grpitem', false, true), ('sku', 'sku|item|product|goods', false, true), ('category', 'cate|genre|type|class|lrcl|mdcl|smcl|sector|industry|segment', false, true), ('text', '^\\b$x', false, false)),
             f AS (SELECT t, i, s, s.kind, j, r, replace(lower(s), ' ', '') AS z, regexp_matches(b, pattern) AS hit, CASE WHEN numeric THEN d IN ('int', 'float') WHEN named THEN d = 'object' ELSE s.kind = 'date' AND d = 'datetime' END AS fits,
                          replace(replace(lower(s), ' ', ''), '_', '') AS a, b, CASE WHEN named AND r LIKE '%\\_name' ESCAPE '\\' THEN 15 ELSE 0 END AS bonus FROM c, s JOIN k USING (kind)),
             p AS (SELECT *, CASE WHEN a = b THEN 100 WHEN hit AND (contains(a, b) OR contains(b, a)) THEN 80 + 5 * fits :: INT + bonus WHEN hit THEN 60 + 5 * fits :: INT + bonus WHEN contains(a, b) OR contains(b, a) THEN 30 + 10 * fits :: INT + bonus WHEN fits THEN 10 + bonus ELSE 0 END AS score FROM f),
             g AS (SELECT DISTINCT t, 0 AS step, [] :: INT[] AS si, [] :: INT[] AS sj, NULL :: INT AS i, NULL :: VARCHAR AS r, NULL :: INT AS score FROM c
                   UNION ALL SELECT t, step + 1, list_append(si, best.i), list_append(sj, best.j), best.i, best.r, best.score
                   FROM g, LATERAL (SELECT p.i, p.j, p.r, p.score FROM p WHERE p.t = g.t AND p.score > 0 AND NOT list_contains(g.si, p.i) AND NOT list_contains(g.sj, p.j) ORDER BY p.score DESC, p.i, p.j LIMIT 1) best),
             n AS (SELECT t, i, array_to_string(list(r ORDER BY score DESC, j)[1:5], '|') AS candidates FROM p WHERE score > 0 GROUP BY ALL)
        SELECT tabs.t AS "table", s AS std_col, kind, g.r AS raw_col, coalesce(g.score, 0) AS score, coalesce(candidates, '') AS candidates
        FROM (SELECT DISTINCT t FROM c) tabs CROSS JOIN s LEFT JOIN g ON g.t = tabs.t AND g.i = s.i LEFT JOIN n ON n.t = tabs.t AND n.i = s.i""",
}
