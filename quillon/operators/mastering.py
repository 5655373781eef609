"""Masters of products and brands from dictionaries that are tables: names taken apart, translated, put together and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import products

HANGUL = "[가-힣]"


def _met(names: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """``__s`` and the columns of ``words`` whose ``word`` occurs in it. The strings inside a name that are as long as some word
    are joined with the words by equality, so that only what occurs meets. The join is by merging: Spark takes the strings' size
    from before they are exploded, and would send them all through the driver."""
    lengths = sorted(r[0] for r in words.select(F.length(word)).distinct().collect())  # as many as the longest word has letters at most
    sizes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length("__s"))
    inside = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length("__s") - k + 1), lambda i: F.substring(F.col("__s"), i, k))))
    pieces = names.select("__s", F.explode(F.array_distinct(inside)).alias("__w"))
    return pieces.hint("merge").join(words, F.col("__w") == F.col(word)).drop("__w")


def translated(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with ``parts``, ``rest`` and ``known``: the words of ``dictionary`` (``word, english, rank``; one row per word, no spaces in it) that
    occur in the text are taken out one after the other by rank, every time they occur, and leave a space; a word whose letters
    an earlier one took is not there any more. ``parts``: what they stand for, in that order; ``rest``: what is left, with single
    spaces; ``known``: no Hangul is left. Null texts count as empty. Every distinct text is looked up once."""
    names = df.select(F.coalesce(F.trim(column), F.lit("")).alias("__s")).distinct()
    words = dictionary.where("length(word) > 0").select("rank", "word", "english")
    found = _met(names.where("length(__s) > 0"), words, "word").groupBy("__s").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "english"))).alias("ws"))
    start = F.struct(F.col("__s").alias("s"), F.array().cast("array<string>").alias("parts"))
    taken = F.aggregate(
        "ws", start,
        lambda t, w: F.when(F.contains(t["s"], w["word"]), F.struct(F.replace(t["s"], w["word"], F.lit(" ")).alias("s"), F.concat(t["parts"], F.array(w["english"])).alias("parts"))).otherwise(t),
    )
    folded = found.select("__s", taken.alias("t"))
    out = df.withColumn("__k", F.coalesce(F.trim(column), F.lit(""))).join(folded, F.col("__k") == F.col("__s"), "left")
    rest = F.trim(F.regexp_replace(F.coalesce("t.s", "__k"), r"\s+", " "))
    return out.withColumns({"parts": F.coalesce("t.parts", F.array().cast("array<string>")), "rest": rest, "known": ~rest.rlike(HANGUL)}).drop("__s", "__k", "t")


def english_variant(parts: Column, rest: Column) -> Column:
    """The distinct parts, then what is left (in Latin letters), with spaces between them."""
    left = F.when(rest.rlike(HANGUL), products.romanized(rest)).otherwise(rest)
    all_ = F.transform(F.concat(parts, F.array(left)), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(all_, lambda x: x != "")), " ")


def slug(x: Column) -> Column:
    """Latin letters and digits in capitals, runs of anything else as one underscore, none at the ends."""
    return F.regexp_replace(F.upper(F.regexp_replace(x, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")


def resolve_brands(df: DataFrame, company: str, brand: str, company_slug: str, master: DataFrame, special: DataFrame, seeds: DataFrame) -> DataFrame:
    """``df`` with ``brand_id, brand_en, aliases`` and ``curated`` of each (company, brand), by the first that knows it: ``master``
    (``company, brand, id, english, aliases``), ``special`` (``brand, english``: totals and the like), ``seeds`` (``company, brand, english``) of
    the company, then those of any company (null company); else Latin letters, not curated. Ids that no master gives are the
    company's slug (or UNKNOWN) and the name's. Of rows of a table with one key the first id, then English name, counts."""
    none = F.lit(None).cast("string")
    listed = F.array().cast("array<string>")
    rule = lambda t, rank, company_, brand_, id_, english, aliases: t.select(F.lit(rank).alias("rank"), company_.alias("__c"), brand_.alias("__b"), id_.alias("id"), english.alias("english"), aliases.alias("aliases"))
    c, b = F.col("company"), F.col("brand")
    rules = rule(master, 1, c, b, F.col("id"), F.col("english"), F.coalesce("aliases", listed)).unionByName(rule(special, 2, none, b, none, F.col("english"), listed))
    rules = rules.unionByName(rule(seeds.where("company IS NOT NULL"), 3, c, b, none, F.col("english"), listed)).unionByName(rule(seeds.where("company IS NULL"), 4, none, b, none, F.col("english"), listed))
    first = rules.where("__b IS NOT NULL").groupBy("__c", "__b", "rank").agg(F.min(F.struct("id", "english", "aliases")).alias("r")).select("__c", "__b", "rank", "r.*")
    keys = df.select(F.col(company).alias("__co"), F.coalesce(brand, F.lit("")).alias("__br")).distinct()
    # special names may have spaces around them; the others are taken as they stand
    tried = keys.select("__co", "__br", F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), (F.col("__co") if own else none).alias("__c"), (F.trim("__br") if r == 2 else F.col("__br")).alias("__b")) for r, own in ((1, True), (2, False), (3, True), (4, False))))).alias("p"))
    asked = tried.select("__co", "__br", F.col("p.rank").alias("r_"), F.col("p.__c").alias("c_"), F.col("p.__b").alias("b_"))
    hit = asked.join(first, (F.col("b_") == F.col("__b")) & (F.col("r_") == F.col("rank")) & F.col("c_").eqNullSafe(F.col("__c")))
    best = hit.groupBy("__co", "__br").agg(F.min(F.struct("rank", "id", "english", "aliases")).alias("m"))
    out = df.withColumns({"__x": F.col(company), "__y": F.coalesce(brand, F.lit(""))}).join(best, F.col("__x").eqNullSafe(F.col("__co")) & (F.col("__y") == F.col("__br")), "left")
    english = F.coalesce("m.english", F.nullif(products.romanized(F.col("__y")), F.lit("")), "__y")
    own = F.concat(F.coalesce(F.nullif(F.col(company_slug), F.lit("")), F.lit("UNKNOWN")), F.lit("_"), slug(english))
    return out.withColumns({"brand_id": F.coalesce("m.id", own), "brand_en": english, "aliases": F.concat(F.coalesce("m.aliases", listed), F.array("__y")), "curated": F.col("m").isNotNull()}).drop("__x", "__y", "__co", "__br", "m")


#: Labels of package forms, their codes, and words of a name that make a code finer (the first that occurs counts).
PACKAGE_CODES = {"Bag": "BAG", "Cup/Bowl": "CUP", "Can": "CAN", "Bottle": "BTL", "PET": "PET", "Pack": "PCK", "Unknown": "NA"}
FINER_CODES = {"큰사발": "BIGBOWL", "큰컵": "BIGCUP", "소컵": "SMALLCUP", "사발": "BOWL", "큰": "BIG"}


def _mapped(x: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), x), F.lit(other))


def sku_master(df: DataFrame, dictionary: DataFrame, master: DataFrame, special: DataFrame, seeds: DataFrame) -> DataFrame:
    """``df`` (``company, brand, company_slug, sku_name, variant, package_format, pack_count, size_value, size_unit, barcode``) with its brand (see
    ``resolve_brands``), ``sku_id`` (the barcode), ``sku_name_en``, ``sku_slug``, ``mapping_confidence`` and ``mapping_status``. The English variant leaves
    out the brand's words and the count of a multipack, which the name states at its end."""
    rows = resolve_brands(df, "company", "brand", "company_slug", master, special, seeds)
    rows = translated(rows.withColumn("__v", F.regexp_replace(F.coalesce("variant", F.lit("")), r"(\d+)\s*입", "")), "__v", dictionary)
    words = F.split(english_variant(F.col("parts"), F.col("rest")), " ")
    own = F.split(F.lower("brand_en"), " ")
    variant = F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(own, F.lower(w))), " ")
    pack, form = F.coalesce("pack_count", F.lit(1)), F.coalesce("package_format", F.lit(""))
    label = F.when(form == "Cup/Bowl", "Cup").otherwise(form)
    named = (form != "") & (form != "Unknown") & ~F.contains(F.lower(variant), F.lower(label))
    size = F.when(F.length("size_value") > 0, F.concat("size_value", F.coalesce("size_unit", F.lit(""))))
    several = F.when(pack > 1, F.concat(pack.cast("string"), F.lit("-Pack")))
    english = F.concat_ws(" ", F.nullif(F.col("brand_en"), F.lit("")), F.nullif(variant, F.lit("")), F.when(named, label), size, several)
    finer = F.coalesce(*(F.when(F.contains("sku_name", F.lit(w)), code) for w, code in FINER_CODES.items()), _mapped(form, PACKAGE_CODES, "NA"))
    code = F.concat_ws("_", "brand_id", F.nullif(slug(variant), F.lit("")), finer, F.when(pack > 1, F.concat(pack.cast("string"), F.lit("P"))))
    sure = F.when(F.col("curated") & F.col("known"), "high").when(F.col("curated"), "medium").otherwise("low")
    status = F.when(F.col("curated") & F.col("known"), "verified").when(F.col("curated"), "auto_mapped").otherwise("needs_review")
    latin = F.when(english.rlike(HANGUL), products.romanized(english)).otherwise(english)
    return rows.withColumns({"sku_id": F.col("barcode").cast("string"), "sku_name_en": latin, "sku_slug": code, "mapping_confidence": sure, "mapping_status": status}).drop("__v", "parts", "rest", "known")


def allocate_ids(rows: DataFrame, key: str, name: str, given: DataFrame | None = None) -> DataFrame:
    """``key, name, id``: an id for every distinct ``key``, made of its name; keys that share a name get the endings ``__2, __3, ...`` in
    the order of the keys (slugs hold no two underscores in a row, so that endings can't be taken for names). Ids in ``given`` (an earlier result) stay as they are, whatever rows come or go, and new keys get the
    endings after the highest that their name has had. A key with several names has the smallest; null keys get no id. Keys are
    ranked within their name: a name that very many keys share is ordered in one task, as its numbers depend on one another."""
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.coalesce(name, F.lit(""))).alias("name"))
    if given is None:
        given = one.sparkSession.createDataFrame([], one.schema.add("id", "string"))
    given = given.select("key", "name", "id")
    new = one.join(given.select("key"), "key", "left_anti")
    ending = F.regexp_extract("id", r"__(\d+)$", 1).try_cast("int")
    plain = F.col("id") == F.col("name")
    used = given.groupBy("name").agg(F.max(F.when(plain, 1).otherwise(F.coalesce(ending, F.lit(1)))).alias("used"))
    placed = new.join(used, "name", "left").withColumn("n", F.coalesce("used", F.lit(0)) + F.row_number().over(W.partitionBy("name").orderBy("key")))
    made = placed.select("key", "name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("__"), F.col("n").cast("string"))).alias("id"))
    return given.unionByName(made)


#: Package forms and flavours of product names, and what they are in English.
FORMS = {
    "큰사발면": "Big Bowl", "큰사발": "Big Bowl", "사발면": "Bowl Noodle", "사발": "Bowl", "컵라면": "Cup Noodle", "컵": "Cup", "봉지": "Bag", "용기": "Container",
    "팩": "Pack", "박스": "Box", "캔": "Can", "병": "Bottle",
}
FLAVOURS = {
    "매운맛": "Spicy", "순한맛": "Mild", "오리지널": "Original", "김치": "Kimchi", "치즈": "Cheese", "불고기": "Bulgogi", "해물": "Seafood", "치킨": "Chicken",
    "양념": "Seasoned", "짜장": "Jajang", "카레": "Curry", "된장": "Doenjang", "고추장": "Gochujang", "굴": "Oyster", "새우": "Shrimp",
}
#: A fixed value: the pattern of a package's size.
SIZE = r"(?iU)\d+(?:\.\d+)?\s*(?:g|kg|ml|l|ℓ|개|입|팩|박스|포)\b"


def _longest(x: Column, words: dict[str, str]) -> Column:
    """The longest of the words that occurs in x (of equally long ones the first listed), else null."""
    return F.coalesce(*(F.when(F.contains(x, F.lit(w)), F.lit(w)) for w in sorted(words, key=len, reverse=True)))


def parse_product_names(df: DataFrame, column: str, brands: DataFrame) -> DataFrame:
    """``df`` with ``brand, base_product, flavor, format`` and ``package_size`` of the product names in ``column``, null where there is none. One part
    after the other is found and taken out: the longest name of ``brands`` (``brand``) that the text begins with, the first size,
    the longest package form, the longest flavour; what is left is the product. Names meet brands by their beginnings, which are
    joined by equality."""
    names = df.select(F.trim(column).alias("__s")).where("length(__s) > 0").distinct()
    known = brands.where("length(brand) > 0").select("brand").distinct()
    most = known.agg(F.max(F.length("brand"))).first()[0] or 1
    starts = names.select("__s", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("__s"), F.lit(most))), lambda k: F.left(F.col("__s"), k))).alias("__p"))
    owned = starts.hint("merge").join(known, F.col("__p") == F.col("brand")).groupBy("__s").agg(F.max_by("brand", F.length("brand")).alias("brand"))
    cut = lambda x, w: F.when(w.isNull(), x).otherwise(F.trim(F.replace(x, w, F.lit(""))))
    out = names.join(owned, "__s", "left").withColumn("x", F.when(F.col("brand").isNull(), F.col("__s")).otherwise(F.trim(F.substring(F.col("__s"), F.length("brand") + 1, F.length("__s")))))
    out = out.withColumn("package_size", F.nullif(F.regexp_extract("x", SIZE, 0), F.lit("")))
    at = F.instr("x", F.col("package_size"))
    out = out.withColumn("x", F.when(F.col("package_size").isNull(), F.col("x")).otherwise(F.trim(F.concat(F.left("x", at - 1), F.substring(F.col("x"), at + F.length("package_size"), F.length("x"))))))
    out = out.withColumn("format", _longest(F.col("x"), FORMS)).withColumn("x", cut(F.col("x"), F.col("format")))
    out = out.withColumn("flavor", _longest(F.col("x"), FLAVOURS)).withColumn("x", cut(F.col("x"), F.col("flavor")))
    out = out.withColumn("base_product", F.nullif(F.trim(F.regexp_replace("x", r"\s+", " ")), F.lit("")))
    return df.join(out.select("__s", "brand", "base_product", "flavor", "format", "package_size"), F.trim(column) == F.col("__s"), "left").drop("__s")


def assemble_english(brand: Column, base: Column, flavor: Column, form: Column, size: Column) -> Column:
    """The English name of a product from its parts: brand, product, flavour, package form and size, those that there are."""
    spoken = lambda x, words: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in words.items() for v in kv)), x), x)
    return F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in (brand, base, spoken(flavor, FLAVOURS), spoken(form, FORMS), size)))
