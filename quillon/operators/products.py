"""What product names, security codes and company names say: sizes, packs and forms, valid codes, name tokens, Latin spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.text import isin_check_digit

# Package forms by category and by word of the name (the first word that occurs), words that promotions add,
# units, words that end company names, and abbreviations in company names.
CATEGORY_FORMS = {"봉지면": "Bag", "용기면": "Cup/Bowl", "캔": "Can", "병": "Bottle", "페트": "PET", "팩": "Pack"}
NAME_FORMS = {
    "미니캔": "Mini Can", "소캔": "Small Can", "캔": "Can", "페트": "PET", "병": "Bottle", "봉지": "Bag", "큰사발": "Big Bowl", "사발": "Bowl",
    "소컵": "Small Cup", "큰컵": "Big Cup", "컵": "Cup",
}
NAME_WORDS = ("사발면", "용기", "큰", "면")
PROMOTIONS = ("행사", "증정", "기획", "묶음", "할인", "단독", "특가")
UNITS = {"ml": "ml", "l": "L", "리터": "L", "g": "g", "kg": "kg"}
COMPANY_ENDINGS = ("co", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "company", "plc", "kg", "ag", "sa", "nv", "se")
ABBREVIATIONS = {
    "elec": "electronics", "elecmech": "electromechanics", "mech": "mechanics", "mtr": "motor", "hldgs": "holdings", "hldg": "holdings",
    "fingrp": "financialgroup", "fin": "financial", "grp": "group", "tel": "telecom", "telecom": "telecom", "innov": "innovation",
    "bio": "biologics", "biosci": "bioscience", "sec": "securities", "aero": "aerospace", "sys": "systems", "intl": "international",
    "corp": "corporation", "inc": "incorporated", "co": "company", "ltd": "limited", "ent": "enterprise", "ind": "industries", "constr": "construction",
}
# The letters of Hangul syllables in Latin script, in the order of their code points.
LEADS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
TAILS = ("", "g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h")

_SIZE = r"(?i)(\d+(?:\.\d+)?)\s*(ml|l|리터|g|kg)"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def pack_count(name: Column) -> Column:
    """Pieces of a pack (5입, 4개입, else *6); 1 without a mark."""
    found = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    return F.coalesce(found(r"(\d+)\s*(?:개입|입)"), found(r"\*\s*(\d+)"), F.lit(1))


def size_value(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, _SIZE, 1), F.lit(""))


def size_unit(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(UNITS), F.lower(F.regexp_extract(name, _SIZE, 2))), F.lit(""))


def without_company(name: Column) -> Column:
    """The name without what stands before its first closing parenthesis."""
    return F.trim(F.regexp_replace(name, r"^[^)]*\)", ""))


def package_form(category: Column, name: Column) -> Column:
    form = F.element_at(_map(CATEGORY_FORMS), F.coalesce(category, F.lit("")))
    by_word = F.coalesce(*(F.when(F.contains(name, F.lit(word)), form_) for word, form_ in NAME_FORMS.items()))
    return F.coalesce(form, by_word, F.lit("Unknown"))


def family(name: Column, brand: Column) -> Column:
    return F.when(F.coalesce(brand, F.lit("")) != "", brand).otherwise(without_company(name))


def variant(name: Column, brand: Column) -> Column:
    """What is left of a name without company, brand, pack, size, package words and numbers."""
    base, brand = without_company(name), F.coalesce(brand, F.lit(""))
    at = F.when(brand != "", F.instr(base, brand)).otherwise(0)
    base = F.when(at > 0, F.overlay(base, F.lit(""), at, F.length(brand))).otherwise(base)
    for pattern in (r"(\d+)\s*(?:개입|입)", r"\*\s*(\d+)", _SIZE):
        base = F.regexp_replace(base, pattern, "")
    for word in (*NAME_FORMS, *NAME_WORDS):
        base = F.replace(base, F.lit(word), F.lit(""))
    return spaced(F.regexp_replace(F.regexp_replace(base, r"\((구|신)\)", ""), r"\d+", " "))


def sku_attributes(df: DataFrame, name: str, brand: str, category: str, amount: str, quantity: str) -> DataFrame:
    """``df`` with what its products' names say, and ``asp``, the price of a piece (null without a positive quantity)."""
    n, b = F.coalesce(F.col(name), F.lit("")), F.col(brand)
    price = F.round(F.try_divide(F.col(amount), F.when(F.col(quantity) > 0, F.col(quantity))), 0)
    columns = {
        "pack_count": pack_count(n), "is_multipack": pack_count(n) > 1, "size_value": size_value(n), "size_unit": size_unit(n),
        "package_form": package_form(F.col(category), n), "family": family(n, b), "variant": variant(n, b), "asp": price,
    }
    return df.withColumns(columns)


def clean_name(x: Column) -> Column:
    """Separators and brackets as spaces, forms of packs as N-Pack, single spaces."""
    x = spaced(F.regexp_replace(F.regexp_replace(x, r"[/_\-·]+", " "), r"[()\[\]{}]", " "))
    return spaced(F.regexp_replace(x, r"(?i)(\d+)\s*(?:개입|입|개|p|pack|팩)(?![\p{L}\p{N}_])", "$1-Pack"))


def promotions(x: Column) -> Column:
    """The words of promotions that occur in the name; none in a null name."""
    return F.filter(F.array(*map(F.lit, PROMOTIONS)), lambda word: F.contains(x, word))


def without_promotions(x: Column) -> Column:
    return spaced(F.regexp_replace(x, "|".join(PROMOTIONS), " "))


def romanized(x: Column) -> Column:
    """Hangul syllables in Latin letters, other characters as they are, words with a capital first letter."""
    pick = lambda letters, i: F.element_at(F.array(*map(F.lit, letters)), (i + 1).cast("int"))

    def spell(c: Column) -> Column:
        s = F.ascii(c) - 0xAC00
        return F.when(s.between(0, 11171), F.concat(pick(LEADS, F.floor(s / 588)), pick(VOWELS, F.floor(s % 588 / 28)), pick(TAILS, s % 28))).otherwise(c)

    return F.initcap(spaced(F.array_join(F.transform(F.split(x, ""), spell), "")))


def isin_valid(x: Column) -> Column:
    """Whether twelve letters and digits end in their check digit; null is not valid."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike("^[A-Za-z0-9]{11}[0-9]$"), isin_check_digit(F.upper(F.substring(x, 1, 11))).cast("string") == F.substring(x, 12, 1)).otherwise(False)


def isin_fixed(x: Column) -> Column:
    """Twelve letters and digits with the right check digit; others give null."""
    body = F.substring(x, 1, 11)
    return F.when(x.rlike("^[A-Za-z0-9]{12}$"), F.concat(body, isin_check_digit(F.upper(body)).cast("string")))


def name_tokens(x: Column) -> Column:
    """Lower-case words of a company's name, split at punctuation and capitals, without the forms of companies at its end."""
    x = F.regexp_replace(F.trim(x), r"[,&/\-_.()]+", " ")
    x = F.lower(spaced(F.regexp_replace(x, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")))
    x = F.trim(F.regexp_replace(F.concat(F.lit(" "), x), f"( (?:{'|'.join(COMPANY_ENDINGS)}))+$", ""))
    return F.filter(F.split(x, " "), lambda t: t != "")


def _expanded(tokens: Column) -> Column:
    long = _map(ABBREVIATIONS)
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(long, t), t))


def letters_only(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9가-힣]+", "")


def name_variants(x: Column) -> Column:
    """Spellings of a company's name as one word: with abbreviations written out, and as it stands."""
    t = name_tokens(x)
    joined = F.array(letters_only(F.array_join(_expanded(t), "")), letters_only(F.array_join(t, "")))
    return F.array_distinct(F.filter(joined, lambda v: v != ""))


def token_set(x: Column) -> Column:
    """The distinct words of a company's name, and what abbreviations among them stand for."""
    t = name_tokens(x)
    return F.array_distinct(F.concat(t, _expanded(t)))
