"""Similar spellings, dictionaries, product names and masters on odd tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import mastering, registry, similar


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.9, 1.0])
def test_similar_pairs_by_brute_force(spark, cutoff):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 13)))
    left, right = ([word() for _ in range(70)] for _ in "ab")
    left += [None, "", right[0], left[0], "aaaaaaaaaa", "a" * 40]
    right += [None, "", "aaaaaaaaab", "aaaaaaaa", "a" * 36 + "bbbb", right[1]]
    got = similar.similar_pairs(spark.createDataFrame([(x, 1) for x in left], "x string, n int"), "x", spark.createDataFrame([(x,) for x in right], "x string"), "x", cutoff)
    want = {(a, b, d) for a in left if a for b in right if b for d in [_distance(a, b)] if 1 - d / max(len(a), len(b)) >= cutoff - 1e-9}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_words_of_the_same_syllables_do_not_meet(spark, monkeypatch):
    """Up to round 3 strings met by an equal half, so that candidates grew with the square of a vocabulary made of syllables."""
    rnd = random.Random(8)
    ends = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 4)) for _ in range(400)]
    left, right = (spark.createDataFrame([("tion" + x,) for x in part] + [("tionsome" + x,) for x in part], "x string") for part in (ends[:200], ends[200:]))
    near = similar.similar_pairs(left, "x", right, "x").count()
    monkeypatch.setattr(F, "levenshtein", lambda a, b: F.lit(0))  # lets all candidates through
    assert near <= similar.similar_pairs(left, "x", right, "x").count() < 12_000


def test_closest_ties_and_bounds(spark):
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "s string")
    got = {r.a: (r.b, r.ratio) for r in similar.closest(t("abcde", "zz"), "s", t("abcdx", "abcda", "qq"), "s").collect()}
    assert got == {"abcde": ("abcda", 0.8)}
    assert similar.closest(t(), "s", t("a"), "s").count() == 0 == similar.closest(t("a"), "s", t(), "s").count()
    with pytest.raises(ValueError):
        similar.similar_pairs(t("a"), "s", t("a"), "s", 0.5)


def test_identify_by_similar_spelling(spark):
    held = spark.createDataFrame(
        [("000001", "KR7000001000", "00000001", "삼성전자", "Samsung Electronics"), ("000002", None, None, "한국전력공사", "Korea Electric Power"), ("000003", None, None, None, None)],
        "code string, isin string, corp string, name_kr string, name_en string",
    )
    asked = spark.createDataFrame([("Samsnug Electronics",), ("한국전역공사",), ("000001.KS",), ("nothing like it",), (None,)], "q string")
    got = {r.q: (r.code, r.how) for r in registry.identify(asked, "q", held, 0.8).collect()}
    assert got == {"Samsnug Electronics": ("000001", "similar"), "한국전역공사": ("000002", "similar"), "000001.KS": ("000001", "ric"), "nothing like it": (None, None), None: (None, None)}
    assert {r.how for r in registry.identify(asked, "q", held).collect()} == {"ric", None}


def test_translated_takes_words_by_rank(spark):
    words = spark.createDataFrame([("큰사발면", "Big Bowl", 0), ("사발", "Bowl", 1), ("김치", "Kimchi", 2), ("큰", "Big", 3), ("", "none", 4)], "word string, english string, rank int")
    names = ["큰사발면", "김치사발 큰 김치", "사발큰x", "라면", "abc", "", None, "  김 치 "]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate([*names, names[0]])], "i int, name string, word string")
    got = {r.i: (list(r.parts), r.rest, r.known) for r in mastering.translated(df, "name", words).collect()}
    one = (["Big Bowl"], "", True)
    assert got == {0: one, 1: (["Bowl", "Kimchi", "Big"], "", True), 2: (["Bowl", "Big"], "x", True), 3: ([], "라면", False), 4: ([], "abc", True), 5: ([], "", True), 6: ([], "", True), 7: ([], "김 치", False), 8: one}
    assert mastering.translated(df, "name", words.limit(0)).where("size(parts) > 0").count() == 0
    english = mastering.translated(df, "name", words).select("i", mastering.english_variant(F.col("parts"), F.col("rest")).alias("e"))
    assert {r.i: r.e for r in english.collect()}[3] == "Ramyeon"


def test_brands_by_the_first_rule_that_knows_them(spark):
    master = spark.createDataFrame([("A", "x", "A_X", "Xen", ["ex"]), ("A", "x", "A_Z", "Zen", None)], "company string, brand string, id string, english string, aliases array<string>")
    special = spark.createDataFrame([("전체", "Total"), ("x", "Etc")], "brand string, english string")
    seeds = spark.createDataFrame([("A", "y", "Own y!"), (None, "y", "Any y"), (None, "x", "Any x")], "company string, brand string, english string")
    rows = [("A", "x", "a"), ("B", "x", "b"), ("A", "y", "a"), ("B", "y", None), ("B", " 전체 ", ""), (None, "y", "n"), ("C", "라면", "c"), ("C", None, "c")]
    df = spark.createDataFrame([*rows, rows[0]], "company string, brand string, slug string")
    out = mastering.resolve_brands(df, "company", "brand", "slug", master, special, seeds).collect()
    got = {(r.company, r.brand): (r.brand_id, r.brand_en, list(r.aliases), r.curated) for r in out}
    assert len(out) == 9 and got == {
        ("A", "x"): ("A_X", "Xen", ["ex", "x"], True), ("B", "x"): ("b_ETC", "Etc", ["x"], True), ("A", "y"): ("a_OWN_Y", "Own y!", ["y"], True), ("B", "y"): ("UNKNOWN_ANY_Y", "Any y", ["y"], True),
        ("B", " 전체 "): ("UNKNOWN_TOTAL", "Total", [" 전체 "], True), (None, "y"): ("n_ANY_Y", "Any y", ["y"], True), ("C", "라면"): ("c_RAMYEON", "Ramyeon", ["라면"], False), ("C", None): ("c_", "", [""], False),
    }


def test_ids_stay_when_rows_come_and_go(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "k long, name string")
    first = mastering.allocate_ids(rows((5, "A"), (3, "A"), (9, "B"), (9, "B"), (None, "B"), (4, None)), "k", "name")
    got = {r.key: r.id for r in first.collect()}
    assert got == {3: "A", 5: "A__2", 9: "B", 4: ""}
    again = {r.key: r.id for r in mastering.allocate_ids(rows((1, "A"), (5, "A"), (2, "A"), (7, "C"), (9, "renamed")), "k", "name", first).collect()}
    assert again == got | {1: "A__3", 2: "A__4", 7: "C"} and len(set(again.values())) == len(again)
    assert mastering.allocate_ids(rows().limit(0), "k", "name").count() == 0


def test_product_names_apart_and_together(spark):
    names = {
        "농심 신라면 큰사발면 86g": ("농심", "신라면", None, "큰사발면", "86g"), "오뚜기 진라면 매운맛 5입": ("오뚜기", "진라면", "매운맛", None, "5입"),
        "비비고 왕교자 1kg": ("비비고", "왕교자", None, None, "1kg"), "비비고왕 새우 김치": ("비비고왕", "새우", "김치", None, None), "12gx 컵": (None, "12gx", None, "컵", None),
        "농심": ("농심", None, None, None, None), "  ": (None,) * 5, "": (None,) * 5, None: (None,) * 5, "1.5 L 병": (None, None, None, "병", "1.5 L"),
    }
    df = spark.createDataFrame([(n,) for n in [*names, "농심"]], "name string")
    brands = spark.createDataFrame([("농심",), ("비비고",), ("비비고왕",), ("오뚜기",), (None,), ("",)], "brand string")
    out = mastering.parse_product_names(df, "name", brands)
    rows = out.select("*", mastering.assemble_english(*(F.col(c) for c in ("brand", "base_product", "flavor", "format", "package_size"))).alias("e")).collect()
    assert len(rows) == 11 and {r.name: tuple(r)[1:6] for r in rows} == names
    english = {r.name: r.e for r in rows}
    assert english["농심 신라면 큰사발면 86g"] == "농심 신라면 Big Bowl 86g" and english["오뚜기 진라면 매운맛 5입"] == "오뚜기 진라면 Spicy 5입" and english[None] == ""
    assert mastering.parse_product_names(df, "name", brands.limit(0)).where("brand IS NOT NULL").count() == 0


def test_identify_by_common_words_gives_a_row_per_query(spark):
    """Words that all names share: queries of one, two and more words, against a plain search."""
    rnd = random.Random(3)
    names = [(f"{i:06d}", " ".join(["Holdings", "Harbor", *rnd.sample(["north", "south", "blue", "red", "iron"], rnd.randrange(4))])) for i in range(80)]
    held = spark.createDataFrame([(c, None, None, None, n) for c, n in names], "code string, isin string, corp string, name_kr string, name_en string")
    queries = ["harbor", "holdings harbor x", "Harbor Holdings", "red harbor", "blue iron harbor", "iron north south holdings", "absent harbor", "north"]
    got = {r.q: r.code for r in registry.identify(spark.createDataFrame([(q,) for q in queries], "q string"), "q", held).where("how IN ('word', 'words')").collect()}
    words = {c: {w.lower() for w in n.split()} for c, n in names}
    for q in queries:
        fits = sorted((len(ws), c) for c, ws in words.items() if {w.lower() for w in q.split()} <= ws)
        if q in got or not fits:
            assert got.get(q) == (fits[0][1] if fits else None), q
    assert len(got) >= 4


def _sent_whole(df):
    """The sides of joins that the driver would send to every task, in the plan before and after it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_exploded_names_are_not_broadcast(spark):
    names = spark.createDataFrame([(i, f"제품 큰컵 {i} 매운맛") for i in range(50)], "i int, name string")
    words = spark.createDataFrame([("큰컵", "Big Cup", 0), ("매운맛", "Spicy", 1)], "word string, english string, rank int")
    assert _sent_whole(mastering._met(names.select(F.col("name").alias("__s")), words, "word")) == 0
