"""Choice of companies on odd tables: missing caps and segments, ties, pins, empty tables, short series."""

from __future__ import annotations

import datetime as dt

import pytest

from quillon.operators import choice

CANDIDATES = "company string, code string, listed boolean, segment string, sub_sector string"


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [("a", "1", True, "ramen", "noodles"), ("b", "2", True, "unheard", "noodles"), ("c", None, None, None, None), ("d", "4", False, "holding", " "), ("e", "5", True, "ramen", "noodles")]
    return spark.createDataFrame(rows, CANDIDATES)


def test_scores(spark, candidates):
    caps = spark.createDataFrame([("1", 99.0), ("1", 999.0), ("2", None), (None, 5.0), ("5", 999.0)], "code string, cap double")
    got = {r.company: r for r in choice.score_candidates(candidates, caps).collect()}
    assert {k: (r.size, r.sector_rep, r.segment_score) for k, r in got.items()} == {"a": (1.0, 1.0, 1.0), "e": (1.0, 0.5, 1.0), "b": (0.0, pytest.approx(1 / 3), 0.3), "c": (0.0, 0.3, 0.3), "d": (0.0, 0.3, 0.2)}
    assert [got[k].score for k in "aebcd"] == [100.0, 87.5, 29.3, 13.5, 11.5] and [got[k]["rank"] for k in "aebcd"] == [1, 2, 3, 4, 5]
    alone = {r.company: r.size for r in choice.score_candidates(candidates, caps.limit(0)).collect()}
    assert alone == {"a": 0.5, "b": 0.5, "e": 0.5, "c": 0.0, "d": 0.0}
    assert choice.score_candidates(candidates.limit(0), caps).count() == 0


def test_selection(spark, candidates):
    scored = choice.score_candidates(candidates, spark.createDataFrame([("4", 1e12)], "code string, cap double"))
    place = {r.company: r["rank"] for r in scored.collect()}
    got = {r.company: r for r in choice.select_universe(scored, 2, 1).collect()}
    assert {k: r.status for k, r in got.items()} == {k: "selected" if n <= 2 else "watch" if n == 3 else "excluded" for k, n in place.items()}
    assert got["d"].reason.startswith("unlisted, segment holding, cap 1.00T, score ") and got["c"].reason.startswith("unlisted, score ") and not got["a"].pinned
    listed = {r.company: r.status for r in choice.select_universe(scored, 10, 1, listed_only=True).collect()}
    assert {k for k, s in listed.items() if s == "selected"} == {"a", "b", "e"} and sorted(listed.values()).count("watch") == 1
    pins = spark.createDataFrame([("a", "excluded"), ("a", " excluded "), ("b", " "), ("c", None), ("z", "selected"), ("c", "selected")], "company string, status string")
    pinned = {r.company: (r.status, r.pinned) for r in choice.select_universe(scored, 0, 0, pins=pins).collect()}
    assert pinned == {"a": ("excluded", True), "b": ("excluded", False), "c": ("selected", True), "d": ("excluded", False), "e": ("excluded", False)}


def test_segments_and_themes(spark):
    rows = spark.createDataFrame([("ramen", 0.9), ("ramen", 0.3), ("dairy", 0.1), ("meat", 0.9), ("snack", None), (None, 1.0)], "segment string, heat double")
    got = {r.segment: (r.n, r.note) for r in choice.segment_notes(rows).collect()}
    assert got == {"ramen": (2, "deep dive first"), "dairy": (1, "fit for deep dives"), "meat": (1, "companies and brands suffice"), "snack": (1, "no signals")}
    trends = spark.createDataFrame([("불닭", 0.5), ("HOT sauce", 0.9), ("HOT sauce", 0.1), ("plain", 0.9), ("cold", 0.2), (None, 2.0), ("x", None)], "keyword string, momentum double")
    themes = {r.theme: (r.drivers, r.n) for r in choice.trend_packages(trends).collect()}
    assert themes == {"spicy": ("HOT sauce, 불닭", 2), "rising": ("HOT sauce, plain, 불닭", 3)}
    assert choice.trend_packages(trends.where("momentum < 0.1")).count() == 0


def test_summary(spark):
    rows = spark.createDataFrame([("trend,news", "high"), ("none", "low"), ("news", "medium")], "status string, confidence string")
    assert tuple(choice.recommendation_summary(rows).first()) == (3, 2, 1, 1, 1, "some without signals,no consensus")
    assert tuple(choice.recommendation_summary(rows.limit(0)).first())[:2] == (0, 0)


def test_reasons(spark):
    rows = [
        ("deep dive", 0.905, 0.7, "ramen", ", ".join(("heat 0.91", "ramen fits deep dives", "listed", "uncertain consensus 0.70"))), ("deep dive", 1.0, None, "ramen", "heat 1.00, ramen fits deep dives, listed"),
        ("brand tracker", 0.6, None, None, "heat 0.60, listed, no segment is not for deep dives"), ("watch unlisted", 0.75, 0.9, "x", "heat 0.75, unlisted"),
        ("consensus gap", 0.1, 0.6, "x", "uncertain consensus 0.60"), ("keep", 0.1, None, "x", "heat 0.10, nothing special"), ("collect data", None, 0.9, "x", "no outside signals"),
    ]
    df = spark.createDataFrame(rows, "action string, heat double, opportunity double, segment string, want string")
    got = choice.with_reasons(df).collect()
    assert [r.why for r in got] == [r.want for r in got]


def test_snapshots(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [("a", day(i), float(i)) for i in range(6)] + [("a", day(9), None), ("a", day(8), float("nan")), ("b", day(0), 1.0), (None, day(0), 4.0), (None, day(1), 2.0)]
    got = {r.key: r for r in choice.snapshots(spark.createDataFrame(rows, "key string, day date, value double")).collect()}
    a = got["a"]
    assert (a.day, a.last, a.prev, a.ma5, a.ma20, a.pct1, a.pct5, a.pct20) == (day(5), 5.0, 4.0, 3.0, None, 25.0, None, None)
    assert set(got) == {"a", None} and got[None].pct1 == -50.0


def test_companies_of_one_name_are_not_multiplied(spark):
    rows = [("a", f"00000{i}", True, "ramen", "x") for i in range(4)] + [("b", "000009", True, "ramen", "x")]
    caps = spark.createDataFrame([(r[1], 5.0) for r in rows], "code string, cap double")
    scored = choice.score_candidates(spark.createDataFrame(rows, "company string, code string, listed boolean, segment string, sub_sector string"), caps)
    out = choice.select_universe(scored, n=3, watch=1).orderBy("rank").collect()
    assert [r.status for r in out] == ["selected"] * 3 + ["watch", "excluded"]


def test_caps_are_rounded_as_doubles(spark):
    """Sums that end in 5.00, as thousands: half of a hundredth in their text, more or less than that as doubles."""
    import duckdb

    sums = [11_000_005 + 370_010 * i for i in range(30)] + [16_384_045]
    rows = [(f"c{i:02d}", f"{i:06d}", True, "ramen", "x") for i in range(len(sums))]
    caps = spark.createDataFrame([(r[1], 1e9 * s) for r, s in zip(rows, sums, strict=True)], "code string, cap double")
    out = choice.select_universe(choice.score_candidates(spark.createDataFrame(rows, CANDIDATES), caps))
    got = {r.company: r.reason.split("cap ")[1].split("T")[0] for r in out.collect()}
    want = {r[0]: str(duckdb.execute("SELECT CAST(round(1e9::DOUBLE * ?::DOUBLE / 1e12::DOUBLE, 2) AS DECIMAL(18, 2))", [s]).fetchall()[0][0]) for r, s in zip(rows, sums, strict=True)}
    assert got == want and got["c30"] == "16384.04"


def test_places_of_one_name_go_by_code(spark):
    rows = [("a", f"{i:06d}", True, "ramen", "x") for i in (3, 1, 2, 0)]
    caps = spark.createDataFrame([(r[1], 5.0) for r in rows], "code string, cap double")
    got = {r.code: r.sector_rep for r in choice.score_candidates(spark.createDataFrame(rows, CANDIDATES).coalesce(1), caps).collect()}
    assert got == {f"{i:06d}": pytest.approx(1 / (i + 1)) for i in range(4)}
