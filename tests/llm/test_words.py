"""Language identification, importance resampling and spelling groups, against plain versions and on odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import _crc, decon, langid, minhash, queries, resample, spelling
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string"
CLASH = ["n", "word", "key", "score", "rank", "weight", "bucket", "lang_pred", "held", "id", "share", "y"]


def _wide(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def _rows(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    stems = ["réserver", "banane", "zwölfte", "language", "mississippi", "aaaaaaaa", "ÀÉÎÕÜñß", "document"]
    word = lambda: (w := rnd.choice(stems), w[: (k := rnd.randrange(len(w)))] + rnd.choice(["", "x", "é", w[k]]) + w[k + rnd.randrange(2) :])[rnd.random() < 0.2]
    texts = [" ".join(word() for _ in range(rnd.choice([3, 19, 20, 21, 60]))) for _ in range(60)]
    texts += [None, "", " \n", "42 — !", "日本語 text", "A" * 300 + " " + "a" * 301, "a" * 300 + "," + "a" * 301, " ".join(word() for _ in range(4000))]
    texts += [texts[0], texts[0].upper()]
    return [*enumerate(texts), (None, texts[1]), (None, None), (5, texts[5]), (5, "other words here entirely")]


def test_crcs_of_concatenations():
    rnd = random.Random(0)
    parts = [(rnd.randbytes(rnd.randrange(9)), rnd.randbytes(rnd.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(50)]
    got = _crc.joined(_crc.crc_of([a for a, _ in parts]), _crc.crc_of([b for _, b in parts]), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
    assert _crc.joined(np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("max_nodes", [1 << 20, 5])
def test_resample(spark, max_nodes):
    rows, target = _rows(), ["banane document banane", None, "", "zwölfte Language"]
    docs = _wide(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = resample.resample(docs, bench, max_nodes=max_nodes).select("doc_id", "n_features", "weight", "score", "rank")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = brute.resample(rows, target)
    assert got == want and sum(x[4] is not None for x in want) > 5
    assert resample.resample(docs, bench.limit(0)).count() == len(rows)


def test_resample_ties_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text)] * 8 + [(2, text), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    ranks = sorted(r["rank"] for r in resample.resample(docs, bench).collect() if r["rank"])
    assert ranks == [1, 2]
    assert resample.resample(docs.limit(0), bench).count() == 0
    few = resample.resample(docs.limit(3), bench)
    assert few.count() == 3 and few.where("rank IS NOT NULL").count() == 0


def test_trie_keeps_states_and_counts():
    data = np.frombuffer("The the  cat, the".encode(), np.uint8)
    trie = resample.WordTrie(10_000)
    trie.count(data, np.array([0, 8, len(data)]))  # "The the ", " cat, the"
    names = ["the", "cat", "the the", "cat the"]
    want = np.zeros(10_000, np.int64)
    for name, k in zip(names, (3, 1, 1, 1), strict=True):
        want[zlib.crc32(name.encode()) % 10_000] += k
    assert (trie.totals() == want).all() and len(trie) == 4


@pytest.mark.parametrize(("one_in", "long", "max_words"), [(31, 100, 1 << 19), (3, 6, 4), (2**32 - 1, 0, 1)])
def test_spelling(spark, one_in, long, max_words):
    rows = _rows() + [(1000 + i, t) for i, t in _rows(8) if i is not None]
    docs = _wide(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = spelling.spelling_groups(docs, one_in=one_in, long=long, max_words=max_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = {tuple(r) for r in got.collect()}, brute.spelling(rows, one_in)
    assert got == want and any(x[1] for x in want) and any(x[4] > 1 for x in want)


def test_spelling_chains_and_empty_tables(spark):
    text = " ".join(["aaaaaaa"] * 2 + ["aaaaaab"] * 20 + ["aaaaabb"] * 200 + ["aaaabbb"] * 2000 + ["aaaabb"] * 9 + ["zzzzzzz"] * 2)
    got = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id long, text string"), one_in=2**32 - 1).collect()}
    assert {w: r.root for w, r in got.items()} == {"aaaaaaa": "aaaabbb", "aaaaaab": "aaaabbb", "aaaaabb": "aaaabbb", "aaaabbb": "aaaabbb", "zzzzzzz": "zzzzzzz"}
    assert got["aaaaaaa"].form == "aaaaaab" and got["zzzzzzz"].n_near == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "42")], "doc_id long, text string")).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_words_of_random_words(spark):
    rnd = random.Random(9)
    n = {"".join(rnd.choice("ab") for _ in range(rnd.choice([7, 8, 9]))): rnd.randrange(2, 9) for _ in range(150)}
    words = spark.createDataFrame([(i, w, n[w]) for i, w in enumerate(sorted(n))], "id long, word string, n long")
    names = sorted(n)
    for long in (100, 8, 3):
        got = {names[r.id]: (r.n_near, names[-r.best.o]) for r in spelling.near_words(words, long).collect()}
        assert got == {w: (len(vs), min(vs, key=lambda v: (-n[v], v))) for w in n if (vs := [v for v in n if brute.near(w, v)])}


def test_deletion_hashes_match_the_strings():
    rnd, bases = random.Random(2), (123456789, 987654321)
    seen: dict[str, str] = {}
    for _ in range(40):
        word = "".join(rnd.choice("abé") for _ in range(12))
        for (key, place, first), (name, _, first_) in zip(spelling.deletions(word, bases, 3), spelling.deletions(word, bases), strict=True):
            assert first == first_ and seen.setdefault(key, name) == name
            assert name == (word if place < 0 else word[:place] + word[place + 1 :])


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op11_language(spark, sf)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    by = {lang: [r.lang_pred == lang for r in held if r.lang == lang] for lang in {r.lang for r in held}}
    assert min(sum(x) / len(x) for x in by.values()) >= 0.9  # of every language, not only of the frequent one


def _two_languages(n: int = 120) -> list[tuple[int | None, str | None, str | None]]:
    rnd = random.Random(6)
    words = {"xx": ["kalo", "mira", "tuno", "sela"], "yy": ["grüft", "schtern", "bröl", "zwack"]}
    return [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(1, 9))), lang) for i, lang in enumerate(rnd.choice(["xx", "xx", "xx", "yy"]) for _ in range(n))]


def test_languages_on_odd_tables(spark):
    rows = _two_languages()
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "42 !?", "xx"), (503, "kalo tuno", None), (None, "mira sela", "xx"), (504, "日本", None), (505, "kalo " * 300_000, "xx")] + rows[:5]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = langid.identify_languages(_wide(docs).withColumn("held_out", F.lit("clash")))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and out.where("score IS NULL OR lang_pred IS NULL").count() == 0
    assert {i: (got[i].lang_pred, got[i].score) for i in (500, 501, 502)} == {i: ("und", 0.0) for i in (500, 501, 502)}
    assert got[503].lang_pred == got[505].lang_pred == got[None].lang_pred == "xx" and got[504].lang_pred in ("xx", "yy")
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:120])
    for none in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("text", F.lit("7"))):
        assert {r.lang_pred for r in langid.identify_languages(none).collect()} <= {"und"}
    assert {r.lang_pred for r in langid.identify_languages(docs.withColumn("lang", F.lit("one")).where("doc_id < 50")).collect()} == {"one"}
    with pytest.raises(ValueError):
        langid.fit_language_model(docs, max_langs=1)


def test_document_frequencies_and_grams_of_pieces(monkeypatch, spark):
    texts = ["Ab, c", "", "!!", "abababab", "ß ÀÉ 日本", "x"]

    def plain(t):
        t = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i + (n == 3) : i + n - (n == 3)].strip()]

    whole = [sorted(np.concatenate([b for b, _ in langid.grams([t], 17)]).tolist()) for t in texts]
    assert [len(x) for x in whole] == [len(plain(t)) for t in texts]
    names: dict[int, str] = {}
    for t in texts:
        for b, _ in langid.grams([t], 40):
            assert len(set(b.tolist())) == len(set(plain(t)))
            names |= dict.fromkeys(b.tolist(), "")
    assert len(names) == len({g for t in texts for g in plain(t)})
    monkeypatch.setattr(langid, "PIECE", 3)
    cut = list(langid.grams(texts, 17))
    assert [sorted(np.concatenate([b[row == i] for b, row in cut]).tolist()) for i in range(len(texts))] == whole
    monkeypatch.undo()
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    rows, df = langid.document_frequencies(docs, 17)
    want = np.bincount([b for x in whole for b in set(x)], minlength=1 << 17)
    assert rows == 7 and (df == want).all()


def test_elastic_net_leaves_weights_at_zero_and_temperature_calibrates():
    rnd = np.random.default_rng(1)
    ftrl = langid.Ftrl(20, 2)
    for _ in range(400):
        y = int(rnd.integers(2))
        x = np.append(rnd.normal(size=20) * 0.02, 1.0)
        x[y] += 1
        ftrl.learn(np.arange(21), x, y)
    w = ftrl.weights(slice(None))
    assert w[0, 0] > 0.5 < w[1, 1] and (w[2:20] == 0).mean() > 0.5
    y = rnd.integers(0, 2, 4000)
    logits = np.where(np.eye(2)[np.where(rnd.random(4000) < 0.8, y, 1 - y)] > 0, 6.0, 0.0)
    assert abs(langid.softmax(np.array([6.0, 0.0]) / langid.fit_temperature(logits, y))[0] - 0.8) < 0.03


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement agree under every polynomial hash modulo 2**64; the operators tell them apart."""
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, morse), (2, other), (3, other)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()} == {(1, 1), (2, 2), (3, 2)}
    bench = spark.createDataFrame([(9, other)], "item_id long, text string")
    assert {r.doc_id for r in decon.contamination(docs, bench).collect()} == {2, 3}


def test_word_hashes():
    from quillon.llm._bytes import word_hash

    data = np.frombuffer("ab ab,日本 ab".encode(), np.uint8)
    start, end = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 9, 12, 15])
    h = word_hash(data, start, end)
    assert h[0] == h[1] == h[4] and len(set(h.tolist())) == 3
    assert not len(word_hash(data, np.zeros(0, int), np.zeros(0, int)))


def test_tiles_by_plain_tiling():
    rnd = random.Random(7)
    for _ in range(60):
        item = [rnd.choice("abcd") for _ in range(rnd.randrange(3, 30))]
        doc = [rnd.choice("abcd") for _ in range(10)] + item[5:20] + [rnd.choice("abcd") for _ in range(5)] + item[:8]
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        got = decon.tile(np.array([d for d, _ in seeds]), np.array([i for _, i in seeds]), 3) if seeds else []
        assert got == brute.tiles(doc, item, 3)


def test_contamination_by_plain_tiling_with_shared_item_ids(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [(i % 5, " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 25)))) for i in range(8)] + [(0, None), (None, " ".join(words[:9]))]
    docs = []
    for i in range(40):
        parts = [t.split() for _, t in rnd.sample(items, 2) if t]
        cut = [p[(k := rnd.randrange(len(p))) :] + p[:k] if rnd.random() < 0.5 else p[: rnd.randrange(len(p))] for p in parts]
        docs.append((i, " ".join(w for p in cut for w in [*p, rnd.choice(words)])))
    docs += [docs[0], (None, items[0][1]), (41, items[0][1] + " x " + items[5][1])]
    want = {}
    for i, text in docs:
        for item, t in items:
            if t and text:
                found = brute.tiles(text.split(), t.split(), 5)
                if (c := sum(n for *_, n in found) / len(t.split())) >= 0.5:
                    want[i, item] = max(want.get((i, item), (0, 0)), (c, len(found)))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").withColumn("t", F.lit("clash"))
    for block in (1 << 22, 9):
        rows = decon.contamination(frame(docs, "doc_id"), frame(items, "item_id"), block_seeds=block).collect()
        assert {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in rows} == want and len(rows) == len(want)
    assert max(c for c, _ in want.values()) == 1.0


@pytest.mark.parametrize(("query", "label"), [("op8_quality", "quality"), ("op10_toxicity", "toxic")])
def test_models_rank_held_out_rows(spark, query, label):
    """The area under the curve, which always answering the frequent label leaves at one half."""
    sf = "/root/testdata/sf0.01"
    rows = queries.queries()[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).select("score", F.col(label).alias("y")).collect()
    good, bad = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    assert len(good) > 3 < len(bad)
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad) >= 0.9
