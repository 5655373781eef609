"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import hashlib

import pytest
import regex

from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _tokens(text: str | None) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())


def _holds(doc: list[str], item: list[str], least: int = 5) -> bool:
    grams = lambda t: {tuple(t[i : i + least]) for i in range(len(t) - least + 1)}
    if len(item) < least or not grams(doc) & grams(item):
        return 0 < len(item) < least and any(doc[i : i + len(item)] == item for i in range(len(doc)))
    near = [i for i, g in enumerate(zip(*(doc[k:] for k in range(least)), strict=False)) if g in grams(item)]
    part = doc[max(0, near[0] - 1) : near[-1] + least + 1]  # the tiles lie between the first and the last seed
    return 2 * sum(n for *_, n in brute.tiles(part, item, least)) >= len(item)


def test_odd_tables(spark, tmp_path):
    """Nulls, repeats, shared ids, extra columns of clashing names, and no rows at all."""
    prose = lambda k, n=40: " ".join(f"word{k}x{i}" for i in range(n))
    line = "A line of well over forty characters that many documents share."
    rows = [(1, prose(1)), (2, prose(1)), (3, None), (4, ""), (5, prose(5)), (5, prose(5)), (6, prose(6) + " " + prose(9, 30)), (None, prose(7)), (8, prose(1) + " more")]
    rows += [(20 + i, f"{prose(20 + i, 9)}\n{line}") for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, toxicity int")
    bench, labels = spark.createDataFrame([(0, prose(9, 30)), (1, None)], "item_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for name, some in (("rows", docs), ("none", docs.limit(0))):
        at = f"file://{tmp_path}/{name}"
        some.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        if name == "none":
            assert got == []
            continue
        # 2 and 8 are like 1, 6 holds the first item, and one document keeps the shared line
        assert sorted((r.doc_id for r in got), key=str) == sorted([1, 3, 4, 5, 5, None, *range(20, 26)], key=str)
        assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (3, 4)} == {3: 0, 4: 0}
        assert sum(r.n_tokens for r in got if r.doc_id == 25) > max(r.n_tokens for r in got if r.doc_id in range(20, 25))


def test_stages(spark, sf):
    docs = corpus_pipeline.documents(spark, sf)
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        seen.append(name)
        if name == "bpe":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
            for r in docs.collect():
                ids = t.encode(before[r.doc_id] or "", add_special_tokens=False).ids
                assert list(r.ids) == ids
                assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            continue
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            gone = [before[i] for i in set(before) - set(after)]
            assert gone and len(gone) < 0.25 * len(before)
        if name == "line_dedup":
            assert {i: brute.sha(t) for i, t in after.items()} == {i: x[2] for i, x in brute.lines(list(before.items())).items()}
        if name == "near_dedup":
            assert set(after) == {r[0] for r in brute.components(list(before.items()), 5) if r[3]}
        if name == "decontamination":
            items = [_tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not any(_holds(_tokens(t), x) for x in items)} and len(after) < len(before)
    assert seen == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
