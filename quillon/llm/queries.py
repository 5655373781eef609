"""The queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._store import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.secrets import BASE, scan_secrets, spans_text

    base = F.filter("found", lambda x: x["strong"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import new_folder, read_bundles, write_bundles

    folder = new_folder(spark)
    write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_bundles(spark, folder, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.bpe import code_documents

    return code_documents(documents(spark, sf_dir), word_vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lines import dedup_lines

    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.topk import exact_topk

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decon import contamination

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), benchmark).select("doc_id", "item_id", "coverage", "n_tiles")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=2)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import quality

    scored = quality(documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import toxicity

    scored = toxicity(documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.langid import identify_languages

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.resample import resample

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.spelling import spelling_groups

    return spelling_groups(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: CRC-32 in SQL: a table of 256 values by eight shifts each, then a fold over the bytes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC = "xor(list_reduce(list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Each is written from the query's contract. Secrets' positions, BPE, tiling, models, similarity groups and repeated byte
#: strings are tested against plain versions instead.
ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), d AS (SELECT page_id, strlen(x) AS n, CAST(unhex(sha1(x)) AS BIT)::VARCHAR AS b, x FROM p),
             f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x), bit AS (SELECT page_id, n, b, first FROM d JOIN f USING (x))
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: (ascii(substr(b, 5 * i + j + 1, 1)) - 48) * 2 ** (4 - j))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bit""",
    "op4_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
             k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
             j AS (SELECT doc_id, i, line, coalesce(doc_id <> last, false) AS dropped FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op5_exact_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op12_resample": f"""
        WITH k AS (SELECT {_CRC_TABLE} AS t),
             w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark WHERE text IS NOT NULL)),
             side AS (SELECT row_number() OVER () AS r, doc_id, ws FROM w),
             f AS (SELECT r, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM side),
             g AS (SELECT f, {_CRC.format("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f), k),
             h AS (SELECT r, doc_id, b FROM f JOIN g USING (f)),
             c AS (SELECT b, count(*) FILTER (doc_id IS NOT NULL) AS s, count(*) FILTER (doc_id IS NULL) AS t FROM h GROUP BY b),
             z AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
             x AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM h JOIN z USING (b) GROUP BY r),
             y AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS u FROM side LEFT JOIN x USING (r) WHERE doc_id IS NOT NULL),
             v AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
             o AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, 25 * count(*) FILTER (words >= 20) OVER () // 100 AS many FROM v)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= many THEN place END AS rank FROM o""",
    "op13_spelling": f"""
        WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS t),
             r AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
             o AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS n FROM r GROUP BY ALL),
             h AS (SELECT run, n, {_CRC.format("s")} AS h FROM o, k),
             e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
             w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
             d AS (SELECT word, n, word AS key FROM w UNION SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
             p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b USING (key) WHERE a.word <> b.word AND (CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1 ELSE key IN (a.word, b.word) END)),
             g AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
             f AS (SELECT word, min(other) AS form, any_value(g.m) AS form_n FROM g JOIN p USING (word) WHERE p.m = g.m AND g.m >= 10 * g.n GROUP BY word),
             c AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.root = f.word)
        SELECT w.word, form, root, w.n, coalesce(n_near, 0) AS n_near, form_n
        FROM w LEFT JOIN g USING (word) LEFT JOIN f USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
