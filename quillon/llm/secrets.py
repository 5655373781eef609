"""Secret scans with multipart credential linking (DataFrame functions only).

Strong parts (``assign``, ``access``, ``hex``) are always reported. Weak parts - user or client identifiers, short
assigned secrets, bare 40-character keys and endpoint addresses - are ordinary text by themselves; they are reported
only where the parts that complete a credential stand within ``scope`` code points: a secret needs an identifier, an
identifier needs a secret, an endpoint needs both. That is an interval join on (document, stretch of text): a weak part
is dealt to every stretch its scope touches and semi-joined with the complementary parts that start there.

Defined cases: a null text is empty; repeated rows are scanned once and each gets the result; rows that share a doc_id
but not the text are scanned apart; ``nothing found`` is an empty list of spans, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._store import materialise

#: Kinds in the order in which they are listed in results: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "ident": (r"""(?i)(access_?key_?id|client_?id|username|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 4),
    "key": (r"[A-Za-z0-9/+]{40,}", 0, 40),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", 0, 11),
}
#: Assigned secrets of fewer characters than BASE asks for, but as many as this, are weak parts.
SHORT_SECRET = 6
KINDS = [*BASE, "short", *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "short": "secret", "key": "secret", "access": "id", "ident": "id", "endpoint": "place"}


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The matches of one kind, leftmost and non-overlapping, with the lengths of the texts before each one."""
    p = F.lit(pattern)
    return F.struct(
        F.lit(kind).alias("kind"),
        F.arrays_zip(
            F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
            F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.char_length).alias("size"),
            F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        ).alias("found"),
    )


def scan_parts(docs: DataFrame) -> DataFrame:
    """All parts, strong and weak: ``doc_id, h, g, kind, strong, start, end`` (h, g: hashes of the text)."""
    patterns = BASE | WEAK
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = (
        docs.select("doc_id", text.alias("text"))
        .where(_any(F.col("text"), patterns))
        .distinct()
        .withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    )
    key = ["doc_id", "h", "g", "kind"]
    each = hits.select("doc_id", "h", "g", F.inline(F.array(*(_found(F.col("text"), k, p, n) for k, (p, n, _) in patterns.items()))))
    each = each.select(*key, F.posexplode("found").alias("i", "x")).select(
        *key, "i", F.col("x.m").alias("m"), F.col("x.size").alias("size"), F.col("x.gap").alias("gap")
    )
    upto = W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    length = F.char_length("m")
    each = each.withColumn("end", F.sum(F.col("gap") + length).over(upto)).where(F.col("m").isNotNull())
    mixed = F.col("m").rlike("[A-Z]") & F.col("m").rlike("[a-z]") & F.col("m").rlike("[0-9]")
    least = F.element_at(F.create_map(*(F.lit(x) for k, (_, _, n) in patterns.items() for x in (k, n))), F.col("kind"))
    kind = F.when((F.col("kind") == "assign") & (F.col("size") < least), "short").otherwise(F.col("kind"))
    enough = (
        F.when(F.col("kind") == "assign", F.col("size") >= SHORT_SECRET)
        .when(F.col("kind") == "key", (length == 40) & mixed)
        .otherwise(F.col("size") >= least)
    )
    return each.where(enough).select(
        *key[:3], kind.alias("kind"), kind.isin(*BASE).alias("strong"), (F.col("end") - length).cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )


def _any(text: Column, patterns: dict) -> Column:
    found = None
    for pattern, _, _ in patterns.values():
        x = text.rlike(pattern)
        found = x if found is None else found | x
    return found


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """The strong parts, and the weak ones that the parts within ``scope`` code points complete to a credential."""
    key = ["doc_id", "h", "g"]
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv)), F.col("kind"))
    parts = parts.withColumn("role", role)
    strong, weak = parts.where("strong"), parts.where(~F.col("strong"))
    other = parts.select(
        *(F.col(c).alias(f"{c}_") for c in [*key, "role", "strong", "start", "end"]),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("stretch_"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_"))

    def near(rows: DataFrame, needs: str) -> DataFrame:
        """Rows with a part of that role within scope."""
        dealt = rows.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
        gap = F.greatest(F.col("start_") - F.col("end"), F.col("start") - F.col("end_"))
        return dealt.join(other.where(F.col("role_") == needs), same & (F.col("stretch") == F.col("stretch_")) & (gap <= scope), "left_semi").drop("stretch").distinct()

    inside = same & (F.floor(F.col("start") / scope) == F.col("stretch_")) & (F.col("start_") <= F.col("start")) & (F.col("end_") >= F.col("end"))
    weak = weak.join(other.where("strong_"), inside, "left_anti")  # it is reported already
    linked = (
        near(weak.where("role = 'secret'"), "id")
        .unionByName(near(weak.where("role = 'id'"), "secret"))
        .unionByName(near(near(weak.where("role = 'place'"), "id"), "secret"))
    )
    return strong.unionByName(linked).select(*key, "kind", "strong", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, its spans ``(start, rank, kind, end, strong)`` by start,
    then kind (code points, end exclusive)."""
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    found = (
        link_parts(materialise(scan_parts(docs), "secret-parts"), scope)
        .groupBy("doc_id", "h", "g")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "strong"))).alias("found"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, found = docs.select("doc_id", F.xxhash64(text).alias("h"), F.hash(text).alias("g")).alias("a"), found.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,strong:boolean>>")
    return rows.join(found, on, "left").select("a.doc_id", F.coalesce("b.found", empty).alias("found"))


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
