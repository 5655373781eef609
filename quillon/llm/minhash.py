"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash: in its j-th step an element of the set takes the j-th place of a random permutation of the signature's
components and offers it the value j + (a random fraction); each component keeps the least. As the steps' values rise, a
document stops as soon as all components lie below the next step's values: long documents after one or two steps. The
components of a signature are negatively correlated, which lowers the variance below that of independent minima.

Every pair that shares a bucket is decided on whole shingle sets, without making all pairs of a bucket:

1. Equal sets are one class. In each bucket, every class is compared with the bucket's hub (a star). The comparison gives
   the link and the *difference* from the hub, the elements that only one of the two sets holds. Links are grouped.
2. Two members of a bucket differ by ``|Dx| + |Dy| - 2 |Dx and Dy|`` elements, D being their differences from the hub, so
   that the differences, short for what resembles the hub, decide any pair exactly. In buckets that still hold several
   components, what is outside the largest one meets a new hub of each bucket, drawn by a hash from the largest one.
3. What is still apart is compared, across components only, with every member of the bucket; a join whose condition is
   the link itself gives out linked components, not pairs.

Defined cases: null and empty texts have no shingles, are linked with nothing and are kept; rows that share a doc_id are
one vertex, which any of their texts can link; rows with a null doc_id are linked with nothing (component null, kept);
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import chunks, mix, shingle_sets
from quillon.llm._store import materialise

SIGNATURE = "doc_id long, t long, n long, c binary, bands array<long>"


def super_minhash(h: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Signatures [rows, m] of the sets given as (element hash, row), sorted by row; step in the high 16 bits."""
    out = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    seed, at, perm = h, row, None
    for j in range(m):
        if not len(seed):
            break
        rnd = mix(seed ^ np.uint64(0xD6E8FEB86659FD93 * (j + 1) % 2**64))
        pick = j + (((rnd >> np.uint64(48)) * np.uint64(m - j)) >> np.uint64(16)).astype(np.int64)
        value = (rnd & np.uint64(2**48 - 1)) | np.uint64(j << 48)
        if perm is None:
            place = pick
        else:
            each = np.arange(len(seed))
            place = perm[each, pick]
            perm[each, pick] = perm[:, j]
            perm[:, j] = place
            place = place.astype(np.int64)
        np.minimum.at(out, at * m + place, value)
        open_ = (out.reshape(rows, m) >= np.uint64((j + 1) << 48)).any(axis=1)
        go = open_[at]
        if j == 0:
            seed, at, pick = seed[go], at[go], pick[go]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(seed), 1))
            each = np.arange(len(seed))
            perm[each, pick] = 0
            perm[:, 0] = pick
        elif not go.all():
            seed, at, perm = seed[go], at[go], perm[go]
    return out.reshape(rows, m)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """SIGNATURE: the text's hash, the set's size, 16 bytes that name it, and hashes of the signature's bands and their numbers."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SIGNATURE.split(", ")]
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                h, row = shingle_sets(data, offsets, shingle)
                n = np.bincount(row, minlength=b - a)
                ends = np.concatenate([[0], np.cumsum(n)])
                name = np.empty((b - a, 2), np.uint64)
                for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
                    name[:, k] = total[ends[1:]] - total[ends[:-1]]
                sig = super_minhash(h, row, b - a, bands * rows).reshape(b - a, bands, rows)
                band = np.tile(np.arange(bands, dtype=np.uint64), (b - a, 1))
                for k in range(rows):
                    band = mix(band * np.uint64(3) + sig[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(name.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel())),
                    ],
                    names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(sign, SIGNATURE)


def differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``a, b, d``: the elements that only one of the whole sets of ``a`` and ``b`` holds. ``a``'s text travels to ``b``
    once per pair; a pair of a frequent ``a`` is a row of its own, so that such rows can be dealt out."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[], []]
            for side in (0, 1):
                for lo, hi, data, offsets in chunks(batch.column(2 + side)):
                    h, row = shingle_sets(data, offsets, shingle)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                    sets[side] += [h[ends[i] : ends[i + 1]] for i in range(hi - lo)]
            apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sets, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in apart])]).astype(np.int32)
            flat = pa.array(np.concatenate(apart) if apart else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["a", "b", "d"])

    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(compare, "a binary, b binary, d array<long>")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id reachable, by hooking to the least neighbouring label and pointer jumping."""
    both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = nodes.withColumn("comp", F.col("id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        hooked = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        root = labels.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        new = materialise(hooked.join(root, "comp", "left").select("id", F.least("comp", "root").alias("comp"), (F.least("comp", "root") != F.col("old")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if not new.where("moved").head(1):
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between components (a, b) have been added: only components in links take part."""
    links = materialise(links.where("a != b").distinct(), "component-links")
    if not links.head(1):
        return labels
    nodes = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).distinct()
    new = components(nodes, links).toDF("comp", "root")
    return materialise(labels.join(new, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")


def enough(n: Column, m: Column, apart: Column, pct: int) -> Column:
    """Are sets of ``n`` and ``m`` elements linked that differ by ``apart`` of them?"""
    return (n + m > apart) & (100 * (n + m - apart) >= pct * (n + m + apart))


def linked(x: str, y: str, pct: int) -> Column:
    """Is the link condition met by two members of a bucket? By sizes, then sizes of differences, then exactly."""
    n, m, d, e = F.col(f"{x}_n"), F.col(f"{y}_n"), F.size(f"{x}_d"), F.size(f"{y}_d")
    apart = d + e - 2 * F.size(F.array_intersect(f"{x}_d", f"{y}_d"))
    return enough(n, m, F.abs(n - m), pct) & enough(n, m, F.abs(d - e), pct) & enough(n, m, apart, pct)


def mixed_members(shared: DataFrame, labels: DataFrame, apart: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: ``h, c, n, comp, main`` (the bucket's largest component), d."""
    member = shared.join(labels.toDF("c", "comp"), "c")
    sizes = member.groupBy("h", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("h", F.col("m.comp").alias("main"))
    known = apart.select(F.col("a").alias("hub"), F.col("b").alias("c"), "d")
    none = F.array().cast("array<bigint>")
    rows = member.join(main, "h").join(known, ["hub", "c"], "left")
    return rows.select("h", "c", "n", "comp", "main", F.coalesce("d", none).alias("d"))


def near_duplicates(docs: DataFrame, shingle: int = 5, pct: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Sets of distinct ``shingle``-word shingles are linked where 100 * intersection >= pct * union. With 48 bands of 6
    rows, a pair at 0.8 shares no bucket with a probability of 5e-7; every pair that shares one is decided exactly.
    """
    sig = materialise(signatures(docs, shingle, bands, rows), "signatures")
    real = sig.where("n > 0 AND doc_id IS NOT NULL")
    rows_, ids_ = sig.where("doc_id IS NOT NULL").agg(F.count("*"), F.countDistinct("doc_id")).first()
    repeated = rows_ != ids_
    classes = materialise(real.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    posts = classes.select("c", "n", F.explode("bands").alias("h"))
    hubs = posts.groupBy("h").agg(F.min("c").alias("hub"), F.max("c").alias("most")).where("most > hub").select("h", "hub")
    shared = materialise(posts.join(hubs, "h").select("h", "hub", "c", "n"), "shared")
    stars = shared.where("c != hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    size = shared.groupBy("c").agg(F.first("n").alias("n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = texts.join(classes.join(size.select("c"), "c", "left_semi").select("rep.doc_id", "rep.t", "c").hint("shuffle_hash"), ["doc_id", "t"]).select("c", "text")
    texts = materialise(texts.dropDuplicates(["c"]) if repeated else texts, "texts")
    apart = materialise(differences(stars, texts, shingle), "apart")
    star_links = apart.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b").where(enough(F.col("n_a"), F.col("n_b"), F.size("d"), pct)).select("a", "b")

    links = star_links
    if repeated:  # the classes of one document's texts are one vertex
        ids = real.select("doc_id", "c").distinct()
        several = ids.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("most")).where("most > a").select("doc_id", "a")
        links = links.unionAll(ids.join(several, "doc_id").where("c != a").select("a", F.col("c").alias("b")))
    links = materialise(links, "links")
    nodes = materialise(size.select("c").unionAll(links.select("a")).unionAll(links.select("b")).distinct().toDF("id"), "nodes")
    labels = components(nodes, links)

    member = materialise(mixed_members(shared, labels, apart), "mixed")
    pick = F.min(F.struct(F.xxhash64("h", "c").alias("draw"), F.col("n").alias("y_n"), F.col("d").alias("y_d")))
    second = member.where("comp = main").groupBy("h").agg(pick.alias("y")).select("h", "y.y_n", "y.y_d")
    other = member.where("comp != main").select("h", F.col("c").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"), F.col("d").alias("x_d"), "main")
    labels = joined(labels, other.join(second, "h").where(linked("x", "y", pct)).select(F.col("x_comp").alias("a"), F.col("main").alias("b")))

    member = materialise(mixed_members(shared, labels, apart), "mixed")
    other = member.where("comp != main").select("h", F.col("c").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"), F.col("d").alias("x_d"))
    every = member.select("h", F.col("c").alias("y"), F.col("n").alias("y_n"), F.col("comp").alias("y_comp"), F.col("d").alias("y_d"), (F.col("comp") == F.col("main")).alias("y_main"))
    across = (F.col("x_comp") != F.col("y_comp")) & (F.col("y_main") | (F.col("x") < F.col("y")))
    found = other.join(every, "h").where(across & linked("x", "y", pct))
    labels = joined(labels, found.select(F.least("x_comp", "y_comp").alias("a"), F.greatest("x_comp", "y_comp").alias("b")))

    named = classes.select("c", "rep.doc_id").join(labels.toDF("c", "comp"), "c", "left").select("c", "doc_id", F.coalesce("comp", "c").alias("comp"))
    of = named.join(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("c", "component_id")
    grouped = real.select("doc_id", "n", "c").join(of, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sig.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if repeated:  # an empty text of a document that has others
        grouped = materialise(grouped, "grouped")
        its = grouped.groupBy("doc_id").agg(F.min("component_id").alias("its"))
        rest = rest.join(its, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("its", "component_id").alias("component_id"))
    return grouped.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
