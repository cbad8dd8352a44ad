"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Each document is the set of its distinct k-word shingles (64-bit hashes). Two documents
link when ``100 * |A & B| >= percent * |A | B|``. The join keeps these steps:

1. *Scan.* One pass over the texts gives each document's set size and 128-bit set digest,
   and every task's share of a fixed-width count sketch over ALL shingles. Documents with
   equal sets collapse to their least id.
2. *Prefixes.* Shingles are ordered rare first by (log-quantised sketch count, hash), a
   fixed total order, so filtering is exact however coarse the sketch is. Each class
   representative keeps its first ``n - ceil(t n) + 1`` shingles.
3. *Candidates.* Joined on prefix shingles under the length and positional filters. First
   every holder of a shingle against the holder that has it earliest in its order (pairs
   linear in the group); then, of what has not become one component, all remaining pairs
   that pass the filters. Pairs inside a component found already can't change a component.
4. *Verify.* Each pair once: the bound from its common prefix shingles, the suffix filter,
   then exact intersection of the whole sets.
5. *Components* of the links by large-star / small-star, joined back to every document.

The sketch (``2**sketch_bits`` one-byte ranks) and a bitmap of wanted ids are all that is
broadcast. The bitmap has eight bits for each id, ``2**filter_bits`` at most; where there are
more ids, rows meet them in a semi-join by shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, sliced, tidy
from .components import components
from .kernels import LOWER, U, hash_spans, shingles, utf8, words

_SEG = 1 << 12


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(ids, sets) of slices of the batches (doc_id, text)."""
    for whole in batches:
        for batch in sliced(whole, "text"):
            data, offs = utf8(batch.column(1))
            data = LOWER[data]
            starts, ends, first = words(data, offs)
            yield batch.column(0), shingles(hash_spans(data, starts, ends), first, k)


def _scan(k: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("seg", pa.int32()), ("counts", pa.binary())])

    def sketch(counts):
        for lo in range(0, 1 << bits, _SEG * 64):
            segs = range(lo // _SEG, min(lo // _SEG + 64, (1 << bits) // _SEG))
            blobs = [zlib.compress(counts[s * _SEG : (s + 1) * _SEG].astype(np.int64).tobytes(), 1) for s in segs]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(list(segs), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    @tidy
    def run(batches):
        counts, held, shift = np.zeros(1 << bits, dtype=np.uint32), 0, U(64 - bits)
        for ids, sets in _sets(batches, k):
            m = len(ids)
            for s in sets:
                np.add.at(counts, (s >> shift).astype(np.int64), np.uint32(1))
                held += len(s)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
            if held >> 31:  # before a count could run over
                yield from sketch(counts)
                counts[:], held = 0, 0
        if held:
            yield from sketch(counts)

    return run


def _sum_segments(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for seg, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            got = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.int64)
            total[seg] = total[seg] + got if seg in total else got
    ranks = [np.minimum(np.floor(2 * np.log2(np.maximum(v, 1))), 255).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["seg", "ranks"])


def _prefixes(k: int, bits: int, percent: int, ranks):
    @tidy
    def run(batches):
        table, shift = np.frombuffer(ranks.value, dtype=np.uint8), U(64 - bits)
        for ids, sets in _sets(batches, k):
            rows = []
            for s in sets:
                n = len(s)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                if keep and keep < n:
                    # sets are in hash order, so a stable sort by rank is the order (rank, hash)
                    s = s[np.argsort(table[(s >> shift).astype(np.int64)], kind="stable")[:keep]]
                rows.append(s[:keep])
            offs = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "tokens"])

    return run


def _wanted(bits: int, bitmap):
    """Rows whose first column, an id, has its bit set in the bitmap."""

    @tidy
    def run(batches):
        bit = np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            keep = (bit[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _wanted_sets(k: int, keep):
    @tidy
    def run(batches):
        for ids, sets in _sets(keep(batches), k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "members"])

    return run


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.mod(ids.astype(np.int64), 1 << bits)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """At most so many common members of two sorted sets, by splitting both at the larger one's middle, `depth` times."""
    if depth == 0 or len(a) < 2 or len(b) < 2:
        return min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    m = len(a) // 2
    at = int(np.searchsorted(b, a[m]))
    return suffix_bound(a[:m], b[:at], depth - 1) + suffix_bound(a[m:], b[at:], depth - 1)


def _verify(percent: int):
    @tidy
    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                need = -(-percent * (len(a) + len(b)) // (100 + percent))
                if suffix_bound(a, b, 3) < need:
                    continue
                common = np.intersect1d(a, b, assume_unique=True).size
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            if keep.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _bitmap(ids: DataFrame, bits: int):
    """A broadcast bitmap of 2**bits bits with the ids' slots set: no row is lost by it, a few extra ones pass."""
    slot = F.pmod("id", F.lit(1 << bits))
    rows = ids.select(slot.alias("s")).distinct().select(F.expr("s div 32768").alias("k"), F.expr("s % 32768").alias("p")).groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bm"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for k, bm in rows.collect():
        out[k * 4096 : k * 4096 + len(bm)] = np.frombuffer(bytes(bm), dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out.tobytes())


def ngram_jaccard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, sketch_bits: int = 22, filter_bits: int = 26
) -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id), one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text with fewer than
    ``k`` words is one shingle, one without words (or null) has none and is linked with nothing.
    component_id is the least id reachable by links, its own included. Rows with a null id are
    returned with a null component. Repeated ids are rows of one node. Ids are whole numbers;
    other columns are ignored. An empty table gives no rows. A task needs a few times its
    longest text. Tables that the result reads stay in the shared folder until the application ends.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tmp = Scratch(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    scan = tmp.cut(base.mapInArrow(_scan(k, sketch_bits), "doc_id long, n long, digest binary, seg int, counts binary"), "scan")
    rows = scan.where("seg is null").select("doc_id", "n", "digest")
    ranks = np.zeros(1 << sketch_bits, dtype=np.uint8)
    parts = scan.where("seg is not null").select("seg", "counts").repartition(16, "seg").mapInArrow(_sum_segments, "seg int, ranks binary")
    for seg, r in parts.collect():  # a fixed 2**sketch_bits bytes in all
        ranks[seg * _SEG : (seg + 1) * _SEG] = np.frombuffer(bytes(r), dtype=np.uint8)
    sent = spark.sparkContext.broadcast(ranks.tobytes())

    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = tmp.cut(classes.select("digest", "rep", "n"), "classes")
    prefixes = base.where("doc_id is not null").mapInArrow(_prefixes(k, sketch_bits, percent, sent), "doc_id long, tokens array<long>")
    lists = tmp.cut(prefixes.join(reps.select(F.col("rep").alias("doc_id"), "n"), "doc_id"), "prefixes")
    tokens = lists.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    held = tmp.cut(tokens.join(shared, "token"), "held")

    def meets(x: str, y: str):
        """Length and positional filters of two rows for one token; exact at a pair's first common token."""
        na, nb, pa_, pb = (F.col(c).cast("long") for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) * (100 + percent) >= percent * (na + nb))

    def on_both(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
        """pairs with the two documents' columns, named x_ and y_."""
        for end, mark in (("a", "x"), ("b", "y")):
            pairs = pairs.join(rows.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{mark}_{c}") for c in cols]), end)
        return pairs

    def only(rows: DataFrame, ids: DataFrame, most: int, make, schema: str) -> DataFrame:
        """make(keep) of rows (doc_id, ...) whose id is among at most `most` ids, and perhaps of others."""
        bits = max(15, (8 * most - 1).bit_length())
        if bits > filter_bits:
            rows = rows.join(ids.distinct(), F.col("doc_id") == F.col("id"), "left_semi")
            return rows.mapInArrow(make(lambda batches: batches), schema)
        return rows.mapInArrow(make(_wanted(bits, _bitmap(ids, bits))), schema)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = tmp.cut(pairs.distinct(), f"pairs-{name}")
        ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
        few = only(lists.select("doc_id", "tokens", "n"), ends(pairs), 2 * pairs.count(), lambda keep: keep, "doc_id long, tokens array<long>, n long")
        # all common shingles stand in both prefixes but for those after the prefix that ends first
        rest_of = lambda m: F.col(f"{m}_n") - F.size(f"{m}_tokens")
        most = F.size(F.array_intersect("x_tokens", "y_tokens")) + F.greatest(rest_of("x"), rest_of("y"))
        near = on_both(pairs, few, "tokens", "n").where(most * (100 + percent) >= percent * (F.col("x_n") + F.col("y_n"))).select("a", "b")
        near = tmp.cut(near, f"near-{name}")
        whole = only(base.where("doc_id is not null"), ends(near), 2 * near.count(), lambda keep: _wanted_sets(k, keep), "doc_id long, members binary")
        sets = tmp.cut(whole, f"sets-{name}")
        found = tmp.cut(on_both(near, sets, "members").select("a", "b", "x_members", "y_members").mapInArrow(_verify(percent), "a long, b long").distinct(), f"links-{name}")
        tmp.drop(f"sets-{name}", f"near-{name}")
        return found

    # the holder that has a token earliest, as one sortable value
    early = held.groupBy("token").agg(F.min(F.struct("pos", "n", "doc_id")).alias("p")).select("token", "p.pos", "p.n", "p.doc_id")
    star = held.alias("x").join(early.alias("y"), "token").where((F.col("x.doc_id") != F.col("y.doc_id")) & meets("x", "y"))
    star = star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    first = links(star, "star")
    label = components(first, tmp, "star")

    known = held.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    known = tmp.cut(known, "known")
    mixed = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_ = known.join(mixed, "token")
    rest = open_.alias("x").join(open_.alias("y"), "token").where((F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.label") != F.col("y.label")) & meets("x", "y"))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    second = links(rest.join(tmp.spark.read.parquet(f"{tmp.root}/pairs-star"), ["a", "b"], "left_anti"), "rest")
    tmp.drop("held", "known", "prefixes")
    final = components(first.unionByName(second), tmp, "all")

    of_rep = reps.join(final.select(F.col("id").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    # texts without words have no digest and meet nothing
    full = rows.where("digest is not null").join(of_rep, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return full.unionByName(rows.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
