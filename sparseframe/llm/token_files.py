"""Token ids in files of Simple-8b words, in ascending order of the documents' ids.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector tells how many ids
of what width the payload holds (SLOTS). An id of 60 bits or more is an escape: two words of
selector 15 with its lower and upper half. Ids are coded in blocks of BLOCK, each starting
at a word of its own whose offset is kept, so blocks are packed and unpacked side by side.

A *segment* holds whole documents: a header, the documents' ids and lengths, the blocks'
word offsets, the words. A token file is a Parquet file of segments (any store that Spark
writes to will do), one file for each range of document ids, segments in order:
``shard, seq, first`` (ids in the shard before it), ``n_ids, n_docs, data``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import Scratch, bounded_batches, input_bytes, sliced, tidy

BLOCK = 1024
#: Selector -> (ids in a word, bits of each).
SLOTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_U = np.uint64
#: Ids from which on a slot is too narrow, and the narrowest slot of each id under 65,536.
_LIMITS = np.array([1 << w for _, w in SLOTS], dtype=_U)
_NARROWEST = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=_U), side="right").astype(np.uint8)
_HEAD = struct.Struct("<4sIIIQQ")
_MAGIC = b"S8B1"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (unsigned 64-bit) -> words, and the word offset of each block and of the end."""
    n = len(ids)
    if not n:
        return np.zeros(0, _U), np.zeros(1, np.uint32)
    blocks = -(-n // BLOCK)
    wide = BLOCK + 64
    x = np.zeros((blocks, wide), dtype=_U)
    flat = np.zeros(blocks * BLOCK, dtype=_U)
    flat[:n] = ids
    x[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    # the narrowest slot for each id, and the largest of each run of 2**k ids
    need = _NARROWEST[np.minimum(x, _U(0xFFFF)).astype(np.uint16)]
    wide_ids = x > _U(0xFFFF)
    if wide_ids.any():
        need[wide_ids] = np.searchsorted(_LIMITS, x[wide_ids], side="right")
    runs = {1: need}
    k = 1
    while k < 32:
        m = runs[k].copy()
        m[:, :-k] = np.maximum(m[:, :-k], runs[k][:, k:])
        runs[2 * k] = m
        k *= 2
    best = np.full(x.shape, ESCAPE, dtype=np.uint8)
    least = int(need[:, :BLOCK].min()) if n >= BLOCK else 0
    for s in range(len(SLOTS) - 1, -1, -1):
        if s < least:
            break
        c = SLOTS[s][0]
        p = 1 << (c.bit_length() - 1)
        top = runs[p]
        if c > p:
            top = top.copy()
            top[:, : wide - (c - p)] = np.maximum(top[:, : wide - (c - p)], runs[p][:, c - p :])
        np.putmask(best, top <= s, s)
    step = np.array([c for c, _ in SLOTS] + [1, 1], dtype=np.int64)
    at, rows, where, sels, order = np.zeros(blocks, np.int64), [], [], [], []
    live, t = np.arange(blocks), 0
    while len(live):
        s = best[live, at[live]]
        rows.append(live)
        where.append(at[live])
        sels.append(s)
        order.append(np.full(len(live), t))
        at[live] += step[s]
        live = live[at[live] < length[live]]
        t += 1
    row, pos, sel, turn = (np.concatenate(v) for v in (rows, where, sels, order))
    cells, at = x.ravel(), row * wide + pos
    words = np.zeros(len(row), dtype=_U)
    high = np.zeros(len(row), dtype=_U)
    for s, (c, w) in enumerate(SLOTS):
        i = np.flatnonzero(sel == s)
        if len(i):
            from_, v = at[i], np.zeros(len(i), dtype=_U)
            for d in range(c):
                v |= cells.take(from_ + d) << _U(d * w)
            words[i] = v | _U(s << 60)
    esc = np.flatnonzero(sel == ESCAPE)
    if len(esc):
        v = x[row[esc], pos[esc]]
        words[esc] = (v & _U(0xFFFFFFFF)) | _U(ESCAPE << 60)
        high[esc] = (v >> _U(32)) | _U(ESCAPE << 60)
    rank = np.lexsort((turn, row))
    words, high, row, sel = words[rank], high[rank], row[rank], sel[rank]
    size = 1 + (sel == ESCAPE)
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=_U)
    out[first] = words
    out[first[sel == ESCAPE] + 1] = high[sel == ESCAPE]
    offs = np.zeros(blocks + 1, dtype=np.uint32)
    offs[1:] = np.cumsum(np.bincount(row, weights=size, minlength=blocks)).astype(np.uint32)
    return out, offs


def unpack(words: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words whose blocks start at offs."""
    out = np.zeros(n, dtype=_U)
    if not n:
        return out
    sel = (words >> _U(60)).astype(np.int64)
    count = np.array([c for c, _ in SLOTS] + [0, 1], dtype=np.int64)[sel]
    esc = np.flatnonzero(sel == ESCAPE)  # in pairs
    count[esc[1::2]] = 0
    block = np.repeat(np.arange(len(offs) - 1), np.diff(offs.astype(np.int64)))
    total = np.cumsum(count) - count
    pos = total - total[offs[:-1].astype(np.int64)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s, (c, w) in enumerate(SLOTS):
        i = np.flatnonzero(sel == s)
        if not len(i):
            continue
        mask, p = _U((1 << w) - 1), pos[i]
        # a block's last word may hold more slots than ids are left
        short = p + c > stop[i]
        whole = i[~short]
        v, p = words[whole], pos[whole]
        for d in range(c):
            out[p + d] = (v >> _U(d * w)) & mask
        for k in i[short].tolist():
            left = int(stop[k] - pos[k])
            out[pos[k] : pos[k] + left] = (words[k] >> (np.arange(left, dtype=_U) * _U(w))) & mask
    if len(esc):
        low, top = words[esc[0::2]] & _U(0xFFFFFFFF), words[esc[1::2]] & _U(0xFFFFFFFF)
        out[pos[esc[0::2]]] = low | (top << _U(32))
    return out


def segment(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents: their ids (and whether they have one), their lengths, and all their token ids."""
    words, offs = pack(ids.astype(_U))
    head = _HEAD.pack(_MAGIC, len(lengths), len(offs) - 1, BLOCK, len(ids), len(words))
    return b"".join((head, known.astype("u1").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), offs.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def dump(doc_ids: Sequence[int | None], docs: Sequence[np.ndarray]) -> bytes:
    names, known = np.array([0 if d is None else d for d in doc_ids]), np.array([d is not None for d in doc_ids])
    return segment(names, known, np.array([len(d) for d in docs]), np.concatenate([np.asarray(d, _U) for d in docs]) if docs else np.zeros(0, _U))


def load(data) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A segment's document ids, their lengths and all their token ids."""
    magic, n_docs, n_blocks, block, n_ids, n_words = _HEAD.unpack_from(data)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a token segment")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        v = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += v.nbytes
        return v

    known, names, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
    offs, words = take("<u4", n_blocks + 1), take("<u8", n_words)
    return pa.array(names.astype(np.int64), mask=known == 0), lengths.astype(np.int64), unpack(words, offs, n_ids)


_FILE = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("data", pa.binary())])


def _writer(path: str, end_id: int | None, segment_ids: int):
    @tidy
    def run(batches):
        enc, shard = encoder(path, 1 << 40), TaskContext.get().partitionId()
        held, seq, first = [], 0, 0

        def made():
            nonlocal held, seq, first
            names, known, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "first": first, "n_ids": len(ids), "n_docs": len(names), "data": segment(names, known, lengths, ids)}], schema=_FILE)
            first, seq, held = first + len(ids), seq + 1, []
            return row

        for whole in batches:
            for batch in sliced(whole, "text"):
                ids, offs = enc.encode_column(batch.column(1))
                if end_id is not None:
                    ids = np.insert(ids, offs[1:], end_id)
                    offs = offs + np.arange(len(offs))
                names = batch.column(0)
                held.append((names.fill_null(0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), ids))
                if sum(len(h[3]) for h in held) >= segment_ids:
                    yield made()
        if held:
            yield made()

    return run


def write_tokens(
    docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2, segment_ids: int = 1 << 18, range_bytes: int = 256 << 20
) -> None:
    """Encodes every whole text (null: empty), ends it with `end_id`, and writes token files to `out` in ascending id order.

    Ids are whole numbers; null ids come first. Rows of one id are ordered by a hash of their
    text, so that they too can be dealt to several files; equal rows are all written. Other
    columns are ignored. One range exchange, its bounds by sampling: about `range_bytes` of
    the input to a range and a file, and two ranges for each core at least.
    A segment ends with the slice (1 MB of text, or one longer text) that brings it to
    `segment_ids` ids. An empty table gives no segment. A task needs a few times its longest text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n = max(2 * spark.sparkContext.defaultParallelism, -(-(input_bytes(rows) or 0) // range_bytes))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ddl = "shard int, seq int, first long, n_ids long, n_docs int, data binary"
    ordered.mapInArrow(_writer(path or vocabulary_path(), end_id, segment_ids), ddl).write.mode("overwrite").option("compression", "none").parquet(out)


#: Columns that reading can give besides doc_id and start.
READS = {"n_tokens": ("long", pa.int64()), "ids": ("array<long>", pa.list_(pa.int64())), "ids_crc32": ("long", pa.int64())}


def _crcs(ids: np.ndarray, offs: np.ndarray) -> list[int]:
    raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * offs).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _reader(outputs: Sequence[str]):
    make = {"n_tokens": lambda ids, offs: np.diff(offs), "ids": lambda ids, offs: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int64))), "ids_crc32": _crcs}

    @tidy
    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, lengths, ids = load(blob.as_buffer())
                offs = np.concatenate(([0], np.cumsum(lengths)))
                cols = [x if isinstance(x := make[o](ids, offs), pa.Array) else pa.array(x, READS[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays([names, pa.array(offs[:-1] + start, pa.int64()), *cols], names=["doc_id", "start", *outputs])

    return run


def read_tokens(spark: SparkSession, where: str, outputs: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """Token files -> (doc_id, start, *outputs) per document; start counts the ids of all documents before it."""
    bounded_batches(spark)
    files = spark.read.schema("shard int, seq int, first long, n_ids long, n_docs int, data binary").parquet(where)
    # one row for each file, as many as the tasks that wrote them
    sizes = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for shard, n in sizes:
        before.append((shard, total))
        total += n
    base = spark.createDataFrame(before, "shard int, base long")
    rows = files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("start"), "data")
    schema = ", ".join(["doc_id long", "start long", *[f"{o} {READS[o][0]}" for o in outputs]])
    return rows.mapInArrow(_reader(tuple(outputs)), schema)


def token_files(docs: DataFrame, out: str | None = None, outputs: Sequence[str] = ("n_tokens", "ids_crc32"), **options) -> DataFrame:
    """Writes the files (to the shared folder unless `out` is given) and reads them back."""
    spark = docs.sparkSession
    tmp = Scratch(spark)
    write_tokens(docs, out or f"{tmp.root}/tokens", **options)
    if out is None:
        out = f"{tmp.root}/tokens"
        tmp.expire()
    return read_tokens(spark, out, outputs)
