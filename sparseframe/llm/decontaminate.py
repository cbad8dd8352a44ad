"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, runs of white space become one space. An item of m
characters may be found with up to ``k = m * percent // 100`` edits. Cut into k + 1 pieces,
at least one piece stands unchanged wherever the item does. So: a rolling hash of every
position of every text is looked up among the distinct pieces' first characters; pieces
found there are compared whole. What remains is verified up a tree: of j neighbouring
pieces with j - 1 edits at most, one half has fewer edits than pieces again; so a piece's
hit counts only if its pair, then its four, and so on are there within their own budgets.
Around what passes the whole item is looked for: Myers' bit-parallel algorithm gives its
least edit distance to any stretch of the text.

Items are broadcast in blocks of at most ``block_chars`` characters; a larger benchmark
takes several passes over the documents. Documents are never shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, clean_name, sliced, tidy
from .kernels import U, powers

#: Characters of a piece that are hashed.
_GRAM = 16
_SEP = "\x00"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().replace(_SEP, " ").split())


def budget(m: int, percent: int) -> int:
    return m * percent // 100


def pieces(item: str, percent: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    m, k = len(item), budget(len(item), percent)
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of the whole pattern to any stretch of the text, and where the first such stretch ends; None over the limit."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a stretch may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= limit else None


class Index(NamedTuple):
    """Distinct pieces of a block of items, by the hash of their first characters."""

    ids: list[int | None]
    items: list[str]
    percent: int
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (hashes ascending, numbers of pieces)
    pieces: list[str]
    owners: list[list[tuple[int, int, int]]]  # of each piece: item, the piece's number in it, its offset
    min_chars: int  # shorter items stand whole, between word boundaries


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _grams(codes: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the g characters from each position on."""
    n = len(codes)
    if n < g:
        return np.zeros(0, dtype=U)
    out, chunk = np.empty(n - g + 1, dtype=U), 1 << 15
    power, inverse = powers(chunk + _GRAM + 1)
    for a in range(0, len(out), chunk):
        b = min(a + chunk, len(out))
        x = codes[a : b + g - 1].astype(U)
        x = (x + U(1)) * U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        acc = np.zeros(len(x) + 1, dtype=U)
        np.cumsum(x * power[: len(x)], dtype=U, out=acc[1:])
        out[a:b] = (acc[g:] - acc[:-g])[: b - a] * inverse[: b - a]
    return out


def index(rows: list[tuple[int | None, str]], percent: int, min_chars: int = 0) -> Index:
    """rows: ids and normalised texts. Items of under `min_chars` characters have no edit budget."""
    number: dict[str, int] = {}
    owners: list[list[tuple[int, int, int]]] = []
    for i, (_, item) in enumerate(rows):
        for q, (off, piece) in enumerate(pieces(item, percent if len(item) >= min_chars else 0)):
            at = number.setdefault(piece, len(number))
            if at == len(owners):
                owners.append([])
            owners[at].append((i, q, off))
    by_len: dict[int, list[int]] = {}
    known = list(number)
    for w, piece in enumerate(known):
        by_len.setdefault(min(len(piece), _GRAM), []).append(w)
    grams = {}
    for g, at in by_len.items():
        h = np.array([_grams(_codes(known[w][:g]), g)[0] for w in at], dtype=U)
        order = np.argsort(h, kind="stable")
        grams[g] = (h[order], np.array(at)[order])
    return Index([i for i, _ in rows], [t for _, t in rows], percent, grams, known, owners, min_chars)


def _apart(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends within a word."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


@lru_cache(maxsize=1 << 16)
def _above(count: int, q: int) -> tuple[tuple[int, int], ...]:
    """The ranges of pieces above piece q of `count`, smallest first, without the whole."""
    out, lo, hi = [], 0, count
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if q < mid else (mid, hi)
    return tuple(out[:0:-1])


def _beside(text: str, piece: str, at: int, right: bool) -> bool:
    """Whether the piece may stand with one edit at most from `at` on (right), or up to `at`: one half of it must be there, moved by one place at most."""
    h = len(piece) // 2
    near, far = (piece[:h], piece[h:]) if right else (piece[h:], piece[:h])
    if right:
        return text.startswith(near, at) or any(text.startswith(far, at + h + d) for d in (-1, 0, 1))
    a, b = at - len(near), at - len(piece)
    return (a >= 0 and text.startswith(near, a)) or any(b + d >= 0 and text.startswith(far, b + d) for d in (-1, 0, 1))


def _passes(text: str, item: str, cuts: list[int], q: int, start: int) -> bool:
    """Whether the ranges above piece q, found where the item would begin at `start`, are all within their budgets."""
    for lo, hi in _above(len(cuts) - 1, q):
        a, b, edits = cuts[lo], cuts[hi], hi - lo - 1
        if edits == 1:
            other = lo if q == hi - 1 else hi - 1
            if not _beside(text, item[cuts[other] : cuts[other + 1]], start + cuts[hi - 1], other > q):
                return False
        if myers(item[a:b], text[max(0, start + a - edits) : max(0, start + b + edits)], edits) is None:
            return False
    return True


def search(texts: list[str], ix: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, distance) of normalised texts: each item's best stretch in each text, where within its budget."""
    joined = _SEP.join(texts)
    codes = _codes(joined)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    budgets = [budget(len(t), ix.percent) if len(t) >= ix.min_chars else 0 for t in ix.items]
    cuts: dict[int, list[int]] = {}
    places: dict[tuple[int, int], set[int]] = {}
    exact: dict[tuple[int, int], int] = {}
    for g, (hashes, rows) in ix.grams.items():
        h = _grams(codes, g)
        mask = np.zeros(1 << 16, dtype=bool)
        mask[(hashes >> U(48)).astype(np.int64)] = True
        hit = np.flatnonzero(mask[(h >> U(48)).astype(np.int64)])
        lo = np.searchsorted(hashes, h[hit], "left")
        hi = np.searchsorted(hashes, h[hit], "right")
        sure = np.flatnonzero(hi > lo)
        rest = zip(hit[sure].tolist(), lo[sure].tolist(), hi[sure].tolist(), (np.searchsorted(begin, hit[sure], "right") - 1).tolist(), strict=True)
        for p, a, b, d in rest:
            for w in rows[a:b].tolist():
                piece = ix.pieces[w]
                if not joined.startswith(piece, p):
                    continue
                for i, q, off in ix.owners[w]:
                    item, start, key = ix.items[i], p - off - int(begin[d]), (d, i)
                    if key in exact and exact[key] <= start:
                        continue
                    if len(item) < ix.min_chars and not _apart(joined, p, p + len(piece)):
                        continue
                    if start >= 0 and texts[d].startswith(item, start):
                        exact[key] = start
                        continue
                    if not budgets[i] or key in exact or start in places.get(key, ()):
                        continue
                    if i not in cuts:
                        cuts[i] = [j * len(item) // (budgets[i] + 1) for j in range(budgets[i] + 2)]
                    if _passes(texts[d], item, cuts[i], q, start):
                        places.setdefault(key, set()).add(start)
    out = [(d, i, s, s + len(ix.items[i]), 0) for (d, i), s in exact.items()]
    for (d, i), starts in places.items():
        if (d, i) in exact:
            continue
        text, item, k = texts[d], ix.items[i], budgets[i]
        m, best = len(item), None
        # overlapping windows are searched as one
        spans: list[list[int]] = []
        for s in sorted(starts):
            a, b = max(0, s - k), min(len(text), s + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for a, b in spans:
            got = myers(item, text[a:b], k)
            if got and (best is None or got[0] < best[0]):
                back = myers(item[::-1], text[a : a + got[1]][::-1][: m + k], k)
                best = (got[0], a + got[1] - (back[1] if back else m), a + got[1])
        if best:
            out.append((d, i, best[1], best[2], best[0]))
    return sorted(out)


def _matcher(sent):
    @tidy
    def run(batches):
        ix = sent.value
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [normal(t) for t in batch.column(1).to_pylist()]
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], ix.ids[i], a, b, e, len(ix.items[i])) for d, i, a, b, e in search(texts, ix)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "distance", "item_chars"])

    return run


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, min_chars: int = 20, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_chars): each row's best stretch for each test item within the item's edit budget.

    start and end are character positions in the normalised text. Null and empty texts match
    nothing. Items of under `min_chars` normalised characters have no edit budget and are found
    only where they neither begin nor end within a word. Null and blank items match nothing; an
    item with a text but no id has a null item_id in its rows. Repeated documents and items
    give a row each, an empty table none; of equally distant stretches the first to end counts.
    Ids are whole numbers; columns but the ids and texts are ignored. A very long text is
    searched whole, in some tens of bytes a character.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    found = None
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else tests
        known = sorted(((r["item_id"], t) for r in part.collect() if (t := normal(r["text"]))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        got = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(index(known, percent, min_chars))), "doc_id long, item_id long, start long, end long, distance long, item_chars long")
        found = got if found is None else found.unionByName(got)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, broadcast_leaks: int = 1_000_000, **options) -> DataFrame:
    """docs without the rows whose text holds a test item within its edit budget. Clean rows stay as they are.

    The leaks' ids are written once; up to `broadcast_leaks` of them are broadcast, so that
    documents stay where they are, more are joined by shuffle. Rows with a null id stay.
    """
    flag = clean_name("_leak", docs.columns)
    found = matches(docs, items, id_col, text_col, percent, **options).select(F.col("doc_id").alias(flag)).where(F.col(flag).isNotNull()).distinct()
    leaks = Scratch(docs.sparkSession).cut(found, "leaks")
    if leaks.count() <= broadcast_leaks:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.col(f"`{id_col}`") == F.col(flag), "left_anti")
