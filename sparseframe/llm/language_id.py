"""Language identification by multilingual mixtures.

Training counts the byte trigrams of lower-cased words (with a space at either end), hashed
to ``2**bits`` slots, for each language of a bounded sample of its texts. A word's likelihood
under a language is the product of its trigrams'. A text is a mixture: words are drawn from
languages in unknown proportions, which expectation-maximisation estimates. Languages enter
in the order of their proportions under the full mixture; the set kept is the one with the
best log-likelihood less ``penalty * ln(words)`` for each language after the first, and the
prediction is the language of the largest proportion in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean_name, crc_mod4, kept_columns, sliced, tidy
from .kernels import utf8, words

#: What may stand in a word: ASCII letters and all bytes of longer characters.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Languages whose counts a task holds at once, and for which texts of 1 MB are looked at together (fewer where there are more languages).
_HELD = 64
#: Values looked up at once.
_LOOKED_UP = 1 << 24


class Model(NamedTuple):
    langs: list[str]
    bits: int
    logp: np.ndarray  # (slots, languages), float32


def _trigrams(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all trigrams, the index of each word's first one, and of each row's first word."""
    data, offs = utf8(col)
    starts, ends, first = words(data, offs, _LETTER)
    # words with a space on either side, one after the other: " the and " shares none
    size = ends - starts + 2
    at = np.cumsum(size) - size
    x = np.full(int(size.sum()), 0x20, dtype=np.uint32)
    inside = np.ones(len(x), dtype=bool)
    inside[at] = False
    inside[at + size - 1] = False
    x[inside] = data[_LETTER[data]]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    g = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    slot = ((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)
    good = np.ones(len(g), dtype=bool)
    good[at[1:] - 1] = False
    good[at[1:] - 2] = False
    return slot[good], at - 2 * np.arange(len(at)), first


def _lower(col: pa.Array) -> pa.Array:
    return pa.compute.utf8_lower(col)


def _counter(bits: int):
    def flush(total):
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "slot", "n"])
        total.clear()

    @tidy
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in sliced(whole, "text"):
                langs = batch.column(1).to_pylist()
                slots, start, first = _trigrams(_lower(batch.column(0)), bits)
                bounds = np.append(start, len(slots))[first] if len(start) else np.zeros(len(first), np.int64)
                for i, lang in enumerate(langs):
                    got = np.bincount(slots[bounds[i] : bounds[i + 1]], minlength=1 << bits)
                    total[lang] = total[lang] + got if lang in total else got
                    if len(total) > _HELD:
                        yield from flush(total)
        yield from flush(total)

    return run


def train(rows: DataFrame, bits: int = 16, max_train: int = 20_000, smoothing: float = 0.5) -> Model:
    """rows (id, text, lang) -> Model of every lang, each from about `max_train` of its rows at most: all where it has no more, else those whose id's hash is under the lang's own bound.

    The model has ``2**bits`` slots of 4 bytes for each language, 262 kB at 16 bits.
    """
    bounded_batches(rows.sparkSession)
    seen = rows.where("text is not null and lang is not null").select("text", "lang", F.xxhash64(F.col("id").cast("string")).alias("h"))
    sizes = seen.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # a row for each language
    if not sizes:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32))
    langs = sorted(r["lang"] for r in sizes)
    # the least hash is always in: repeated ids may share one far above the bound
    bounds = [(r["lang"], max(r["least"], min((max_train << 64) // r["n"], 1 << 64) - (1 << 63) - 1)) for r in sizes]
    bound = rows.sparkSession.createDataFrame(bounds, "lang string, bound long")
    sample = seen.join(F.broadcast(bound), "lang").where("h <= bound").select("text", "lang")
    counts = sample.mapInArrow(_counter(bits), "lang string, slot long, n long")
    logp = np.empty((1 << bits, len(langs)), np.float32)
    logp[:] = -np.log(1 << bits)  # of a language whose texts have no letters
    slots = 1 << bits

    def packed(table: pa.Table) -> pa.Table:
        n = np.full(slots, smoothing)
        n[table["slot"].to_numpy()] += table["n"].to_numpy()
        return pa.table({"lang": table["lang"][:1], "logp": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    # at most 2**bits rows a language meet, and one row of 2**(bits + 2) bytes a language comes to the driver
    summed = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    for lang, row in summed.groupBy("lang").applyInArrow(packed, "lang string, logp binary").toLocalIterator():
        logp[:, langs.index(lang)] = np.frombuffer(bytes(row), np.float32)
    return Model(langs, bits, logp)


def _sums(x: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x (words, ...) by row, for rows that may have no words."""
    out = np.zeros((len(first) - 1, *x.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(x, first[full], axis=0)
    return out


def _em(like: np.ndarray, row: np.ndarray, first: np.ndarray, allowed: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions by text, and the words' log-likelihood by text. like: (words, languages), at most 1 each; allowed: (texts, languages)."""
    n = np.maximum(np.diff(first), 1)[:, None]
    pi = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(iterations):
        r = like * pi.astype(np.float32)[row]
        r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
        pi = _sums(r, row, first) / n
    mix = (like * pi.astype(np.float32)[row]).sum(axis=1) + np.float32(1e-30)
    return pi, _sums(np.log(mix)[:, None], row, first)[:, 0]


def _likelihoods(logp: np.ndarray, slots: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of logp over each word's trigrams: (words, languages). Words are taken some at a time."""
    out = np.zeros((len(start), logp.shape[1]), np.float32)
    ends, most, a = np.append(start[1:], len(slots)), max(1, _LOOKED_UP // max(logp.shape[1], 1)), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, start[a] + most, "right")))
        out[a:b] = np.add.reduceat(logp[slots[start[a] : ends[b - 1]]], start[a:b] - start[a], axis=0)
        a = b
    return out


def predict(col: pa.Array, model: Model, iterations: int = 8, penalty: float = 2.0) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: the language (`und` without a letter), its share in the mixture, and how many languages were kept."""
    m, k = len(col), len(model.langs)
    low = _lower(col)
    slots, start, first = _trigrams(low, model.bits)
    letters = np.diff(first) > 0
    # bytes above 0x7F may be signs rather than letters: those texts are looked at one by one
    texts = low.to_pylist()
    for i in np.flatnonzero(letters):
        if not any(map(str.isalpha, texts[i][:64])) and not any(map(str.isalpha, texts[i])):
            letters[i] = False
    if not k:
        return ["und"] * m, np.zeros(m), np.zeros(m, np.int64)
    row = np.repeat(np.arange(m), np.diff(first))
    logl = _likelihoods(model.logp, slots, start)
    # per word only ratios matter; e**-30 is the least that counts
    like = np.exp(np.maximum(logl - logl.max(axis=1, keepdims=True), np.float32(-30))) if len(logl) else logl
    best_pi, _ = _em(like, row, first, np.ones((m, k)), iterations)
    order = np.argsort(-best_pi, axis=1, kind="stable")
    cost = penalty * np.log(np.maximum(np.diff(first), 2))
    best = np.full(m, -np.inf)
    share, size, pick = np.zeros(m), np.zeros(m, np.int64), order[:, 0].copy()
    live = np.arange(m)
    for take in range(1, k + 1):
        allowed = np.zeros((m, k))
        np.put_along_axis(allowed, order[:, :take], 1.0, axis=1)
        on = np.isin(row, live) if len(live) < m else slice(None)
        sub = row[on]
        where = np.searchsorted(sub, np.arange(m + 1))
        pi, ll = _em(like[on], sub, where, allowed, iterations if take > 1 else 0)
        value = ll - cost * (take - 1)
        better = np.zeros(m, dtype=bool)
        better[live] = value[live] > best[live]
        best[better], size[better] = value[better], take
        pick[better] = pi[better].argmax(axis=1)
        share[better] = pi[better].max(axis=1)
        # a further language can only pay where it would have a share worth its cost
        live = np.flatnonzero(better & (take < k))
        if take < k and len(live):
            nxt = best_pi[live, order[live, take]]
            live = live[nxt * np.diff(first)[live] * 30 > cost[live]]
        if not len(live):
            break
    langs = [model.langs[p] if ok else "und" for p, ok in zip(pick, letters, strict=True)]
    return langs, np.where(letters, np.clip(share, 0, 1), 0.0), np.where(letters, size, 0)


def _predictor(sent, n_cols: int, iterations: int, penalty: float):
    @tidy
    def run(batches):
        model = sent.value
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[n_cols], (1 << 20) * _HELD // max(_HELD, len(model.langs))):
                langs, share, size = predict(pa.compute.fill_null(batch.column(n_cols), ""), model, iterations, penalty)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(langs, pa.string()), pa.array(share, pa.float64()), pa.array(size, pa.int64())], names=[*batch.schema.names[:n_cols], "lang_pred", "score", "n_langs"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep=("doc_id",), iterations: int = 8, penalty: float = 2.0) -> DataFrame:
    """docs -> the columns `keep`, lang_pred, score (the language's share) and n_langs (languages in the mixture) for every row; no shuffle.

    A null, empty or letterless text is `und` with score 0. Of languages with equal shares the
    first by name is predicted. Rows are independent: repeated rows each come back, an empty
    table gives no rows. A kept column named like an output is dropped, other columns are
    ignored. A very long text is looked at whole: its words times the languages are in memory.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = kept_columns(docs, keep, ("lang_pred", "score", "n_langs"))
    text = clean_name("_text", [*keep, "lang_pred", "score", "n_langs"])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double", "n_langs long"])
    return rows.mapInArrow(_predictor(sent, len(keep), iterations, penalty), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """docs -> (doc_id, held_out, lang_pred, score, n_langs), one row per input row.

    Learns from rows with a lang whose crc32(id as text) mod 4 is not 2; only the text is an
    input of a prediction. A null or letterless text is `und` with score 0, and so is every
    text where no language can be learned. Ids are whole numbers; a null id is not held out and
    never learned from. Repeated rows are each learned from and come back.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = train(rows.where(crc_mod4(F.col("doc_id")) != 2).select(F.col("doc_id").alias("id"), "text", "lang"), **training)
    out = identify(rows.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")
