"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and multi-byte characters, A-Z lower-cased. Features
of a text are the distinct slots (of ``2**bits``) of its words, its pairs of neighbours and
its pairs with one word between. FTRL-proximal keeps a rate for each coordinate and, by its
L1 term, leaves most weights at exactly zero, so the model is a short list of slots and
weights; all that are not zero are kept (at most ``2**bits``, 12 bytes each).

Training takes the labelled texts with the least hash of their id, at most ``max_train`` and
at most ``max_train_bytes`` of text; one task learns from them in order of that hash. Scoring
reads every whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean_name, crc_mod4, kept_columns, sliced, tidy
from .kernels import ALNUM, LOWER, U, hash_spans, mix, utf8, words


class Model(NamedTuple):
    """Slots in ascending order with their weights, and the intercept."""

    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def features(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all texts of a column one after the other (repeats included), and each slot's row."""
    data, offs = utf8(col)
    data = LOWER[data]
    starts, ends, first = words(data, offs, ALNUM)
    h = hash_spans(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = U(64 - bits)
    slots, rows = [h >> shift], [row]
    for gap, salt in ((1, 0x1B873593CC9E2D51), (2, 0x85EBCA77C2B2AE63)):
        if len(h) > gap:
            both = mix(h[:-gap] * U(salt) + h[gap:])
            same = row[:-gap] == row[gap:]
            slots.append(both[same] >> shift)
            rows.append(row[:-gap][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


def _sets(col: pa.Array, bits: int) -> list[np.ndarray]:
    slots, rows = features(col, bits)
    key = np.unique((rows << bits) | slots)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key, np.arange(1, len(col)) << bits))


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features (McMahan et al., 2013)."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, x: np.ndarray) -> np.ndarray:
        z = self.z[x]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[x])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, x: np.ndarray, y: int, scale: float) -> None:
        w, b = self.weights(x), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = (p - y) * scale
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[x] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def _trainer(bits: int, max_train: int, max_train_bytes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    @tidy
    def run(batches):
        sets: list[np.ndarray] = []
        ys: list[int] = []
        room = max_train_bytes
        for whole in batches:
            for batch in sliced(whole, "text"):
                fits = []
                for size in pa.compute.binary_length(batch.column(0)).to_pylist():
                    fits.append(size <= room and len(sets) + sum(fits) < max_train)
                    room -= size if fits[-1] else 0
                part = batch.filter(pa.array(fits))
                if len(part):
                    sets += [s.astype(np.int32) for s in _sets(part.column(0), bits)]
                    ys += part.column(1).to_pylist()
        model = Ftrl(bits, alpha, beta, l1, l2)
        for _ in range(epochs):
            for x, y in zip(sets, ys, strict=True):
                model.learn(x, y, 1.0)
        x = np.flatnonzero(np.abs(model.z) > l1)
        w = model.weights(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *x.tolist()], pa.int64()), pa.array([model.bias() if ys else 0.0, *w.tolist()], pa.float64())], names=["slot", "weight"])

    return run


def _bound(ids: DataFrame, max_train: int):
    """The largest of the `max_train` least hashes of ids; None without ids."""
    return ids.select(F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("h").limit(max_train).agg(F.max("h")).first()[0]


def _fit(sample: DataFrame, bits: int = 20, max_train: int = 20_000, max_train_bytes: int = 96 << 20, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0) -> Model:
    """sample (h, id, text, label), in order of (h, id, label, text)."""
    bounded_batches(sample.sparkSession)
    ordered = sample.repartition(1).sortWithinPartitions("h", "id", "label", "text").select("text", "label")
    got = ordered.mapInArrow(_trainer(bits, max_train, max_train_bytes, epochs, alpha, beta, l1, l2), "slot long, weight double").collect()
    table = {r["slot"]: r["weight"] for r in got}
    bias = table.pop(-1, 0.0)
    slots = np.array(sorted(table), dtype=np.int64)
    return Model(bits, slots, np.array([table[s] for s in slots.tolist()]), bias)


def train(rows: DataFrame, max_train: int = 20_000, **training) -> Model:
    """rows (id, text, label 0/1) -> Model. Rows with a null text or label are left out; no rows give a model that scores 0.5.

    A text that no more fits into `max_train_bytes` is passed over. Rows of one id follow one
    another; equal rows each count.
    """
    seen = rows.where("text is not null and label is not null").select("id", "text", F.col("label").cast("int").alias("label"), F.xxhash64(F.col("id").cast("string")).alias("h"))
    # ids first, so that only the sample's texts move
    bound = _bound(seen.select("id"), max_train)
    if bound is None:
        return Model(training.get("bits", 20), np.zeros(0, np.int64), np.zeros(0), 0.0)
    return _fit(seen.where(F.col("h") <= bound), max_train=max_train, **training)


def scores(col: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 for each text; null and empty texts get the intercept's."""
    slots, rows = features(col, model.bits)
    total = np.full(len(col), model.bias)
    if len(model.slots):
        mark = np.zeros(1 << model.bits, dtype=bool)
        mark[model.slots] = True
        hit = mark[slots]
        key = np.unique((rows[hit] << model.bits) | slots[hit])
        at = np.searchsorted(model.slots, key & ((1 << model.bits) - 1))
        np.add.at(total, key >> model.bits, model.weights[at])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scorer(sent, n_cols: int, threshold: float):
    @tidy
    def run(batches):
        model = sent.value
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[n_cols]):
                p = scores(batch.column(n_cols), model)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names[:n_cols], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep=("doc_id",), threshold: float = 0.3) -> DataFrame:
    """docs -> the columns `keep`, score (0 to 1) and predicted (1 if score >= threshold) for every row; no shuffle.

    A null or empty text gets the intercept's score. Rows are independent: repeated rows each
    come back, equal texts have equal scores, an empty table gives no rows. A kept column named
    like an output is dropped, other columns are ignored. A very long text is scored whole, in
    some ten times its size of memory.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = kept_columns(docs, keep, ("score", "predicted"))
    text = clean_name("_text", [*keep, "score", "predicted"])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    return rows.mapInArrow(_scorer(sent, len(keep), threshold), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, **training) -> DataFrame:
    """docs (id, text), labels (id, label) -> (doc_id, held_out, score, predicted), one row per input row.

    Trains on the labelled documents whose crc32(id as text) mod 4 is not 2. Labels, and any
    other column, are no inputs of a score. Ids are whole numbers. A null id is not held out and
    never trained on. An id with several labels or texts trains with each pair of them.
    Without usable labels every score is 0.5.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where((crc_mod4(F.col("id")) != 2) & F.col("label").isNotNull()).distinct()
    bound = _bound(marks.select("id").distinct(), max_train)
    if bound is None:
        model = Model(training.get("bits", 20), np.zeros(0, np.int64), np.zeros(0), 0.0)
    else:
        # at most max_train ids with their one or two labels: texts are read where they are, and only the sample's move
        marks = marks.withColumn("h", F.xxhash64(F.col("id").cast("string"))).where(F.col("h") <= bound)
        near = rows.where(F.col("text").isNotNull() & (F.xxhash64(F.col("doc_id").cast("string")) <= bound))
        model = _fit(near.join(F.broadcast(marks), F.col("id") == F.col("doc_id")).select("h", "id", "text", "label"), max_train=max_train, **training)
    out = score(rows, model)
    return out.select("doc_id", F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
