"""Personal data: exact patterns, and a linear-chain CRF over word shapes.

The base patterns (email, ip, card, phone) find what has a fixed form. The CRF adds spans of
what hasn't: secrets (keys, passwords, tokens) and id numbers. It tags the words of a line by
binary shape features of a word and its neighbours, is trained from a small labelled table by
maximum likelihood, and is decoded by Viterbi over all lines of a batch at once. Lines where
no word's features can outweigh "nothing" are known to be untagged and skip the recursion.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean_name, sliced, tidy
from .kernels import LOWER, hash_spans, utf8, words

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "id_number")
KINDS = BASE + ADDED

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The ip pattern, for whole runs of digits only: a match never begins or ends within one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = "A-Za-z0-9._%+-"
_ONE_LOCAL = re.compile(rf"[{_LOCAL}]")
#: The email pattern from an "@" on; what stands before it is walked back to.
_AFTER = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each "@"."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and _ONE_LOCAL.match(text[a - 1]):
            a -= 1
        m = _AFTER.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start; failing matches are dropped and not tried again."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- features ---------------------------------------------------------------------------

# Words that announce a secret or an id number.
_SECRET_WORDS = "token key secret password passwd pwd apikey api_key access_key auth bearer credential credentials passphrase pin".split()
_ID_WORDS = "ssn passport iban id account acct licence license social insurance tax taxid nino tin".split()

_CLASSES = {
    "digit": b"0123456789",
    "hex": b"abcdefABCDEF",
    "lower": bytes(range(0x61, 0x7B)),
    "upper": bytes(range(0x41, 0x5B)),
    "dash": b"-",
    "quote": b"\"'`",
    "sets": b"=:",
    "other": bytes(range(0x80, 0x100)),
}
_LUT = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASSES.items()}

_SHAPES = ["bias", "digits", "mixed", "numeric", "hex16", "hex32", "len1", "len4", "len8", "len16", "len32", "dashed", "quoted", "sets", "capital", "capitals", "foreign", "grouped", "iban", "secret_word", "id_word", "lone_sets"]
_NEAR = ["numeric", "mixed", "sets", "secret_word", "id_word", "lone_sets", "hex16", "dashed"]
FEATURES = [*_SHAPES, *[f"prev_{n}" for n in _NEAR], "prev2_secret_word", "prev2_id_word", *[f"next_{n}" for n in ("numeric", "sets")]]


def _word_hash(names: list[str]) -> np.ndarray:
    data = "".join(names).encode()
    ends = np.cumsum([len(n) for n in names])
    return np.sort(hash_spans(np.frombuffer(data, np.uint8), ends - [len(n) for n in names], ends))


_SECRET_HASHES, _ID_HASHES = _word_hash(_SECRET_WORDS), _word_hash(_ID_WORDS)


def _sum(lut: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    # white space counts in no class, so a word's sum may run to the next word's start
    return np.add.reduceat(lut[data], starts, dtype=np.int32)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
    """(words, FEATURES) of 0 and 1; `line` numbers the words' lines, whose words alone are neighbours."""
    n = len(starts)
    x = np.zeros((n, len(FEATURES)), dtype=np.float32)
    if not n:
        return x
    c = {k: _sum(v, data, starts) for k, v in _LUT.items()}
    size = ends - starts
    letters = c["lower"] + c["upper"]
    core = c["digit"] + letters
    # a word's letters without signs around it: hashed as it stands, and without a last sign
    low = LOWER[data]
    last_sign = np.isin(low[ends - 1], list(b"=:,.;"))
    trimmed = np.maximum(ends - last_sign, starts + 1)
    h = hash_spans(low, starts, trimmed)
    member = lambda v: v[np.minimum(np.searchsorted(v, h), len(v) - 1)] == h
    col = {
        "bias": np.ones(n, bool),
        "digits": c["digit"] > 0,
        "mixed": (c["digit"] >= 2) & (letters >= 2) & (core >= 8),
        "numeric": (c["digit"] >= 3) & (letters == 0),
        "hex16": (c["digit"] + c["hex"] == core) & (core >= 16) & (c["digit"] > 0) & (letters > 0),
        "hex32": (c["digit"] + c["hex"] == core) & (core >= 32) & (c["digit"] > 0) & (letters > 0),
        "len1": size <= 3,
        "len4": (size > 3) & (size <= 7),
        "len8": (size > 7) & (size <= 15),
        "len16": (size > 15) & (size <= 31),
        "len32": size > 31,
        "dashed": (c["dash"] >= 1) & (c["digit"] >= 3),
        "quoted": c["quote"] >= 2,
        "sets": last_sign & np.isin(low[ends - 1], list(b"=:")),
        "capital": (c["upper"] == 1) & (letters > 1),
        "capitals": (c["upper"] == letters) & (letters > 1),
        "foreign": c["other"] > 0,
        "grouped": (c["dash"] == 2) & (c["digit"] == 9) & (letters == 0),
        "iban": (c["upper"] == 2) & (c["lower"] == 0) & (c["digit"] >= 12) & (core == size),
        "secret_word": member(_SECRET_HASHES),
        "id_word": member(_ID_HASHES),
        "lone_sets": (core == 0) & (size <= 2) & (c["sets"] > 0),
    }
    for j, name in enumerate(_SHAPES):
        x[:, j] = col[name]
    at = {name: j for j, name in enumerate(FEATURES)}
    same = line[1:] == line[:-1]
    for name in _NEAR:
        x[1:, at[f"prev_{name}"]] = x[:-1, at[name]] * same
    for name in ("secret_word", "id_word"):
        x[2:, at[f"prev2_{name}"]] = x[:-2, at[name]] * (line[2:] == line[:-2])
    for name in ("numeric", "sets"):
        x[:-1, at[f"next_{name}"]] = x[1:, at[name]] * same
    return x


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, the first word of each row, and the number of each word's line."""
    starts, ends, first = words(data, offs)
    breaks = np.cumsum(data == 0x0A) if len(data) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = breaks[starts] + row if len(starts) else starts
    return starts, ends, first, line


# --- model ------------------------------------------------------------------------------


class Model(NamedTuple):
    """Labels are "nothing" and ADDED, in this order."""

    emit: np.ndarray  # (features, labels)
    step: np.ndarray  # (from, to)


def labelled_table() -> list[tuple[str, list[str]]]:
    """A small labelled table made by rule: sentences and their words' labels."""
    hexa = lambda i, n: (hashlib.sha256(f"h{i}".encode()).hexdigest() * 2)[:n]
    num = lambda i, n: str(int(hashlib.sha256(f"n{i}".encode()).hexdigest(), 16))[:n]
    base62 = lambda i, n: "".join(c.upper() if k % 3 == 1 else c for k, c in enumerate(hexa(i, n).replace("a", "x").replace("e", "q")))
    plain = ["The meeting of the board was long", "Version 3.1 of the licence, as of 2007.", "He paid 1,200 for 25 seats in 2019", "Chapter 12 begins on page 345", "In $$$ the&&& house*** of### all%%%", "Été en mer, où sont les autres?", "die Häuser, und der Weg dorthin", "LICENSED UNDER CC BY-NC 4.0.", "Call it a key idea of the account", "token economies are not new", "the password was never found there", "A-B tests and 10-year bonds", "| 12 | 45.3 | 1999 |", "id est, that is", "a key to the door : brass", "10:30 to 11:45 on 2020-05-17", "its tax on 5000 tons", "order 66 of 2021", "ISBN numbers are printed on books", "1234567 people and 42 more"]
    table = [(s, ["-"] * len(s.split())) for s in plain for _ in range(3)]
    for i in range(24):
        key = ("token", "api_key", "password", "secret", "access_key", "TOKEN", "key", "passwd")[i % 8]
        value = hexa(i, (40, 32, 64, 24)[i % 4]) if i % 3 else base62(i, 24)
        value = value.upper() if i % 6 == 5 else value
        mark = ("=", ":")[i % 2]
        quote = '"' if i % 4 < 3 else ""
        table.append((f"then the {key} {mark} {quote}{value}{quote} was of use", ["-"] * 4 + ["secret"] + ["-"] * 3))
        table.append((f"see {key}{mark} {quote}{value}{quote}, and on", ["-"] * 2 + ["secret"] + ["-"] * 2))
        table.append((f"with {quote}{hexa(i + 90, 40)}{quote} alone", ["-", "secret", "-"]))
    for i in range(12):
        table.append((f"{num(i + 7, 12 + i % 6)} of them", ["-"] * 3))
        table.append((f"then {num(i + 31, 13 + i % 7)}, and on", ["-"] * 4))
        table.append((num(i + 77, 16), ["-"]))
        ssn = f"{num(i, 3)}-{num(i + 50, 2)}-{num(i + 99, 4)}"
        table.append((f"his SSN is {ssn} they say", ["-"] * 3 + ["id_number"] + ["-"] * 2))
        table.append((f"ssn: {ssn}", ["-", "id_number"]))
        table.append((f"to IBAN {('DE', 'FR', 'ES')[i % 3]}{num(i, 20)} by Monday", ["-"] * 2 + ["id_number"] + ["-"] * 2))
        table.append((f"passport {num(i, 9)} was lost", ["-", "id_number", "-", "-"]))
    return table


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis=axis, keepdims=True)
    return np.log(np.exp(v - m).sum(axis=axis)) + m.squeeze(axis)


def gradient(emit: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of a line's labels y with features x, and its derivatives by emit and step (forward-backward)."""
    e, n, k = x @ emit, len(y), len(step)
    fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
    fwd[0] = e[0]
    for t in range(1, n):
        fwd[t] = e[t] + _lse(fwd[t - 1][:, None] + step, 0)
    for t in range(n - 2, -1, -1):
        bwd[t] = _lse(step + (e[t + 1] + bwd[t + 1])[None, :], 1)
    z = _lse(fwd[-1], 0)
    d_emit, d_step = x.T @ (np.eye(k)[y] - np.exp(fwd + bwd - z)), np.zeros((k, k))
    for t in range(1, n):
        d_step[y[t - 1], y[t]] += 1
        d_step -= np.exp(fwd[t - 1][:, None] + step + (e[t] + bwd[t])[None, :] - z)
    said = e[np.arange(n), y].sum() + step[y[:-1], y[1:]].sum()
    return float(said - z), d_emit, d_step


def train(table: list[tuple[str, list[str]]] | None = None, max_rows: int = 5_000, steps: int = 100, rate: float = 0.5, l2: float = 0.02) -> Model:
    """Maximum likelihood with an L2 penalty by AdaGrad over the whole table (its first `max_rows` rows); a line is a row."""
    table = (labelled_table() if table is None else table)[:max_rows]
    names = ("-", *ADDED)
    lines = []
    for text, labels in table:
        data, offs = utf8(pa.array([text.replace("\n", " ")]))
        starts, ends, _, line = _lines(data, offs)
        if len(starts) != len(labels):
            raise ValueError(f"{len(starts)} words but {len(labels)} labels: {text!r}")
        if len(starts):
            lines.append((shapes(data, starts, ends, line).astype(np.float64), np.array([names.index(v) for v in labels])))
    k = len(names)
    emit, step = np.zeros((len(FEATURES), k)), np.zeros((k, k))
    g_emit, g_step = np.full(emit.shape, 1e-6), np.full(step.shape, 1e-6)
    for _ in range(steps if lines else 0):
        d_emit, d_step = -l2 * emit, -l2 * step
        for x, y in lines:
            _, by_emit, by_step = gradient(emit, step, x, y)
            d_emit += by_emit
            d_step += by_step
        g_emit += d_emit**2
        g_step += d_step**2
        emit += rate * d_emit / np.sqrt(g_emit)
        step += rate * d_step / np.sqrt(g_step)
    return Model(emit.astype(np.float32), step.astype(np.float32))


def viterbi(e: np.ndarray, line: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of all words; e: (words, labels) scores, line: ascending line numbers."""
    n, k = e.shape
    labels = np.zeros(n, dtype=np.int64)
    if not n:
        return labels
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(first, n))
    # a word off label 0 changes two transitions at most: lines that can't gain by it stay at 0
    gain = (e[:, 1:] - e[:, :1]).max(axis=1) + 2 * max(0.0, float(step.max() - step[0, 0]))
    live = np.maximum.reduceat(gain, first) >= 0
    first, size = first[live], size[live]
    if not len(first):
        return labels
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.zeros((n, k), dtype=np.int8)
    score = e[first].astype(np.float64)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # lines with at least t words
    for t in range(1, size[0]):
        a = active[t]
        s = score[:a, :, None] + step[None]
        back[first[:a] + t] = s.argmax(axis=1)
        score[:a] = s.max(axis=1) + e[first[:a] + t]
    last = score.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        labels[first[:a] + t] = last[:a]
        last[:a] = back[first[:a] + t, last[:a]]
    return labels


def crf_spans(col: pa.Array, model: Model) -> list[list[tuple[str, int, int]]]:
    """Spans of ADDED kinds for each text, in code points, without the signs around them."""
    data, offs = utf8(col)
    starts, ends, first, line = _lines(data, offs)
    labels = viterbi(shapes(data, starts, ends, line) @ model.emit, line, model.step)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(col))]
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    row = np.searchsorted(first, hit, side="right") - 1
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (line[hit[1:]] != line[hit[:-1]])))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hit)) - 1
    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
    begin = points[starts[hit[heads]]] - points[offs[row[heads]]]
    raw = data.tobytes()
    for h, t, at in zip(heads.tolist(), tails.tolist(), begin.tolist(), strict=True):
        said = raw[starts[hit[h]] : ends[hit[t]]].decode()
        a, b = 0, len(said)
        while a < b and not said[a].isalnum():
            a += 1
        while b > a and not said[b - 1].isalnum():
            b -= 1
        if a < b:
            out[row[h]].append((ADDED[labels[hit[h]] - 1], at + a, at + b))
    return out


def apart(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of the spans that share no place with any of the others."""
    by_start = sorted((a, b) for _, a, b in others)
    starts, ends = [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]]


def find(col: pa.Array, model: Model) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans: base ones and those of the CRF that touch none of them."""
    out = []
    for text, added in zip(col.to_pylist(), crf_spans(col, model), strict=True):
        base = base_spans(text or "")
        out.append((base, base + sorted(apart(added, base), key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the leftmost, then longest, counts."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_COLUMNS = {**{f"n_{k}": "long" for k in BASE}, "base_sha256": "string", "spans": "string", "n_spans": "long", "redacted": "string"}


def _finder(sent, n_cols: int, outputs: tuple[str, ...]):
    @tidy
    def run(batches):
        model = sent.value
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[n_cols]):
                col = batch.column(n_cols)
                got = find(col, model)
                made = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in BASE}
                made["base_sha256"] = [hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in got]
                made["spans"] = [_said(spans) for _, spans in got]
                made["n_spans"] = [len(spans) for _, spans in got]
                if "redacted" in outputs:
                    made["redacted"] = [None if t is None else redact(t, spans) for t, (_, spans) in zip(col.to_pylist(), got, strict=True)]
                cols = [pa.array(made[o], pa.int64() if _COLUMNS[o] == "long" else pa.string()) for o in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *cols], names=[*batch.schema.names[:n_cols], *outputs])

    return run


def find_pii(docs: DataFrame, text_col: str = "text", keep=("doc_id",), outputs: tuple[str, ...] = tuple(_COLUMNS)[:-1], model: Model | None = None) -> DataFrame:
    """docs -> the columns `keep` and the asked outputs for every row; no shuffle.

    spans lists kind:start:end (code points, end exclusive) of all kinds, comma-joined, by kind
    in the order of KINDS, then start; n_spans counts them. A null text has no spans; its
    redacted text is null. Rows are independent: repeated rows each come back, an empty table
    gives no rows. A kept column named like an output is dropped, other columns are ignored.
    Time grows in proportion to a text's length, whatever it holds.
    """
    if set(outputs) - set(_COLUMNS):
        raise ValueError(f"unknown outputs: {sorted(set(outputs) - set(_COLUMNS))}")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or train())
    text = clean_name("_text", [*keep, *outputs])
    keep = [c for c in keep if c.lower() not in outputs]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{o} {_COLUMNS[o]}" for o in outputs])
    return rows.mapInArrow(_finder(sent, len(keep), tuple(outputs)), schema)
