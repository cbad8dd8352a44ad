"""BPE encoding and decoding with tree concatenation of long texts.

A text of more than ``leaf`` bytes is halved at its middle, wherever that falls, until the
pieces are short. The pieces of a whole Arrow batch are encoded together. Joins then go up
the tree: a window around each join is encoded anew, and grows until its first and last
tokens are those of the two halves, id and place alike. Two kinds of tokenizer:

* Where ASCII white space ends a pre-token without a trace (``splits_on_space`` probes for
  it), texts are sequences of words. Words are taken as spans of the Arrow buffer, told apart
  by 128-bit hashes, and looked up in a bounded memo of arrays; only new words reach the
  library. Windows run from white space to white space, and halves and window must agree on
  whole words: only a word that a cut went through is encoded again.
* Elsewhere, and inside words of more than ``leaf`` bytes, the window must show three tokens
  in a row on its left as the left half has them and three on its right as the right half
  has them. An encoding is the BPE result if every neighbouring pair of tokens is; all pairs
  of the spliced sequence come from one of the three encodings, so the splice is the encoding
  of the undivided text. Added tokens (<|endoftext|> and the like) are taken out of the raw
  text before all else; no cut falls inside one.
"""

from __future__ import annotations

import functools
import hashlib
import os
from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean_name, sliced, tidy, without
from .kernels import LOWER, WORD, U, hash_spans, ragged, utf8, words

#: Words (or parts of words) in a worker's memo, their ids in it at most, and the longest one in it, in bytes.
MEMO_WORDS, MEMO_IDS, MEMO_BYTES = 600_000, 4_000_000, 64
_MARK = "\x01"

# Classes of bytes: letters that stay the same under NFC and are lower-cased one by one (ASCII, and U+00C0 to U+017F but U+00D7, U+00F7, U+0130), and ASCII signs but the apostrophe.
_LETTER, _SIGN = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_NO_LETTER = {0xC3: (0x97, 0xB7), 0xC4: (0xB0,)}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Node(NamedTuple):
    """Tokens of a stretch of a text, with their spans in it."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def part(self, a: int, b: int | None = None) -> Node:
        return Node(self.ids[a:b], self.starts[a:b], self.ends[a:b])


def _concat(*nodes: Node) -> Node:
    return Node(*(np.concatenate(x) for x in zip(*nodes, strict=True)))


class Memo:
    """Ids of words by 128-bit hashes, in arrays in the order of the first half; when full, the half asked for longest ago goes."""

    def __init__(self):
        self.h1, self.h2, self.at = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.n, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.now = np.zeros(0, np.uint32), 0
        self.pending: list[tuple[np.ndarray, ...]] = []

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the ascending h1 are here, where their ids stand in the pool, and how many they are."""
        if not len(self.h1):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        pos = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        here = (self.h1[pos] == h1) & (self.h2[pos] == h2)
        self.used[pos[here]] = self.now
        return here, self.at[pos], self.n[pos].astype(np.int64)

    def put(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds ids to the pool; where those of each word begin."""
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate((self.pool, ids.astype(np.uint32)))
        return at

    def enter(self, h1: np.ndarray, h2: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Words to be found from the next settle() on."""
        self.pending.append((h1, h2, at, n.astype(np.int32)))

    def settle(self) -> None:
        """Takes in what is pending, and drops what is too much. Places in the pool change."""
        if self.pending:
            new = [np.concatenate(x) for x in zip(*self.pending, strict=True)]
            self.pending = []
            _, first = np.unique(new[0], return_index=True)
            if len(self.h1):
                pos = np.minimum(np.searchsorted(self.h1, new[0][first]), len(self.h1) - 1)
                first = first[self.h1[pos] != new[0][first]]
            new = [x[first] for x in new]
            rank = np.argsort(np.concatenate((self.h1, new[0])), kind="stable")  # of two ascending runs
            old = (self.h1, self.h2, self.at, self.n, self.used)
            self.h1, self.h2, self.at, self.n, self.used = (np.concatenate((a, b))[rank] for a, b in zip(old, [*new, np.full(len(first), self.now, np.int32)], strict=True))
        self.now += 1
        if len(self.h1) > MEMO_WORDS or len(self.pool) > MEMO_IDS:
            late = np.argsort(self.used, kind="stable")[-(MEMO_WORDS // 2) :]
            late = late[np.cumsum(self.n[late][::-1])[::-1] <= MEMO_IDS // 2]
            keep = np.sort(late)
            self.h1, self.h2, self.at, self.n, self.used = (x[keep] for x in (self.h1, self.h2, self.at, self.n, self.used))
            self.pool = self.pool[ragged(self.at, self.n.astype(np.int64))]
            self.at = np.cumsum(self.n, dtype=np.int64) - self.n


def leading_letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For words one after the other: how many bytes of letters stand first, if nothing but signs follows; else 0."""
    kind = _CLASS[buf]
    after = np.zeros(len(buf), dtype=np.uint8)
    after[1:] = np.where(buf[:-1] >= 0xC3, kind[:-1], 0)
    follows = (buf & 0xC0) == 0x80
    kind[follows] = after[follows]
    for lead, ends in _NO_LETTER.items():
        for at in np.flatnonzero(buf[:-1] == lead):
            if buf[at + 1] in ends:
                kind[at] = 0
    starts, size = offs[:-1], np.diff(offs)
    count = lambda x: np.add.reduceat(x, starts, dtype=np.int64)
    letters, signs = count(kind == _LETTER), count(kind == _SIGN)
    back = np.zeros(len(buf), dtype=bool)
    back[1:] = (kind[1:] == _LETTER) & (kind[:-1] == _SIGN)
    back[starts] = False
    plain = (letters + signs == size) & (kind[starts] == _LETTER) & (count(back) == 0)
    return np.where(plain, letters, 0)


class Encoder:
    def __init__(self, path: str, leaf: int = 16384, window: int = 64, run: int = 3):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.window, self.run = max(leaf, 8), max(window, 4), run
        self.memo = Memo()
        self.whole = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.by_word = len(self.mark) == 1 and self.splits_on_space()
        self.by_parts = self.by_word and self.splits_off_signs()
        self.bare = self._for_letters() if self.by_parts else self.tok

    def splits_on_space(self) -> bool:
        """Whether ASCII white space separates words without a trace, so that words can be encoded alone."""
        probe = ["ab", "a.b", "'s", "9", "Éa", "!?", "<|endoftext|>"]
        one = [i for w in probe for i in self.tok.encode(w, add_special_tokens=False).ids]
        return all(self.tok.encode(s + s.join(probe) + s, add_special_tokens=False).ids == one for s in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"))

    def splits_off_signs(self) -> bool:
        """Whether letters and the ASCII signs after them are separate pre-tokens, and case doesn't count."""
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        return all(ids(w + s) == ids(w.lower()) + ids(s) for w in ("Ab", "THE", "ÉTÉ", "x") for s in ("!", ",", "***", "_", "&&&", '").', "-", "<|"))

    def _for_letters(self):
        """The tokenizer without the steps that leave lower-case Latin letters as they are, if it then gives the same ids."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_str(self.tok.to_str())
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = [f" {_MARK} ".join(["the", "été", "ñandú", "straße", "œuvre", "łódź", "zzyzx" * 5]), "a", "ſ", _MARK]
        ids = lambda t: [e.ids for e in t.encode_batch_fast(probe, add_special_tokens=False)]
        return bare if ids(bare) == ids(self.tok) else self.tok

    # --- words -------------------------------------------------------------------------
    def _encoded(self, said: list[bytes], tok, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of separate words one after the other, and how many each has. Many are encoded in one call, with a control character between them whose id marks the bounds."""
        n, out = np.zeros(len(said), np.int64), [np.zeros(0, np.uint32)] * len(said)
        giant = [i for i, w in enumerate(said) if len(w) > self.leaf]
        alone = [i for i, w in enumerate(said) if len(w) <= self.leaf and (b"<|" in w or b"\x01" in w)]
        for i, ids in zip(giant, self.encode_trees([said[i].decode() for i in giant]), strict=True):
            out[i] = ids
        for i, e in zip(alone, tok.encode_batch_fast([said[i].decode() for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.uint32)
        skip = {*giant, *alone}
        rest = [i for i in range(len(said)) if i not in skip] if skip else range(len(said))
        groups = [rest[i : i + 256] for i in range(0, len(rest), 256)]
        texts = [b" \x01 ".join([said[i] for i in g]).decode() for g in groups]
        flat = [np.frombuffer(array("I", e.ids), dtype=np.uint32) for e in tok.encode_batch_fast([t.lower() if lower else t for t in texts], add_special_tokens=False)]
        for g, ids in zip(groups, flat, strict=True):
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(g) - 1:
                raise ValueError("the mark between words was not kept apart by this tokenizer")
            n[g] = np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
        if not skip:
            every = np.concatenate([*flat, np.zeros(0, np.uint32)])
            return every[every != self.mark[0]], n
        for g, ids in zip(groups, flat, strict=True):
            for i, part in zip(g, np.split(ids[ids != self.mark[0]], np.cumsum(n[g])[:-1]), strict=True):
                out[i] = part
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array([len(x) for x in out], np.int64)

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words' ids stand in the memo's pool, how many they are, and the words' hashes. make(starts, ends): the same two for distinct words that the memo lacks."""
        h1, h2 = hash_spans(data, starts, ends), hash_spans(data, starts, ends, 1)
        _, first, back = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[first][back] != h2).any():  # other words with one hash
            order = np.lexsort((h2, h1))
            new = np.concatenate(([True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)))
            first, back = order[new], np.empty(len(h1), np.int64)
            back[order] = np.cumsum(new) - 1
        here, at, n = self.memo.find(h1[first], h2[first])
        miss = np.flatnonzero(~here)
        if len(miss):
            which = first[miss]
            at[miss], n[miss] = make(starts[which], ends[which])
            short = ends[which] - starts[which] <= MEMO_BYTES
            self.memo.enter(h1[which][short], h2[which][short], at[miss][short], n[miss][short])
        return at[back], n[back], h1

    def _parts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, tok) -> tuple[np.ndarray, np.ndarray]:
        def make(a, b):
            raw = buf.tobytes()
            ids, n = self._encoded([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], tok, tok is self.bare)
            return self.memo.put(ids, n), n

        return self._distinct(buf, starts, ends, make)[:2]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New words. Plain ones are put together from their letters and the signs after them, which are pre-tokens of their own."""
        size = ends - starts
        buf, offs = data[ragged(starts, size)], np.concatenate(([0], np.cumsum(size)))
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        letters = leading_letters(buf, offs) if self.by_parts else np.zeros(len(starts), np.int64)
        letters[size > MEMO_BYTES] = 0
        p, o = np.flatnonzero(letters), np.flatnonzero(letters == 0)
        if len(p):
            a, b = offs[p], offs[p + 1]
            mid = a + letters[p]
            places, counts = np.zeros((len(p), 2), np.int64), np.zeros((len(p), 2), np.int64)
            places[:, 0], counts[:, 0] = self._parts(LOWER[buf], a, mid, self.bare)
            s = np.flatnonzero(mid < b)
            if len(s):
                places[s, 1], counts[s, 1] = self._parts(buf, mid[s], b[s], self.tok)
            n[p] = counts.sum(axis=1)
            at[p] = self.memo.put(self.memo.pool[ragged(places.ravel(), counts.ravel())], n[p])
        if len(o):
            raw = buf.tobytes()
            ids, n[o] = self._encoded([raw[i:j] for i, j in zip(offs[o].tolist(), offs[o + 1].tolist(), strict=True)], self.tok)
            at[o] = self.memo.put(ids, n[o])
        return at, n

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._distinct(data, starts, ends, lambda a, b: self._learn(data, a, b))

    # --- trees of words ------------------------------------------------------------------
    def _halved(self, data: np.ndarray, lo: int, hi: int, joins: list[tuple[int, int, int]]) -> None:
        """Adds (lo, middle, hi) of every join, lower ones first."""
        mid = (lo + hi) // 2
        while mid > lo and data[mid] & 0xC0 == 0x80:
            mid -= 1
        if hi - lo > self.leaf and mid > lo:
            self._halved(data, lo, mid, joins)
            self._halved(data, mid, hi, joins)
            joins.append((lo, mid, hi))

    def _joins(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """The joins of all long texts; a word longer than a leaf is left whole here."""
        joins: list[tuple[int, int, int]] = []
        for r in np.flatnonzero(np.diff(offs) > self.leaf).tolist():
            lo, hi = int(offs[r]), int(offs[r + 1])
            starts, ends, _ = words(data[lo:hi], np.array([0, hi - lo]))
            giant = np.flatnonzero(ends - starts > self.leaf)
            at = lo
            for a, b in [*zip((starts[giant] + lo).tolist(), (ends[giant] + lo).tolist(), strict=True), (hi, hi)]:
                self._halved(data, at, a, joins)
                at = b
        return joins

    @staticmethod
    def _window(data: np.ndarray, lo: int, mid: int, hi: int, w: int) -> tuple[int, int]:
        """From white space to white space, some w bytes to either side of mid, or to lo and hi."""
        a, b = lo, hi
        for k in (w << i for i in range(64)):
            if mid - k <= lo:
                break
            space = np.flatnonzero(~WORD[data[mid - k : mid]])
            if len(space):
                a = mid - k + int(space[0]) + 1
                break
        for k in (w << i for i in range(64)):
            if mid + k >= hi:
                break
            space = np.flatnonzero(~WORD[data[mid : mid + k]])
            if len(space):
                b = mid + int(space[-1])
                break
        return a, b

    def encode_utf8(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts one after the other, and the texts' offsets in them: by words, long texts by trees."""
        self.memo.settle()
        joins = self._joins(data, offs)
        edges = np.sort(np.concatenate((offs, np.unique(np.array(joins, np.int64)))))
        spans = [self._window(data, *j, self.window) for j in joins]
        buf = np.concatenate([data, *[data[a:b] for a, b in spans]]) if joins else data
        rows = np.concatenate((edges, len(data) + np.cumsum(np.array([b - a for a, b in spans], np.int64))))
        starts, ends, first = words(buf, rows)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        at, n, key = self._look_up(buf, starts, ends)
        pieces = len(edges) - 1
        if not joins:
            order, place = slice(None), starts
        else:
            shift = np.array([a for a, _ in spans], np.int64) - rows[pieces:-1]
            place = starts + np.concatenate((np.zeros(first[pieces], np.int64), np.repeat(shift, np.diff(first[pieces:]))))
            node: dict[int, np.ndarray] = {}

            def half(lo: int) -> np.ndarray:
                if lo in node:
                    return node.pop(lo)
                k = int(np.searchsorted(edges, lo, "right")) - 1
                return np.arange(first[k], first[k + 1])

            for k, (lo, mid, hi) in enumerate(joins):
                left, right = half(lo), half(mid)
                (a, b), win, w = spans[k], np.arange(first[pieces + k], first[pieces + k + 1]), self.window
                while True:
                    i, j = int(np.searchsorted(place[left], a)), int(np.searchsorted(place[right], b))
                    same = lambda x, y: place[x] == place[y] and key[x] == key[y]
                    at_left = a == lo or (i < len(left) and len(win) and same(left[i], win[0]))
                    at_right = b == hi or (j and len(win) and same(right[j - 1], win[-1]))
                    if at_left and at_right:
                        break
                    w *= 2
                    a, b = self._window(data, lo, mid, hi, w)
                    s, e, _ = words(data[a:b], np.array([0, b - a]))
                    more = self._look_up(data[a:b], s, e)
                    win = len(place) + np.arange(len(s))
                    place, at, n, key = (np.concatenate(x) for x in ((place, s + a), (at, more[0]), (n, more[1]), (key, more[2])))
                node[lo] = np.concatenate((left[:i], win, right[j:]))
            tops = {lo: hi for lo, _, hi in joins}  # the last join that begins at a place is the widest
            # pieces without joins in page order, and what the joins gave
            out, done = [], 0
            for lo in sorted(node):
                k = int(np.searchsorted(edges, lo, "right")) - 1
                out += [np.arange(first[done], first[k]), node[lo]]
                top = tops[lo]
                done = int(np.searchsorted(edges, top, "left"))
            order = np.concatenate([*out, np.arange(first[done], first[pieces])])
            place, at, n = place[order], at[order], n[order]
        total = np.concatenate(([0], np.cumsum(n)))
        return self.memo.pool[ragged(at, n)], total[np.searchsorted(place, offs)]

    # --- long texts by tokens ----------------------------------------------------------------------
    def _outside(self, text: str, p: int, left: bool) -> int:
        """p, or the nearest place to its left or right that is not inside an added token, which is cut out of the raw text before all else."""
        moved = True
        while moved:
            moved = False
            for t in self.whole:
                at = text.find(t, max(0, p - len(t) + 1), p + len(t) - 1)
                if 0 <= at < p < at + len(t):
                    p, moved = (at if left else at + len(t)), True
        return p

    def _middle(self, text: str, lo: int, hi: int) -> int | None:
        """Where text[lo:hi] is halved; None if it is a leaf."""
        if hi - lo <= self.leaf:
            return None
        mid = self._outside(text, (lo + hi) // 2, True)
        if mid <= lo:
            mid = self._outside(text, (lo + hi) // 2, False)
        return mid if lo < mid < hi else None

    def _pieces(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        mid = self._middle(text, lo, hi)
        return [(lo, hi)] if mid is None else self._pieces(text, lo, mid) + self._pieces(text, mid, hi)

    @staticmethod
    def _node(e, at: int) -> Node:
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return Node(np.array(e.ids, dtype="<u4"), spans[:, 0], spans[:, 1])

    def _agree(self, half: Node, win: Node, left: bool) -> tuple[int, int] | None:
        """Positions after (left) or at (right) a run of tokens that both have, nearest to the join's far side that was found first."""
        r, n = self.run, len(win.ids)
        if len(half.ids) < r or n < r:
            return None
        if left:
            i0 = int(np.searchsorted(half.ends, win.starts[0], "left"))
            i1 = len(half.ids)
        else:
            i0, i1 = 0, int(np.searchsorted(half.starts, win.ends[-1], "right"))
        at = {x: i for i, x in zip(range(i0, i1), zip(half.ids[i0:i1].tolist(), half.starts[i0:i1].tolist(), half.ends[i0:i1].tolist(), strict=True), strict=True)}
        seq = list(zip(win.ids.tolist(), win.starts.tolist(), win.ends.tolist(), strict=True))
        for k in range(n - r + 1) if left else range(n - r, -1, -1):
            i = at.get(seq[k], -1)
            if i < i0 or i + r > i1:
                continue
            if all(at.get(seq[k + d]) == i + d for d in range(1, r)):
                return (i + r, k + r) if left else (i, k)
        return None

    def join(self, text: str, lo: int, mid: int, hi: int, left: Node, right: Node) -> Node:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        w = self.window
        while True:
            a, b = max(lo, self._outside(text, max(lo, mid - w), True)), min(hi, self._outside(text, min(hi, mid + w), False))
            win = self._node(self.tok.encode(text[a:b], add_special_tokens=False), a)
            at_left = (0, 0) if a == lo else self._agree(left, win, True)
            at_right = (len(right.ids), len(win.ids)) if b == hi else self._agree(right, win, False)
            if at_left and at_right and at_left[1] <= at_right[1]:
                return _concat(left.part(0, at_left[0]), win.part(at_left[1], at_right[1]), right.part(at_right[0]))
            w *= 2

    def _tree(self, text: str, lo: int, hi: int, leaves: Iterator[Node]) -> Node:
        mid = self._middle(text, lo, hi)
        if mid is None:
            return next(leaves)
        left = self._tree(text, lo, mid, leaves)
        return self.join(text, lo, mid, hi, left, self._tree(text, mid, hi, leaves))

    def encode_trees(self, texts: Sequence[str]) -> list[np.ndarray]:
        spans = [(t, a, b) for t in texts for a, b in self._pieces(t, 0, len(t))]
        done = self.tok.encode_batch([t[a:b] for t, a, b in spans], add_special_tokens=False)
        leaves = (self._node(e, a) for e, (_, a, _) in zip(done, spans, strict=True))
        return [self._tree(t, 0, len(t), leaves).ids for t in texts]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of whole texts as uint32 arrays."""
        ids, offs = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of whole texts one after the other, and each text's offsets; null is empty."""
        if self.by_word:
            return self.encode_utf8(*utf8(col))
        got = self.encode_trees([t or "" for t in col.to_pylist()])
        return np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64))).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str, leaf: int) -> Encoder:
    """A worker's own encoder: its memo serves all tasks that the worker runs."""
    return Encoder(path, leaf)


class Strings:
    """Strings by number, each with a space after it."""

    def __init__(self, strings: Sequence[str]):
        said = [s.encode() + b" " for s in strings]
        self.data, self.size = np.frombuffer(b"".join(said), np.uint8), np.array([len(s) for s in said], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray, offs: np.ndarray) -> list[memoryview]:
        """For each text its ids' strings, joined by one space."""
        size = self.size[ids]
        said = memoryview(self.data[ragged(self.start[ids], size)])
        total = np.concatenate(([0], np.cumsum(size)))[offs].tolist()
        return [said[a : max(a, b - 1)] for a, b in zip(total[:-1], total[1:], strict=True)]


class Decoder:
    """Ids to text as the library's decode(ids, skip_special_tokens=False); by a table of tokens where it has no decoder of its own."""

    def __init__(self, tok):
        self.tok, size = tok, tok.get_vocab_size(with_added_tokens=True)
        self.pieces = Strings([tok.id_to_token(i) or "" for i in range(size)]) if tok.decoder is None else None
        self.digits = Strings([str(i) for i in range(size)])

    def texts(self, ids: np.ndarray, offs: np.ndarray) -> list[memoryview | bytes]:
        """The decoded texts in UTF-8."""
        if self.pieces is not None:
            return self.pieces.joined(ids, offs)
        return [self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]

    def text(self, ids: Sequence[int]) -> str:
        return bytes(self.texts(np.array(ids, np.int64), np.array([0, len(ids)]))[0]).decode()


@functools.lru_cache(maxsize=2)
def decoder(path: str, leaf: int) -> Decoder:
    return Decoder(encoder(path, leaf).tok)


#: Output columns that can be asked for, with their types.
OUTPUTS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _sha(said: list) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in said]


def _run(path: str, leaf: int, outputs: Sequence[str], n_cols: int, text_at: int):
    @tidy
    def run(batches):
        enc, dec = encoder(path, leaf), decoder(path, leaf)
        make = {
            "n_tokens": lambda ids, offs: np.diff(offs),
            "ids": lambda ids, offs: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32))),
            "decoded": lambda ids, offs: [bytes(x).decode() for x in dec.texts(ids, offs)],
            "ids_sha256": lambda ids, offs: _sha(dec.digits.joined(ids, offs)),
            "decoded_sha256": lambda ids, offs: _sha(dec.texts(ids, offs)),
        }
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[text_at]):
                got = enc.encode_column(batch.column(text_at))
                cols = [x if isinstance(x := make[o](*got), pa.Array) else pa.array(x, OUTPUTS[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *cols], names=[*batch.schema.names[:n_cols], *outputs])

    return run


def bpe(
    docs: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    outputs: Sequence[str] = ("n_tokens", "ids", "decoded"),
    path: str | None = None,
    leaf: int = 16384,
) -> DataFrame:
    """docs -> the columns `keep` and the asked `outputs` for every row.

    A null text counts as empty: no ids, an empty decoded text. Rows are independent, so ties
    and repeated rows are kept; a kept column named like an output is dropped, other columns are
    ignored. A very long text is one row of one task, a few times its size in memory. Nothing is
    shuffled. A worker's memo is
    bounded by MEMO_WORDS.
    """
    bounded_batches(docs.sparkSession)
    bad = set(outputs) - set(OUTPUTS)
    if bad:
        raise ValueError(f"unknown outputs: {sorted(bad)}")
    kept = without(docs.select(*[F.col(f"`{c}`") for c in keep]), outputs)
    names = kept.columns
    text = clean_name("_text", [*names, *outputs])  # goes last
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{o}` {OUTPUTS[o][0]}" for o in outputs])
    return rows.mapInArrow(_run(path or vocabulary_path(), leaf, tuple(outputs), len(names), len(names)), schema)
