"""N-gram Jaccard join, quality rules and decontamination against brute force, and their edge cases."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseframe.llm.components import components
from sparseframe.llm.common import Scratch
from sparseframe.llm.decontaminate import budget, decontaminate, index, matches, myers, normal, search
from sparseframe.llm.ngram_join import ngram_jaccard, suffix_bound
from sparseframe.llm.quality_rules import host_verdicts, quality_rules

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed=1, groups=12, size=7):
    """Groups of near copies of texts of 4 to 120 words, with exact copies, case and white-space changes."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.choice([4, 12, 40, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            sep = r.choice([" ", "  ", "\n", "\t"])
            out.append(sep.join(x.upper() if r.random() < 0.1 else x for x in w))
    return out


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join_is_brute_force(spark, k, percent):
    texts = [*corpus(k), None, "", " \n", "x", "X", "x y", "Été", "été", "a b c", "A  B\tC"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    want = brute(texts, k, percent)
    for bits in (15, 3):  # with the bitmap, and by semi-joins
        assert sorted(tuple(r) for r in ngram_jaccard(df, k=k, percent=percent, sketch_bits=12, filter_bits=bits).collect()) == want


def test_jaccard_join_edges(spark):
    schema = "doc_id long, text string, component_id string, tokens string"
    assert ngram_jaccard(spark.createDataFrame([], schema), sketch_bits=12, filter_bits=15).collect() == []
    rows = [(7, "a b c d", None, None), (7, "a b c d", None, None), (3, "A b c d", "x", None), (None, "a b c d", None, None), (9, None, None, None)]
    got = ngram_jaccard(spark.createDataFrame(rows, schema), sketch_bits=12, filter_bits=15).collect()
    assert sorted([(r["doc_id"] or 0, r["component_id"]) for r in got if r["doc_id"]]) == [(3, 3), (7, 3), (7, 3), (9, 9)] and len(got) == 5


def test_suffix_bound_never_undercounts():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        assert all(suffix_bound(a, b, d) >= len(np.intersect1d(a, b)) for d in range(5))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (100, 70), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()
    label = {r["id"]: r["label"] for r in got}
    assert len(got) == len(label) == 34 and all(label[i] == 0 for i in range(31)) and {label[i] for i in (50, 70, 100)} == {50}


def measures(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [t for t in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", t)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {p + d for v in at.values() if len(v) > 1 for p in v for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover)


def test_quality_measures_and_verdicts(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b c a b c", "a a a a a", "x y\nx y\n\n x y\n", "é ñ #$ | <b>", "z " * 500]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(80))) for _ in range(40)]
    texts += [" ".join(r.choice(WORDS) + r.choice(["", "\n"]) for _ in range(r.randrange(300))) for _ in range(40)]
    rows = [(i, t, "bad" if i < 49 else "good", "extra", 1) for i, t in enumerate(texts)] + [(900, "w " * 3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _words string, n_words int")
    got = {x["doc_id"]: x for x in quality_rules(df).collect()}
    assert len(got) == len(rows)
    for i, t, host, *_ in rows:
        x = got[i]
        want = measures(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert x["kept"] == (not x["base_failed"] and host != "bad") and x["text"] == t
    assert got[900]["host_rate"] is None
    assert quality_rules(spark.createDataFrame([], df.schema)).collect() == []


def test_windows_of_very_long_texts_take_the_exact_way(spark, monkeypatch):
    from sparseframe.llm import quality_rules as q

    monkeypatch.setattr(q, "_POS_BITS", 4)  # texts of more than 15 words
    texts = ["a b c d a b c d a b c " * 3, "a b c " + " ".join(f"q{i}" for i in range(30)) + " a b c", " ".join(f"q{i}" for i in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in q.measured(df).orderBy("doc_id").collect()] == [measures(t)[4] for t in texts]


def test_host_rates_shrink_to_the_prior(spark):
    rows = [("big", i < 10) for i in range(100)] + [("mid", i < 12) for i in range(100)] + [("tiny", True)] + [(None, True)]
    got = {r["host"]: r for r in host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean"), "source").collect()}
    assert set(got) == {"big", "mid", "tiny"}
    assert 0.1 < got["big"]["rate"] < 0.12 and 0.3 < got["tiny"]["rate"] < 1


def slow_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_myers_is_the_edit_distance():
    r = random.Random(5)
    for _ in range(300):
        p, t = ("".join(r.choice("abé ") for _ in range(r.randrange(lo, hi))) for lo, hi in ((1, 40), (0, 80)))
        assert myers(p, t, 10**6)[0] == slow_distance(p, t)


def test_matches_are_brute_force(spark):
    r = random.Random(6)
    item = lambda n: " ".join("".join(r.choice("abcdefé") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, item(r.randrange(6, 30))) for i in range(6)] + [(50, "short"), (51, None), (52, ""), (None, item(9))]
    docs = []
    for k in range(80):
        _, t = items[k % 6]
        t = list(t)
        for _ in range(r.randrange(0, 2 + budget(len(t), 5) + 2)):
            p = r.randrange(len(t))
            if t[p] != " ":
                t[p] = r.choice(["z", "", "yy"])
        docs.append((k, f"{item(5)}  {''.join(t).upper()}\n{item(4)}"))
    docs += [(900, None), (901, ""), (902, item(200)), (903, items[0][1] * 2)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in matches(df, bench).collect()}
    want = {(d, i): slow_distance(normal(t), normal(x)) for d, x in docs for i, t in items[:6] if x}
    want = {k: v for k, v in want.items() if v <= budget(len(normal(items[k[1]][1])), 5)}
    assert {k: v["distance"] for k, v in got.items()} == want and 40 < len(want)
    for (d, i), x in got.items():
        said = normal(dict(docs)[d])[x["start"] : x["end"]]
        p, m = normal(items[i][1]), len(said)
        assert slow_distance(p, said) == x["distance"] and m
    assert {(x["doc_id"], x["item_id"]) for x in matches(df, bench, block_chars=100).collect()} == set(got)
    clean = decontaminate(df.withColumn("_leak", F.lit(1)), bench).collect()
    assert {x["doc_id"] for x in clean} == {d for d, _ in docs} - {d for d, _ in want}
    assert matches(df, bench.limit(0)).collect() == [] and matches(df.limit(0), bench).collect() == []
    assert search(["x"], index([], 5)) == []


def test_short_and_unnamed_items_are_found(spark):
    docs = [(1, "He said: Ask  Me again!"), (2, "task me again"), (3, "ask me against"), (4, "a long item that nobody has named stands here"), (5, "nothing"), (6, "task me again, then ask me again")]
    items = [(7, "ask me again"), (None, "long item that nobody has named"), (8, None), (None, " "), (None, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["start"], x["end"], x["distance"]) for x in matches(df, bench).collect())
    assert got == [(1, 7, 9, 21, 0), (4, None, 2, 33, 0), (6, 7, 20, 32, 0)]
    assert {x["doc_id"] for x in decontaminate(df, bench).collect()} == {2, 3, 5}


def test_other_words_with_one_hash_do_not_hide_repeats(spark, monkeypatch):
    from sparseframe.llm import quality_rules as q

    monkeypatch.setattr(q.F, "xxhash64", lambda *_: F.lit(5).cast("long"))  # every window meets every other
    texts = ["a b c x y z a b c", "a b c d e f", "a b c a b c a b c", "p q r s t p q r u v p q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in q.measured(df).orderBy("doc_id").collect()] == [measures(t)[4] for t in texts]


def test_pieces_shared_by_many_items_and_places():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(8))
    items = [(i, f"{' '.join(word() for _ in range(9))} {shared} {' '.join(word() for _ in range(9))}") for i in range(120)]
    ix = index(items, 5)
    made = lambda n: f"{' '.join(f'{shared} {word()}' for _ in range(n))} {items[7][1][:-1]}x"
    took = []
    for n in (150, 600):
        text, began = made(n), time.process_time()
        got = search([text], ix)
        took.append(time.process_time() - began)
        assert [(d, i, e) for d, i, _, _, e in got] == [(0, 7, 1)]
    assert took[1] < 8 * max(took[0], 0.1)


def test_verification_up_the_tree_loses_nothing():
    r = random.Random(12)
    for _ in range(150):
        item = "".join(r.choice("ab") for _ in range(r.randrange(20, 140)))
        percent = r.choice([5, 10, 20])
        t = list(item)
        for _ in range(budget(len(item), percent) + r.randrange(-1, 3)):
            t[r.randrange(len(t))] = r.choice(["", "a", "b", "ab", "c"])
        text = "".join(r.choice("ab") for _ in range(30)) + "".join(t) + "".join(r.choice("ab") for _ in range(30))
        least = slow_distance(item, text)
        got = search([text], index([(1, item)], percent))
        assert [x[4] for x in got] == ([least] if least <= budget(len(item), percent) else [])


def test_match_columns(spark):
    df = spark.createDataFrame([(1, "ask me again " * 20_000, 5, "x")], "doc_id long, text string, item_id int, START string")
    got = matches(df, spark.createDataFrame([(7, "ask me again", 1)], "item_id long, text string, doc_id int")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 0, 12, 0, 12)]


def test_long_texts_of_the_exact_way_take_time_in_proportion(spark, monkeypatch):
    from sparseframe.llm import quality_rules as q

    monkeypatch.setattr(q, "_POS_BITS", 4)
    took = []
    for n in (5_000, 20_000):
        df = spark.createDataFrame([(1, " ".join(f"w{i % (n // 2)}" for i in range(n)))], "doc_id long, text string").cache()
        df.count()
        began = time.time()
        assert q.measured(df).first()["n_repeat_words"] == n
        took.append(time.time() - began)
    assert took[1] < 8 * max(took[0], 0.5)
