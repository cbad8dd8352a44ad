"""Toxicity, languages, personal data, main text, chat: held-out accuracy, exact patterns, edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparseframe.llm import chat
from sparseframe.llm.language_id import _em, identify, language_id
from sparseframe.llm.language_id import train as learn_languages
from sparseframe.llm.main_text import _Page, _left_out, extract, main_text, scored
from sparseframe.llm.pii import ADDED, FEATURES, Model, apart, base_spans, crf_spans, find, find_pii, gradient, labelled_table, luhn, redact, shapes, train, viterbi
from sparseframe.llm.toxicity import Ftrl, features, score, toxicity
from sparseframe.llm.toxicity import train as learn_toxicity

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            w[7:9] = ["Utter", "fool!"]
            w[20] = r.choice(["swine,", "SWINE"])
        rows.append((i, " ".join(w), 9, "x"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (None, "swine fool", 1, "x"), (3, rows[3][1], 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    got = toxicity(df, spark.createDataFrame([*labels, (901, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["held_out"] == held(x["doc_id"]) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        if x["doc_id"] is not None and x["doc_id"] < 400:
            assert x["predicted"] == int(x["doc_id"] % 5 == 0)
    none = toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x["score"] for x in none} == {0.5}
    assert toxicity(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["lang"]: r["text"] for r in docs.collect()}
    mixed = (first["de"][:400] + " ") * 2 + first["fr"][:500]
    more = spark.createDataFrame([(10_001, None, None, "x", 0), (10_002, "12 !? —", "en", "x", 0), (None, first["fr"], "fr", "x", 0), (10_003, mixed, None, "x", 0)], docs.schema)
    got = {r["doc_id"]: r for r in language_id(docs.unionByName(more).withColumn("lang_pred", F.lit("zz"))).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    right = [got[i]["lang_pred"] == v for i, v in true.items() if held(i)]
    assert sum(right) / len(right) > 0.98
    assert got[10_001]["lang_pred"] == got[10_002]["lang_pred"] == "und" and got[10_001]["score"] == 0
    assert got[None]["lang_pred"] == "fr" and not got[None]["held_out"]
    assert got[10_003]["lang_pred"] == "de" and got[10_003]["n_langs"] == 2 and 0.5 < got[10_003]["score"] < 0.75
    empty = docs.withColumn("lang", F.lit(None).cast("string")).limit(3)
    assert {r["lang_pred"] for r in language_id(empty).collect()} == {"und"} and language_id(docs.limit(0)).collect() == []


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns_are_the_regular_expressions():
    r = random.Random(2)
    bits = ["a", "@", ".", "b.c", "@x.y", "1", "25", "300", ".0", "-", " ", "+1", "(", ")", "4111 1111 1111 1111", "x@y.z@w.v", "é", "%", "\n", "555-0100"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        assert base_spans(t) == slow_base(t), t
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_viterbi_is_exhaustive_search():
    r = np.random.default_rng(3)
    for n in (1, 2, 5):
        e, step = r.normal(size=(n, 3)), r.normal(size=(3, 3))
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        total = [e[range(n), p].sum() + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths]
        both = viterbi(np.concatenate([e, e]), np.array([0] * n + [4] * n), step)
        assert both.tolist() == paths[int(np.argmax(total))].tolist() * 2


def test_crf_learns_its_table_and_holds_on_other_values(spark):
    from sparseframe.llm.pii import _lines
    from sparseframe.llm.kernels import utf8

    model = train(steps=60)
    names = ("-", *ADDED)
    for text, labels in labelled_table():
        data, offs = utf8(pa.array([text]))
        starts, ends, _, line = _lines(data, offs)
        assert [names[v] for v in viterbi(shapes(data, starts, ends, line) @ model.emit, line, model.step)] == labels
    token = hashlib.sha1(b"new").hexdigest()
    text = f'é então token = "{token}" and\nmail a.b@c.de now +1 (017) 555-7713, 12345678901234567 plain'
    rows = [(1, text, 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (1, text, 0, "x"), (4, "nothing to see here " * 2000, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int, _text string")
    got = sorted(find_pii(df, keep=("doc_id", "_text", "n_email"), outputs=("n_email", "n_phone", "base_sha256", "spans", "redacted"), model=model).collect(), key=lambda x: x["doc_id"])
    a, e = text.index(token), text.index("a.b@")
    p = text.index("+1 (")
    assert got[0]["spans"] == f"email:{e}:{e + 8},phone:{p}:{p + 17},secret:{a}:{a + 40}" and got[0] == got[1]
    assert got[0]["redacted"] == 'é então token = "[SECRET]" and\nmail [EMAIL] now [PHONE], 12345678901234567 plain'
    assert (got[0]["n_email"], got[0]["n_phone"], got[0]["_text"]) == (1, 1, "x")
    assert got[2]["spans"] == "" and got[2]["redacted"] is None and got[3]["redacted"] == "" and got[4]["spans"] == ""
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f" and find_pii(df.limit(0), model=model).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:"</p>"}</style></head><body class="footer"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/a>All, of, it</a></ul></nav><div class="cookie-notice"><p>We use cookies, many, many, of them, all the time.</p></div>
<div id=main><h2>The title</h2><div class="post"><p>First para, with commas, and caf&eacute;&nbsp;1 &lt; 2 &#8212; enough   text to
count.<p>Second <b>bold</b>er para, and <a href=x>a link</a>, too.<ul><li>one<li>two</ul><div class="ad-slot">Buy, buy, buy, now!</div><script>var a = "<p>no</p>";</script></div>
<section id="comments"><p>A reader, long, long, comment, with, many, commas, in, it, that goes on, and on, and on.</p></section></div>
<aside><p>Side, side, side</p></aside><form><input value="x"><p>Name, please</p></form><footer>Foot, er</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "The title First para, with commas, and café 1 < 2 — enough text to count. Second bolder para, and a link, too. one two"
    assert main_text(None) == main_text("") == main_text("<html><script>x") == ""
    assert main_text("just  text &amp; no markup < here") == "just text & no markup < here"
    assert main_text("<article><p>kept, in an article") == "kept, in an article"
    deep = "<div>" * 5000 + "<p>deep text, here</p>" + "</span>" * 5000
    assert main_text(deep) == "deep text, here"
    assert main_text('<p>a, b<a "' * 2000).startswith("a, b")


def test_articles_of_the_test_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    text = {r["page_id"]: r for r in extract(pages.unionByName(spark.createDataFrame([(9999, "u", None)], pages.schema))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", inner))).split())
        assert text[r["page_id"]]["text"] == want and text[r["page_id"]]["n_chars"] == len(want)
    assert text[9999]["text"] == "" and extract(pages.limit(0)).collect() == []


def render(rows, me):
    out, mask = "", []
    for role, text in rows:
        head = "<|im_start|>assistant\n" if role == me else f"<|im_start|>{role}\n" if role == "system" else f"<|im_start|>user name={role}\n"
        body = text + "<|im_end|>\n"
        if role == me:
            mask.append(f"{len(out) + len(head)}:{len(out) + len(head) + len(body) - 1}")
        out += head + body
    return out, ",".join(mask)


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "Be é", "x"), (1, 1, "ann", "Hi <|im_end|>", "x"), (1, 2, "bob", "Ho", "x"), (1, 2, "bob", "Ho", "x"), (1, 3, "cy", None, "x"), (2, None, None, "alone", "x"), (2, 5, "system", "s", "x"), (None, 1, "ann", "n", "x"), (3, 0, "system", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann")}
    first = [("system", "Be é"), ("ann", "Hi < |im_end|>"), ("bob", "Ho"), ("bob", "Ho"), ("cy", "")]
    for me in ("ann", "bob", "cy"):
        r = got[1, me]
        assert (r["text"], r["mask"]) == render(first, me) and r["n_turns"] == 5
    assert got[1, "bob"]["n_own"] == 2 and got[2, "unknown"]["text"] == render([("unknown", "alone"), ("system", "s")], "unknown")[0]
    assert chat.rotate(df.limit(0)).collect() == []


def test_long_conversations_come_in_parts(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.when(F.col("id") < 700, F.col("id")).otherwise(699).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.format_string("t%04d", F.col("id")).alias("text"))
    got = chat.rotate(df, part_turns=64).where("perspective = 'a'").orderBy("part", "subpart").collect()
    assert all(r["n_turns"] <= 64 for r in got) and sum(r["n_turns"] for r in got) == 1000
    order = sorted((r["turn"], r["role"], r["text"]) for r in df.collect())
    assert "".join(r["text"] for r in got) == render([(role, text) for _, role, text in order], "a")[0]
    for r in got:
        assert all(r["text"][slice(*map(int, s.split(":")))].endswith("<|im_end|>") for s in r["mask"].split(",") if s)


def test_every_language_is_learned_also_rare_ones(spark):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(7)) for _ in range(30)] for k in range(70)}
    rows, i = [], 0
    for k, (lang, own) in enumerate(words.items()):
        for _ in range(400 if k == 0 else 6):
            rows.append((i, " ".join(r.choice(own) for _ in range(60)), lang))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in language_id(df, max_train=50).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_attributes_are_read_whole():
    words = "one, two, three four five six seven eight nine ten eleven twelve. " * 4
    page = "<body><article><p>{} see <a href='/the-hidden-valley'>the valley</a> there</p><div data-hidden=\"false\" title=\"hidden role=dialog\"><p>{}</p></div><div {}><p>gone</p></div></article></body>"
    for attr in ("hidden", "HIDDEN=''", "aria-hidden=true", "role='Dialog'", "id=sidebar", 'title="x" class="cookie-bar"', "style='display: none'"):
        assert main_text(page.format(words, words, attr)) == f"{words}see the valley there {words}".strip()


def growth(f, small, large):
    """How many times longer f takes on the large input, four times the small one (best of three)."""
    took = []
    for x in (small, large):
        best = math.inf
        for _ in range(3):
            began = time.process_time()
            f(x)
            best = min(best, time.process_time() - began)
        took.append(best)
    return took[1] / max(took[0], 0.05)


def test_time_grows_with_the_length_whatever_the_text():
    model = Model(np.array([[0.0, 1.0, 0.0]] * len(FEATURES)), np.zeros((3, 3)))
    for bit in ("7", "1.", "1.2.3.4 ", "+1(", "a@", "a@b.", "4111-", "é", "-_"):
        assert growth(base_spans, bit * 50_000, bit * 200_000) < 8, bit
    for line in ("é 4.3.2.1 x\n", "----_-_-", "token "):
        assert growth(lambda t: find(pa.array([t]), model), line * 2_500, line * 10_000) < 8, line
    for bit in ("<a", "<p>a, b<a \"", "<div>x", "<!", "<!--", "<b>x<br>", "<b><p>x", "<i title='", "< ", "&", "</p>", "<li>x", "<script>", "<form class=ad>x, y"):
        assert growth(main_text, bit * 5_000, bit * 20_000) < 8, bit
        assert growth(main_text, "<div>" * 5_000 + bit * 5_000, "<div>" * 20_000 + bit * 20_000) < 8, bit


def test_spans_that_touch_others_go():
    r = random.Random(5)
    span = lambda: ("k", a := r.randrange(60), a + r.randrange(1, 9))
    for _ in range(300):
        x, y = [span() for _ in range(9)], [span() for _ in range(r.randrange(9))]
        assert apart(x, y) == [s for s in x if all(s[2] <= b[1] or s[1] >= b[2] for b in y)]


def test_crf_spans_are_in_code_points():
    model = Model(np.array([[0.0, 1.0, 0.0]] * len(FEATURES)), np.zeros((3, 3)))
    texts = ["", None, "é «日本x_», (ab)", "--", "ü\n\"tøken\"; ö"]
    for text, spans in zip(texts, crf_spans(pa.array(texts), model), strict=True):
        want = []
        for line in re.finditer(r"[^\n]+", text or ""):
            said = re.sub(r"^[\W_]+|[\W_]+$", "", line[0])
            if said:
                at = line.start() + line[0].index(said)
                want.append(("secret", at, at + len(said)))
        assert spans == want


def test_crf_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    for n in (1, 2, 6):
        x, y = r.normal(size=(n, 4)), r.integers(0, 3, n)
        emit, step, h = r.normal(size=(4, 3)), r.normal(size=(3, 3)), 1e-6
        _, d_emit, d_step = gradient(emit, step, x, y)
        for a, d in ((emit, d_emit), (step, d_step)):
            for k in np.ndindex(a.shape):
                was = a[k]
                a[k] = was + h
                up = gradient(emit, step, x, y)[0]
                a[k] = was - h
                down = gradient(emit, step, x, y)[0]
                a[k] = was
                assert abs((up - down) / (2 * h) - d[k]) < 1e-5


def slow_features(text):
    w = re.findall("[A-Za-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {(x,) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, *p) for p in zip(w, w[2:])}


def test_features_are_words_pairs_and_skip_pairs():
    r = random.Random(6)
    texts = [" ".join(r.choice(["Ab", "c", "é1", "d-e", "!", "ab"]) for _ in range(r.randrange(12))) for _ in range(60)] + [None, ""]
    slots, rows = features(pa.array(texts), 40)
    number = {}
    for i, t in enumerate(texts):
        mine = set(slots[rows == i].tolist())
        assert len(mine) == len(slow_features(t))
        for f in slow_features(t):
            number.setdefault(f, set()).add(i)
    whose = {}
    for s, i in zip(slots.tolist(), rows.tolist()):
        whose.setdefault(s, set()).add(i)
    assert sorted(map(sorted, whose.values())) == sorted(map(sorted, number.values()))


def test_training_is_plain_ftrl_and_all_weights_arrive(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("abcdefgh") * (1 + r.randrange(3)) for _ in range(20)), r.randrange(2)) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None, 1), (98, "a b", None)], "id long, text string, label int")
    alpha, beta, l1, l2 = 0.5, 1.0, 0.2, 0.1
    model = learn_toxicity(df, bits=18, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    order = [x["id"] for x in df.where("text is not null and label is not null").select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("h").collect()]
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)
    said = {i: (t, y) for i, t, y in rows}
    for _ in range(2):
        for i in order:
            x, y = slow_features(said[i][0]), said[i][1]
            w, b = {f: weight(f) for f in x}, -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-sum(w.values()) - b)) - y
            for f in x:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[f]
                n[f] = old + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
            bn += g * g
    want = sorted(weight(f) for f in z if weight(f))
    assert len(want) > 50 and np.allclose(sorted(model.weights.tolist()), want)
    assert abs(model.bias + bz / ((beta + math.sqrt(bn)) / alpha)) < 1e-9
    few = learn_toxicity(df, bits=18, max_train_bytes=200, l1=0.0)
    assert 0 < len(few.slots) < len(model.slots) * 3 and len(learn_toxicity(df, bits=18, max_train_bytes=1).slots) == 0
    got = score(df.select("id", "text", F.lit("x").alias("Score"), F.lit(1).alias("_text")), model, keep=("id", "Score", "_text"))
    assert got.columns == ["id", "_text", "score", "predicted"]
    for x in got.collect():
        total = model.bias + sum(weight(f) for f in slow_features(dict((i, t) for i, t, _ in rows).get(x["id"], "a b" if x["id"] == 98 else None)) if f in z)
        assert abs(x["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_em_is_plain_em():
    r = np.random.default_rng(2)
    like, first = r.random((30, 4)), np.array([0, 7, 7, 30])
    row = np.repeat(np.arange(3), np.diff(first))
    allowed = np.array([[1.0, 1, 1, 1], [1, 1, 1, 1], [0, 1, 0, 1]])
    pi, ll = _em(like.astype(np.float32), row, first, allowed, 5)
    for t in range(3):
        p = allowed[t] / allowed[t].sum()
        words = like[first[t] : first[t + 1]]
        for _ in range(5):
            shares = [w * p / sum(w * p) for w in words]
            p = sum(shares) / len(words) if len(words) else p
        if len(words):
            assert np.allclose(pi[t], p, atol=1e-4) and abs(ll[t] - sum(math.log(sum(w * p)) for w in words)) < 1e-3


def test_language_likelihoods_are_those_of_plain_counts(spark):
    rows = [(1, "abc Abd", "x"), (2, "zzz éé", "y"), (3, None, "x"), (4, "q", None), (5, "!!", "z")]
    model = learn_languages(spark.createDataFrame(rows, "id long, text string, lang string"), bits=12, smoothing=0.5)
    assert model.langs == ["x", "y", "z"]
    for k, (lang, words) in enumerate((("x", ["abc", "abd"]), ("y", ["zzz", "éé"]), ("z", []))):
        grams = [b[i : i + 3] for w in words for b in [b" " + w.encode() + b" "] for i in range(len(b) - 2)]
        n = np.full(1 << 12, 0.5)
        for g in grams:
            n[(int.from_bytes(g, "big") * 0x9E3779B1 % (1 << 32)) >> 20] += 1
        assert np.allclose(model.logp[:, k], np.log(n / n.sum()), atol=1e-5)
    df = spark.createDataFrame([(1, "abc", "k"), (1, "abc", "k"), (2, "abd " * 20_000, "k")], "id long, text string, LANG_PRED string")
    got = identify(df, model, keep=("id", "LANG_PRED"))
    assert got.columns == ["id", "lang_pred", "score", "n_langs"] and [x["lang_pred"] for x in got.collect()] == ["x"] * 3


PROSE = "Some, words of, the article that go on, and on, for quite a while, until the line ends at last. "


def test_pages_without_article_and_with_misleading_names():
    page = "<body><div class=menu><a href=/>Home</a></div><div class='{}'><h1>Head</h1>{}</div><div class='side'><a href=/x>more, of, this</a></div><footer>Foot, er</footer></body>"
    body = "".join(f"<p>{PROSE * k}</p>" for k in (1, 2, 1))
    want = " ".join(["Head", *((PROSE * k).strip() for k in (1, 2, 1))])
    for name in ("post", "elementor-widget-container", "related-work", "widget", "content-widget", "sidebar", "ad", "notice", "social", "x skip"):
        assert main_text(page.format(name, body)) == want, name
    assert main_text("<body><form id=aspnetForm>" + page.format("main", body) + "</form></body>") == want
    inner = f"<article><h1>Head</h1><p>{PROSE}</p><div class='{{}}'><p>{PROSE}</p></div><p class='{{}}'>{PROSE}</p></article>"
    both = f"Head {PROSE}{PROSE}{PROSE}".strip()
    assert main_text(inner.format("related-work", "social")) == main_text(inner.format("elementor-widget-container", "widget notice")) == both
    for name in ("related-posts", "ad-slot", "social-links", "cookieNotice", "newsletter", "comment-list"):
        assert main_text(inner.format(name, "x")) == f"Head {PROSE}{PROSE}".strip(), name
    comments = f"<div id=a><p>{PROSE}</p></div><section class=comments>{f'<p>{PROSE}</p>' * 9}</section>"
    assert main_text(comments) == PROSE.strip()
    rows = "".join(f"<div class=row><div class=col><p>{PROSE}</p><p>{PROSE}</p></div></div>" for _ in range(4))
    assert main_text(f"<body><div>{rows}</div></body>") == (PROSE * 8).strip()
    assert main_text(f"<nav><p>{PROSE}</p></nav>") == "" and main_text("<p>a<button>x</button>b, <span hidden>c</span>d") == "ab, d"


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.up, self.tag, self.texts, self.stack = [-1], ["#root"], [], [0]

    def handle_starttag(self, tag, attrs):
        self.up.append(self.stack[-1])
        self.tag.append(tag)
        self.stack.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.texts.append((self.stack[-1], data.strip()))


def test_scores_are_those_of_a_slow_tree():
    r = random.Random(9)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            text = "w, " * r.randrange(1, 200) + "x" * r.randrange(1, 60)
            return f"<p>{text}</p>" if r.random() < 0.7 else f"<p><a>{text}</a></p>"
        tag = r.choice(["div", "section", "article", "main"])
        return f"<{tag}>{''.join(made(depth - 1) for _ in range(r.randrange(1, 4)))}</{tag}>"

    for _ in range(150):
        page = made(6)
        tree, p = Tree(), _Page(page)
        tree.feed(page)
        assert p.tag == tree.tag and p.parent == tree.up
        points, length, links = ([0.0] * len(tree.tag) for _ in range(3))
        for node, text in tree.texts:
            above = [node]
            while tree.up[above[-1]] >= 0:
                above.append(tree.up[above[-1]])
            for a in [a for a in above if tree.tag[a] != "a"]:
                length[a] += len(text)
                links[a] += len(text) * ("a" in [tree.tag[x] for x in above])
            par = next(k for k, a in enumerate(above) if tree.tag[a] == "p")
            for share, a in enumerate([a for a in above[par + 1 :] if a > 0][:4], 1):
                points[a] += (1 + text.count(",") + min(len(text) / 100, 3)) / share
        got = scored(p, _left_out(p))
        assert np.allclose(got[0], points) and got[1] == length and np.allclose(got[2], [b / a if a else 0 for a, b in zip(length, links)])


def test_page_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "u", "t", "h"), (1, "<p>a", "u", "t", "h"), (None, None, None, None, None)], "page_id long, html string, url string, TEXT string, _html string")
    got = extract(df, keep=("page_id", "TEXT", "_html"))
    assert got.columns == ["page_id", "_html", "text", "n_chars"] and sorted(tuple(x) for x in got.collect() if x["page_id"]) == [(1, "h", "a", 1)] * 2
