"""HTML extraction, language ID and the language model."""

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import html_tree, interpolated_lm, language_id


# --- HTML ---------------------------------------------------------------------------


def test_sum_product_is_exact():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 7)
        above = [-1] + [rng.randrange(i) for i in range(1, n)]
        single = [rng.uniform(-2, 2) for _ in range(n)]
        pair = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(n)]
        total, ones, pairs = 0.0, [0.0] * n, [[0.0] * 4 for _ in range(n)]
        for labels in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(s * y for s, y in zip(single, labels)) + sum(pair[i][2 * labels[above[i]] + labels[i]] for i in range(1, n)))
            total += p
            for i, y in enumerate(labels):
                ones[i] += p * y
                if i:
                    pairs[i][2 * labels[above[i]] + y] += p
        marginal, four = html_tree.sum_product(above, single, pair)
        assert np.allclose(marginal, [x / total for x in ones])
        assert np.allclose(four[1:], [[x / total for x in p] for p in pairs[1:]])


def test_held_out_blocks():
    model, wrong, total = html_tree.trained(), 0, 0
    for page in html_tree.labelled_pages(100, 1234):
        nodes, blocks = html_tree.parse(page)
        marginal, _ = model.marginals(nodes)
        for i, _ in blocks:
            total += 1
            wrong += (marginal[i] >= 0.5) != (nodes[i].mark == "1")
    assert wrong / total < 0.02


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt; &amp;  more", "just <text> & more"),
        ('<nav><a href="/">m</a></nav><article><h1>T</h1><p><b>one<br><p>two\n three<script>"</p>"</script> four<!-- <p>no --></article><footer>f</footer>', "T\none\ntwo three four"),
        ('<article><h1>T</h1><p>a long enough sentence of text<div class="comments"><p>me too</p></div><p>b &amp; c<br>d</p></article>', "T\na long enough sentence of text\nb & c d"),
        ('<body><div class="cookie-notice">we use</div><div class="content"><p>Hello world this is a long sentence of text for you.</p></div><form><p>Sign up</p></form>', "Hello world this is a long sentence of text for you."),
        ("<article><p>a<span>b</span> c</p></div></p></article><!-- never closed <p>x", "ab c"),
        ("<article><p>x<style>p{}", "x"),
        ("<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join(["w"] * 5000)),
        ("<div>" * 3000 + "deep", None),
        ("<p a='<b>' c=\"unclosed><p>x", None),
    ],
)
def test_pages(page, want):
    got = html_tree.trained().extract(page)
    assert want is None or got == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # elements that embed something: unclosed ones hide nothing but themselves, nested ones all
        ("<article><p>one</p><select><option>A<option>B<p>two</p><video src=x><p>three</p></article>", "one\ntwo\nthree"),
        ("<article><object><object>x</object>y</object><p>z</p></article>", "z"),
        ("<article><p>a<svg><text>no</text></svg>b<svg/>c</p></article>", "a b c"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ('<article><p>cut here</p><div class="never', "cut here"),
        ("<article><p title=it's>x</p><p data-x=\"a>b\">y</p></article>", "x\ny"),
    ],
)
def test_markup(page, want):
    assert html_tree.trained().extract(page) == want


WORDS = "The river rose again in the night and by the morning the lower road was under water, so the school stayed closed."
LAYOUTS = [
    # a blog: sidebar before the post, remarks after it
    (f'<body class="home"><div id="masthead"><a href="/">Blog</a></div><div id="sidebar"><ul><li><a href="/1">Old post</a></li><li><a href="/2">Older post</a></li></ul></div><div id="content"><div class="post"><h2>Flood</h2><div class="entry"><p>{WORDS}</p><p>{WORDS}</p></div></div><div id="comments"><h3>2 replies</h3><ol class="commentlist"><li><p>I saw it as well from my window on the hill.</p></li></ol></div></div><div id="footer"><p>Powered by hope</p></div></body>', f"Flood\n{WORDS}\n{WORDS}"),
    # manual pages: menu beside the main element
    (f'<body><div class="topbar"><form><input name=q><button>Find</button></form></div><div class="wrap"><nav class="toc"><ol><li><a href="#a">Start</a></li><li><a href="#b">Use</a></li></ol></nav><main><h1>Manual</h1><p>{WORDS}</p><pre>run --all</pre><ul><li>first step of the three</li><li>second step of the three</li></ul></main></div></body>', f"Manual\n{WORDS}\nrun --all\nfirst step of the three\nsecond step of the three"),
    # news: notices and adverts in between
    (f'<body><div class="cookie-banner"><p>We use cookies to make this better.</p><button>Fine</button></div><header><div class="logo">News</div><nav><a href="/">Home</a></nav></header><article><header><h1>Water</h1></header><p>{WORDS}</p><div class="ad-slot"><p>Buy boats now</p></div><p>{WORDS}</p></article><aside><h3>More</h3><ul><li><a href="/x">Storm</a></li></ul></aside><footer>&copy; News</footer></body>', f"{WORDS}\n{WORDS}"),
]


@pytest.mark.parametrize(("page", "want"), LAYOUTS)
def test_layouts_that_training_does_not_write(page, want):
    got = html_tree.trained().extract(page).split("\n")
    assert [x for x in got if x not in ("Water",)] == want.split("\n")  # a headline in a header may count either way


def test_hostile_pages_take_linear_time():
    pages = ["<a" * 500_000, "<div>" * 200_000 + "x", "<p>t</p><div class='" + "x " * 500_000, '<a b="' * 170_000, "<!--" * 250_000, "</" * 500_000, "<center>" * 60_000 + "<li></li>" * 60_000, "<" * 1_000_000, "<video>" * 140_000, "<p " + "=" * 1_000_000 + ">x", "<select>" * 70_000 + "</select>" * 70_000]
    for page in pages:
        began = time.process_time()
        html_tree.parse(page)
        assert time.process_time() - began < 4, page[:20]


def test_extract_pages(spark):
    html = '<nav><a href="/">m</a></nav><article><p>é text here</p></article>'
    rows = [(1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, "x"), (None, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_tree.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", "é text here", 11)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_tree.extract_pages(df.limit(0)).count() == 0


# --- language --------------------------------------------------------------------------

STEMS = {"en": ["the", "ing", "tion", "and", "wh", "ou"], "de": ["der", "sch", "ung", "keit", "ein", "ü"], "fr": ["les", "eau", "ment", "é", "oi", "que"], "es": ["ción", "los", "ñ", "ado", "que", "mente"], "xx": ["zza", "kko", "vvi", "qqu", "jje", "bbo"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randint(6, 60)), lang) for i, lang in enumerate(rng.choice(list(STEMS)) for _ in range(500))]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 !?", "fr"), (903, prose(rng, "en", 5000), None), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language_id.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:500] if by[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {900, 901, 902}


def test_language_edge_training(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}
    one = spark.createDataFrame([(i, f"text {i}", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"en"}
    assert language_id.identify(one.limit(0)).count() == 0
    assert language_id.family_of("fr") == language_id.family_of("es") != language_id.family_of("en") and language_id.family_of("xx") == "xx"


# --- language model -----------------------------------------------------------------------


def test_scores_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    vocabulary = [f"W{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 60])]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "NEVER seen words"), (0, docs[0][1]), (None, "w1 w2")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_tokens int").repartition(3)
    got = interpolated_lm.score(df).collect()
    assert len(got) == len(docs)
    tokens = {}
    for d, t in docs:
        tokens[d] = [*(t or "").lower().split(), "</end>"]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for d, _ in docs if not out(d) for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs_tol=1e-8)
        assert r.score <= 0 and math.isfinite(r.score)
    again = {(r.doc_id, round(r.score, 9)) for r in interpolated_lm.score(df.repartition(1)).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}
    empty = interpolated_lm.score(df.limit(0))
    assert empty.count() == 0


def plain_scores(docs, order):
    """{doc_id: log10 probability} by dictionaries, and the mean over held-out tokens."""
    tokens = [(d, [*(t or "").lower().split(), "</end>"]) for d, t in docs]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    pad = ["<begin>"] * order
    counts = Counter(tuple([*pad, *w][k + order - n + 1 : k + order + 1]) for d, w in tokens if not out(d) for n in range(1, order + 1) for k in range(len(w)))
    total, documents = sum(len(w) for d, w in tokens if not out(d)), sum(not out(d) for d, _ in tokens)
    v = sum(len(g) == 1 for g in counts)

    def seen(w, k, less):
        """Bucket and estimates of a token; less: without one occurrence."""
        history = [*pad, *w]
        shares, bucket = [], 0
        for n in range(1, order + 1):
            gram = max(0, counts[tuple(history[k + order - n + 1 : k + order + 1])] - less)
            context = total if n == 1 else documents if k == 0 else counts[tuple(history[k + order - n + 1 : k + order])]
            context = max(0, context - less)
            if n > 1 and context:
                bucket = (n - 1) * interpolated_lm.BUCKETS + min(int(math.log2(context)), interpolated_lm.BUCKETS - 1)
            shares.append(gram / context if context else 0.0)
        return bucket, shares

    cells = Counter()
    for d, w in tokens:
        for k in range(len(w)) if not out(d) else ():
            bucket, shares = seen(w, k, 1)
            cells[bucket, tuple(round(-math.log2(s) * interpolated_lm.STEP) if s else None for s in shares)] += 1
    weights = {}
    for bucket in range(order * interpolated_lm.BUCKETS):
        rows = [(n, [1 / (v + 1), *(0.0 if c is None else 2 ** (-c / interpolated_lm.STEP) for c in cell)]) for (b, cell), n in cells.items() if b == bucket]
        now = [1 / (order + 1)] * (order + 1)
        for _ in range(40):
            new = [1e-3] + [1e-6] * order
            for n, p in rows:
                mixed = [x * y for x, y in zip(now, p)]
                new = [x + n * y / sum(mixed) for x, y in zip(new, mixed)]
            now = [x / sum(new) for x in new]
        weights[bucket] = now
    scores, apart = [], []
    for d, w in tokens:
        each = []
        for k in range(len(w)):
            bucket, shares = seen(w, k, 0)
            each.append(math.log10(sum(x * y for x, y in zip(weights[bucket], [1 / (v + 1), *shares]))))
        scores.append((d, sum(each)))
        apart += each if out(d) else []
    return scores, sum(apart) / len(apart)


def test_scores_against_dictionaries_at_every_order(spark, monkeypatch):
    """Words that mostly follow from the two before them: each order predicts held-out text
    better. Small blocks and two parts a level make the exchange several levels deep."""
    monkeypatch.setattr(interpolated_lm, "BLOCK_BYTES", 600)
    rng = random.Random(17)
    docs = []
    for i in range(220):
        w = [f"W{rng.randrange(12)}" for _ in range(2)]
        for _ in range(rng.randint(0, 60)):
            w.append(f"w{(3 * int(w[-1][1:]) + 5 * int(w[-2][1:])) % 12}" if rng.random() < 0.8 else f"w{rng.randrange(12)}")
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "one rare line"), (0, docs[0][1]), (None, "w1 w2"), (7, "w3 " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    means = []
    for order, bits in ((1, 7), (2, 7), (3, 7), (3, 1)):
        monkeypatch.setattr(interpolated_lm, "FAN_BITS", bits)
        want, mean = plain_scores(docs, order)
        means.append(mean)
        got = sorted(((str(r.doc_id), r.score) for r in interpolated_lm.score(df, order).collect()))
        assert [x for x, _ in got] == [x for x, _ in sorted((str(d), s) for d, s in want)]
        assert np.allclose([s for _, s in got], [s for _, s in sorted((str(d), s) for d, s in want)], rtol=1e-9)
    assert means[0] < means[1] < means[2] == means[3]


def test_the_query_uses_trigrams(spark):
    rng = random.Random(12)
    docs = []
    for i in range(80):
        w = [rng.randrange(2), rng.randrange(2)]
        for _ in range(60):  # only the two words before tell the next one
            w.append(w[-1] ^ w[-2] if rng.random() < 0.98 else rng.randrange(2))
        docs.append((i, " ".join("ab"[x] for x in w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    total = lambda rows: sum(r.score for r in rows.collect())
    assert total(interpolated_lm.score(df)) > 0.7 * total(interpolated_lm.score(df, 2))


def test_the_model_is_a_distribution():
    """Over the vocabulary and one unknown word, probabilities after any context sum to 1."""
    rng = random.Random(3)
    text = [[rng.choice("abcd") for _ in range(30)] + ["$"] for _ in range(8)]
    padded = [["^", "^", *t] for t in text]
    uni = Counter(w for t in text for w in t)
    bi = Counter((t[i - 1], t[i]) for t in padded for i in range(2, len(t)))
    tri = Counter((t[i - 2], t[i - 1], t[i]) for t in padded for i in range(2, len(t)))
    n, v = sum(uni.values()), len(uni)
    weights = interpolated_lm.fit_weights(np.array([[2, 1, 3], [4, -1, -1]]), np.array([5.0, 3.0]), np.array([25, 0]), 3, v)
    assert np.allclose(weights.sum(1), 1) and (weights > 0).all()
    c2, c3 = Counter(), Counter()
    for (a, _), k in bi.items():
        c2[a] += k
    for (a, b, _), k in tri.items():
        c3[a, b] += k
    for context in [("^", "^"), ("a", "b"), ("d", "d")]:
        every = [*uni, "?"]
        grams = [np.array([uni[w] for w in every], float), np.array([bi[context[1], w] for w in every], float), np.array([tri[(*context, w)] for w in every], float)]
        contexts = [np.full(v + 1, float(n)), np.full(v + 1, float(c2[context[1]])), np.full(v + 1, float(c3[context]))]
        p = (weights[interpolated_lm._buckets(contexts)] * interpolated_lm._shares(grams, contexts, v)).sum(1)
        lost = sum(weights[interpolated_lm._buckets(contexts)][0][k + 1] for k in range(3) if contexts[k][0] == 0)
        assert math.isclose(p.sum() + lost, 1, abs_tol=1e-9)
