import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import speech as V
from skein.functions import text as T
from skein.functions import urls as U
from skein.rules import SYNTHETIC as P
from skein.rules import Profile


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.org/m/a/a/b/?q=1#top", "https://x.org/a/b"),
        ("HTTP://X.org", "http://X.org/"),
        ("https://x.org/c/c/", "https://x.org/"),
        ("https://x.org/a/m/a/b", "https://x.org/a/b"),
        ("ftp://x.org/a", ""),
        ("", ""),
    ],
)
def test_canonicalize(spark, url, want):
    assert one(spark, U.canonicalize_url(F.lit(url)))[0] == want


def test_links(spark):
    html = '<a href="/a.pdf">x</a><a class=k href="b/c?x=1#y">y</a><a href="mailto:q">m</a><a href="//z.example.com/q">z</a><a href="https://else.org/">e</a>'
    base = F.lit("https://example.com/d/e.html?p")
    assert one(spark, U.page_links(F.lit(html), base, P))[0] == ["https://example.com/d/b/c", "https://z.example.com/q"]
    got = one(spark, U.document_links(F.lit(html), F.lit("[t](https://example.com/m/f.DOCX) [u](https://no.org/f.pdf)"), base, "example.com"))[0]
    assert got == ["https://example.com/a.pdf", "https://example.com/f.DOCX"]


def test_title_and_first_text(spark):
    assert one(spark, T.titles(F.lit("<title> </title><h1>A <b>b</b> &lt;&amp;lt;</h1>")))[0] == "A b <&lt;"
    df = spark.createDataFrame([(" ", "<p>", None), ("m", "h", "j"), (None, None, None)], "markdown string, html string, json string")
    text, mode = T.first_text(("markdown", "markdown"), ("html", "html"), ("json", "json"))
    assert [tuple(r) for r in df.select(text, mode).collect()] == [("<p>", "html"), ("m", "markdown"), ("", "empty")]


def test_cleaning(spark):
    text = "[home](/) › [x](/y)\n# Title\n\n\n\nBody " + "word " * 60 + "\nAll rights reserved by us"
    got = one(spark, T.clean(F.lit(text), ("all rights",), (), F.lit("markdown")))[0]
    assert got.startswith("# Title\n\nBody") and "rights" not in got
    assert one(spark, T.trim_footer(F.lit("all rights then a long body of text here"), ("all rights",)))[0].startswith("all rights")


def test_archive_rule(spark):
    rows = [("in 2011 and 2019", None, True), ("in 2011 and 2024", None, False), ("none 20199", None, False), ("2011", "2022-01-01", False), ("2024", "2018", True)]
    for text, published, want in rows:
        assert one(spark, T.archived(F.lit(text), F.lit(published).cast("string")))[0] is want


def test_tokens_and_expansion(spark):
    got = one(spark, T.tokenize(F.lit("The приём is A_1 ё x to onTION"), P.stopwords))[0]
    assert got == ["при", "a_1", "ontion"]  # one-letter rests, stop words and ё go
    assert one(spark, T.expand(F.array(F.lit("retix")), P.expansions))[0] == ["retix", "heble", "heble", "thonti"]


def sentences_of(text):
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+", text) if p.strip()]


def fold_words(text, most):
    words = text.split()
    if len(words) <= most:
        return text, False
    kept, used = [], 0
    for s in sentences_of(text.strip()):
        if used + len(s.split()) > most:
            break
        kept.append(s)
        used += len(s.split())
    if kept:
        return " ".join(kept), True
    words = words[:most]
    while len(words) > 1 and len(words[-1].strip(".,!?;:-")) < 3:
        words.pop()
    return " ".join(words).rstrip(",;:-").strip(), True


def test_limits_follow_a_sequential_fold(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "", ".", ",", "!"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    text, cut = A.limit_words("t", 12)
    for r in df.select("i", text.alias("x"), cut.alias("c")).collect():
        assert (r.x, r.c) == fold_words(texts[r.i], 12)
    text, cut = A.limit_chars("t", 40)
    assert all(len(r.x) <= 40 or not r.c for r in df.select(text.alias("x"), cut.alias("c")).collect())


def test_answer_text(spark):
    row = one(spark, A.dedupe_sentences(F.lit("A b. a  B. C!")), A.strip_markdown(F.lit("**x** [a [b](c)](d) *y* http://z `k`")), A.sanitize_markdown(F.lit("## A **  b**c")), A.finish(F.lit("One two. Three"))[0], A.finish(F.lit("one two,"))[0], A.tagged(F.lit("<display> d </display>x"))[1])
    assert list(row) == ["A b. C!", "x a b y k", "A **b** c", "One two.", "one.", ""]
    t, changed = A.drop_sentences(F.lit("Important: no. Fine."), ("^important",))
    assert list(one(spark, t, changed)) == ["Fine.", True]
    soup = "Good line\n[a](b) [c](d) [e](f) [g](h)\nEnd"
    assert one(spark, A.strip_link_soup(F.lit(soup)))[0] == "Good line\nEnd"
    t, changed = A.enforce_identity(F.lit("We are Thonre here. Yes."), P.wrong_identity, P.identity)
    assert list(one(spark, t, changed)) == ["This is the one. Yes.", True]


def test_grounding_functions(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, A.coverage(words("a", "b", "a", "c"), words("a", "c")))[0] == 0.6667
    assert one(spark, A.anchor_support(words("opening", "dates"), words("openings")))[0] == 0.5
    text, dropped = A.verified(F.lit("the cat sat on mats. dogs never ever bark loudly. ok yes."), words("cat", "sat"), lambda s: T.tokenize(s))
    assert list(one(spark, text, dropped)) == ["the cat sat on mats. ok yes.", 1]


def test_utterances(spark):
    row = one(spark, V.stop_phrase(F.lit("Stop, please!"), ("stop", "enough")), V.stop_phrase(F.lit("do not stop me now at all"), ("stop",)), *V.wake_word(F.lit("well hey Computer, open doors"), "hey computer"), V.rejected(F.lit("no no no no")), V.rejected(F.lit("!")), V.rejected(F.lit("open the door")))
    assert list(row) == ["stop", None, True, "open doors", "repeats", "short", None]
    assert one(spark, V.speech_sentences(F.lit("Yes. It is a long one… No.")))[0] == ["Yes. It is a long one… No."]
    assert [V.number_words(n) for n in (0, 19, 40, 215, 2001, 7000, 9999)] == ["ноль", "девятнадцать", "сорок", "двести пятнадцать", "две тысячи один", "семь тысяч", "девять тысяч девятьсот девяносто девять"]
    assert V.digits_in_words("007") == "ноль ноль семь"


def test_profile_from_json():
    p = Profile.from_json('{"domain": "a.b", "expansions": {"x": ["y"]}, "intents": {"i": {"query_hints": ["q"], "priority": 2}}, "facet_rules": {"f": {"path_bonus": {"/a": 0.1}}}}')
    assert p.expansions["x"] == ("y",) and p.intents["i"].priority == 2 and p.facet_rules["f"].path_bonus["/a"] == 0.1
    with pytest.raises(ValueError):
        Profile.from_json('{"nope": 1}')
