"""Answer policy, speech text, sessions, audio and artifacts against plain Python."""

import dataclasses
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import policy as G
from skein.functions import speech as V
from skein.functions import text as T
from skein.operators import dense, sessions
from skein.operators import ingest as I
from skein.rules import SYNTHETIC, Intent, Profile
from skein.sources import records as S
from skein.streaming import audio, voice

RULES = Profile(
    intents={
        "fees": Intent(("fee",), 3, trusted_sources=("/fees",), denied_sources=("spam",), fact_tokens=("price", "roubles"), boost_terms=("price",), noisy_sentences=("cookie",), display_summary="Fees are on the fees page.", speaker_summary="See the fees page.", display_keeps=r"\b\d{3,} roubles", speaker_keeps=r"\b\d{3,} roubles"),
        "news": Intent(("news",), 2, allowed_sources=("/news",)),
    },
    menu_markers=("structure",),
    facet_support={"fee": ("price",)},
)


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else T.words_in(v).alias(k) for k, v in values.items()])
    return row.select(*columns).first()


def test_trust_and_focus(spark):
    row = one(spark, G.trusted(F.col("s"), F.col("i"), RULES), G.trusted(F.col("s"), F.lit("news"), RULES), G.focus(F.col("t"), G.hints(F.col("i"), RULES, "fact_tokens")), G.focus(F.col("t"), G.hints(F.lit("none"), RULES, "fact_tokens")), s=["https://a/x", "https://a/FEES/1"], i="fees", t=["what", "price", "price"])
    assert tuple(row) == (True, False, ["price"], ["what", "price"])
    row = one(spark, G.fact_sensitive(F.col("q"), RULES), G.fact_sensitive(F.lit("hello"), RULES), q="What PRICES are there")
    assert tuple(row) == (True, False)


def test_facet_support(spark):
    f = lambda w, g: one(spark, G.facet_support(F.col("w"), F.col("g"), RULES).alias("x"), w=w, g=g).x
    assert [f([], ["a"]), f(["a"], []), f(["a", "b"], ["a"]), f(["fee", "b"], ["price"]), f(["fee"], ["fee"])] == [0.0, 0.0, 0.5, 0.5, 1.0]


def display(spark, text, sources, cover, intent="fees"):
    return one(spark, G.display_policy(F.col("d"), F.col("s"), F.col("c"), F.col("i"), RULES).alias("x"), d=text, s=sources, c=cover, i=intent).x


def test_display_policy(spark):
    fine, summary = "The office tells everything about it on weekdays.", "Fees are on the fees page."
    assert display(spark, fine, ["x"], 0.5) == fine
    assert display(spark, fine, ["x"], 0.1) == summary  # too little evidence and no facts
    assert display(spark, "The price is given in roubles there.", ["x"], 0.1) == "The price is given in roubles there."
    assert display(spark, "yes", ["x"], 1.0) == summary
    assert display(spark, "It is 500 roubles", ["x"], 0.0) == "It is 500 roubles"
    menu = "structure " + " ".join(f"title{i}" for i in range(24))
    assert display(spark, menu, ["x"], 1.0) == summary and display(spark, menu.replace("structure", "list"), ["x"], 1.0) != summary
    long = " ".join(f"word{i}." for i in range(40))
    assert display(spark, long, ["https://a/fees"], 1.0) == summary and display(spark, long, ["x"], 1.0) == long
    assert display(spark, "yes", ["x"], 1.0, "news") == "yes"  # no summary


def test_speaker_policy(spark):
    said = lambda s, d, src: one(spark, G.speaker_policy(F.col("s"), F.col("d"), F.col("src"), F.lit("fees"), RULES).alias("x"), s=s, d=d, src=src).x
    plain = "The office tells everything about it."
    assert said(plain, "", ["x"]) == plain and said(plain, "", ["/fees"]) == "See the fees page." and said("yes", "", ["x"]) == "See the fees page."
    assert said("yes", "it is 500 roubles", ["/fees"]) == "yes"


def plain_sentences(text, question):
    """The two best sentences, in order."""
    import re

    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    named = lambda x: {t.lower() for t in re.findall(T.TOKEN, x) if len(t) > 2}
    wanted = {t for t in named(question) if t not in RULES.speaker_stopwords}
    score = lambda i, s: len(wanted & named(s)) + (0.1 if i < 3 else 0) - 0.03 * abs(len(s.split()) - 12)
    best = sorted(range(len(parts)), key=lambda i: (-round(score(i, parts[i]), 9), i))[:2]
    return " ".join(parts[i] for i in sorted(best))


def test_speaker_sentences(spark):
    text = "One two. The rooms of the house are large and bright. Nothing here. Rooms cost little in winter and more in summer, they say. The end comes last and it is near."
    for question in ("rooms in winter", "the end", "", "nothing"):
        got = one(spark, G.speaker_sentences(F.col("d"), F.col("q"), RULES).alias("x"), d=text, q=question).x
        assert got == plain_sentences(text, question)
    assert one(spark, G.speaker_sentences(F.col("d"), F.col("q"), RULES).alias("x"), d="**", q="x").x == ""


def test_extract(spark):
    hits = [("https://a/1", "The price of a room is low now. We use a cookie for price of things. Nothing else is here."), ("https://a/fees", "the PRICE of a  room is low now. All roubles are counted twice a day.\nA price list hangs there too"), ("https://spam/1", "price price room room here now")]
    df = spark.createDataFrame([(1, hits)], "id long, hits array<struct<source:string,text:string>>")
    got = lambda intent, tokens: df.select(G.extract(F.col("hits"), T.words_in(tokens), F.lit(intent), RULES).alias("x")).first().x
    # the trusted source's copy comes first, so equal sentences are said once; noise and spam go
    assert got("fees", ["price", "room"]) == "the PRICE of a  room is low now. A price list hangs there too"
    assert got("none", ["price", "room"]) == "The price of a room is low now. price price room room here now"
    assert got("fees", ["zebra"]) .startswith("the PRICE") and got("none", ["zebra"]) == "" and got("news", ["price"]) == ""


def test_links_to_any_depth_and_link_lists(spark):
    row = one(spark, A.strip_links(F.col("a")), A.strip_links(F.col("b")), A.strip_leading(F.col("c"), r"The house\s*[—-]\s*a home\.?"), A.strip_leading(F.lit("The house - a home."), r"The house\s*[—-]\s*a home\.?"), a="[" * 9 + "deep" + "](x)" * 9, b="see ![pic](p.png) there", c="the house — a home. It stands.")
    assert row[0] == "deep" and row[1] == "see !pic there" and row[2] == "It stands." and row[3] == "The house - a home."
    body = "A sentence that is long enough to stay as it is."
    row = one(spark, A.strip_link_soup(F.col("a")), A.strip_link_soup(F.col("b")), A.strip_link_soup(F.col("c")), a=f"{body} [x](/pubs?id=1)" + " [y](/z)" * 8, b=f"{body} [x](/pubs?id=1)", c=f"{body}\n" + "[y](/z) " * 4 + "\nend")
    assert row[0] == body and row[1].endswith("(/pubs?id=1)") and row[2] == f"{body}\nend"


def spoken(n):
    return V.number_words(n)


def test_spoken_numbers(spark):
    numbers = [*range(0, 130), 200, 305, 999, 1000, 1001, 2011, 3040, 4999, 5000, 7777, 9999]
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    assert {r.n: r.w for r in df.select("n", V.spoken_number(F.col("n")).alias("w")).collect()} == {n: spoken(n) for n in numbers}
    said = {"007": "ноль ноль семь", "000": "ноль ноль ноль", "0150": "ноль сто пятьдесят"}
    for digits, want in said.items():
        assert one(spark, V.spoken_digits(F.col("d")).alias("x"), d=digits).x == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("**ул.** Большая, д. 67", "улица Большая, дом шестьдесят семь"),
        ("начало в 10:30, конец в 12:00", "начало в десять тридцать, конец в двенадцать"),
        ("тел. 571-15-22", "телефон пятьсот семьдесят один пятнадцать двадцать два"),
        ("вес 5 кг, рост 12345 и a1b", "вес пять килограмм, рост 12345 и a1b"),
        ("# Заголовок\n* пункт/подпункт (там)", "Заголовок пункт или подпункт, там,"),
        ("цена 250 руб. — мало", "цена двести пятьдесят рублей — мало"),
    ],
)
def test_speech_text(spark, text, want):
    assert one(spark, V.speech_text(F.col("t")).alias("x"), t=text).x == want


def plain_merge(parts, least=10):
    out, held = [], ""
    for s in parts:
        held = f"{held} {s}".strip()
        if len(held) >= least:
            out.append(held)
            held = ""
    if held:
        out = [*out[:-1], f"{out[-1]} {held}"] if out else [held]
    return out


def test_speech_sentences(spark):
    for text in ("Да. Нет. Это так… А вот и длинное предложение! Ок.", "Ок.", "", "Один два три четыре. Пять."):
        import re

        parts = [x.strip() for x in re.split(r"(?<=[.!?…])\s+", text) if x.strip()]
        assert one(spark, V.speech_sentences("t").alias("x"), t=text).x == plain_merge(parts)


def test_wake_words(spark):
    phrase = "hey big computer"
    for text, found, rest in (("well hey big computer lights on", True, "lights on"), ("hey, computer!", True, ""), ("hey you", False, ""), ("", False, ""), ("Hey Big Computers go", True, "go")):
        row = one(spark, *V.wake_word("t", phrase), t=text)
        assert (row[0], row[1]) == (found, rest)


# --- sessions ---------------------------------------------------------------------------------------


def test_segments_and_partials(spark):
    p = [0.1] * 5 + [0.9] * 60 + [0.4] * 3 + [0.1] * 30 + [0.9] * 3 + [0.1] * 40 + [0.8] * 900
    rows = [(s, i, x) for s in (1, 2) for i, x in enumerate(p if s == 1 else p[:70])]
    df = spark.createDataFrame(rows, "stream_id long, frame long, prob double").repartition(3)
    got = {s: [(r.segment, r.first_frame, r.last_frame, r.n_frames) for r in sessions.segment_streams(df).filter(f"stream_id = {s}").orderBy("segment").collect()] for s in (1, 2)}
    # the second burst is too short; the last one is cut at its longest
    assert got[1] == [(0, 0, 89, 85), (1, 125, 920, 780), (2, 905, 1040, 120)] and got[2] == [(0, 0, 69, 65)]
    every = sessions.segment_streams(df, partials=True).filter("stream_id = 2")
    assert [(r.kind, r.n_frames) for r in every.orderBy("n_frames").collect()] == [("partial", 19), ("partial", 38), ("partial", 57), ("final", 65)]


def test_history_tasks_and_files(spark):
    df = spark.createDataFrame([(1, [("user", " a "), (None, "b"), ("", "c"), ("assistant", " "), ("assistant", None)])], "id long, h array<struct<role:string,content:string>>")
    assert [tuple(x) for x in df.select(sessions.normalized_history(F.col("h")).alias("x")).first().x] == [("user", "a"), ("user", "b"), ("user", "c")]
    tasks = spark.createDataFrame([("s", "partial", 1), ("s", "final", 1), ("s", "partial", 2), ("t", "partial", 1)], "stream_id string, kind string, generation int")
    assert sorted(tuple(r) for r in sessions.latest_generation(tasks).collect()) == [("s", "final", 1), ("s", "partial", 2), ("t", "partial", 1)]
    files = spark.createDataFrame([(f"f{i}", i // 2) for i in range(10)], "path string, modified long")
    assert sorted(r.path for r in sessions.retained(files, 3).collect()) == ["f0", "f1", "f2", "f3", "f4", "f5", "f7"]


def test_gate_and_controls(spark, tmp_path):
    controls = spark.createDataFrame([("a", "mute", 5.0), ("a", "unmute", 9.0), ("b", "wake", 1.0)], "session_id string, kind string, ts double")
    frames = spark.createDataFrame([("a", t) for t in (1.0, 5.0, 7.0, 9.5)] + [("b", 2.0)], "session_id string, ts double")
    assert sorted(tuple(r) for r in voice.gated(frames, controls).collect()) == [("a", 1.0), ("a", 9.5), ("b", 2.0)]
    voice.control_sink(str(tmp_path / "control"))(controls, 0)
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "control")).collect()] == [(False, "a")] or spark.read.json(str(tmp_path / "control")).first().muted is False


def test_memory_of_a_stream(spark, tmp_path):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)] + [(2, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn int, role string, text string").parquet(str(tmp_path / "in"))
    voice.remembered(stream, 10).writeStream.format("memory").queryName("held").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("held").collect()) == [(1, 10, "assistant"), (2, 1, "user")]


def test_silent_sessions_end_by_a_timer(spark, tmp_path):
    def put(name, said):
        spark.createDataFrame([(s, t, a) for s, t, a in said], "stream_id long, text string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    put("in", [(1, "hey computer", 10), (1, "lights", 12)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: voice.active_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "hey computer", ("stop",)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    put("in", [(2, "other stream", 100)])  # stream 1 says nothing more
    run()
    got = [(r.stream_id, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(1, "query"), (1, "timeout"), (1, "wake")]


def test_file_watch(tmp_path):
    seen, path = [], tmp_path / "lines.txt"
    path.write_text("old\n")
    watch = voice.FileWatch(str(path), seen.append)
    assert watch.poll() == 0
    with path.open("a") as f:
        f.write("new\n\nmore\n")
    assert watch.poll() == 2 and seen == ["new", "more"]
    path.write_text("other\n")
    watch.run(lambda: len(seen) > 2, 0.01)
    assert seen[-1] == "other"


# --- audio, models, files -----------------------------------------------------------------------------


def test_audio(spark):
    x = np.arange(48, dtype=np.float32)
    y = audio.resampled(x, 48_000)
    assert len(y) == 16 and y[0] == 0 and y[-1] == 47 and np.allclose(np.diff(y), 47 / 15)
    assert len(audio.resampled(x, 8000)) == 96 and audio.resampled(x, 16_000) is not None and len(audio.faster(x, 2.0)) == 24
    assert audio.mono([[1, 3], [2, 4]]).tolist() == [2.0, 3.0] and [len(f) for f in audio.frames(np.zeros(1100))] == [512, 512]
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],), (None,)], "s array<float>")
    assert [r.x for r in df.select(audio.resample(F.col("s"), 32_000).alias("x")).collect()] == [[0.0, 3.0], None]
    q = audio.FrameQueue(2)
    assert [q.put(x) for _ in range(3)] == [True, True, False] and q.dropped == 1 and q.get() is x and q.get() is x and q.get(0.01) is None
    models = audio.Models()
    assert models.probability(x) == 0.0 and models.text(x) == "" and models.same_voice([1, 0], x) and len(models.audio("a")) == 0
    own = audio.Models(speech=lambda f: 0.9, transcribe=lambda a: f"{len(a)}", voice=lambda a: [1.0, 0.0], synthesize=lambda t: np.ones(len(t)))
    assert own.probability(x) == 0.9 and own.text(x) == "48" and own.same_voice([2, 0], x) and not own.same_voice([0, 1], x) and len(own.audio("abc")) == 3
    assert audio.devices(lambda: [{"name": "out"}, {"name": "mic", "max_input_channels": 1}]) == [(1, "mic")]
    assert audio.RuntimePaths.of("/x").control_output.name == "voice_control.json"


def test_encoder(spark):
    loads = []

    def make(device):
        loads.append(device)
        if device == "gpu":
            raise MemoryError
        return lambda texts: [[float(len(t)), float(t.startswith("Q: ")), 0.0] for t in texts]

    e = dense.Encoder("m1", 3, make, batch=2, prompt="Q: ", devices=("gpu", "cpu"))
    rows = e.encode(["abc", None, "abcd efgh"])
    assert rows.dtype == np.float32 and np.allclose(np.linalg.norm(rows, axis=1), [1, 0, 1]) and loads == ["gpu", "cpu", "gpu"]
    assert e.encode(["abc"], query=True)[0][1] > 0
    none = dense.Encoder("m2", 4)
    df = spark.createDataFrame([("c1", "x"), ("c2", None)], "chunk_id string, text string")
    assert not none.available and [r.embedding for r in none.documents(df).collect()] == [[0.0] * 4] * 2
    simple = dense.Encoder("m3", 2, lambda device: lambda texts: [[3.0, 4.0]] * len(texts))
    assert np.allclose([r.embedding for r in simple.documents(df).collect()], [[0.6, 0.8]] * 2)
    rank = dense.Reranker("r1", lambda: lambda pairs: [len(a) + len(b) for a, b in pairs])
    assert [r.x for r in df.fillna("").select(rank.column(F.lit("ab"), F.col("text")).alias("x")).collect()] == [3.0, 2.0] and dense.Reranker("r2").column is None


def test_pdf_text():
    show = b"BT (Hello \\(big\\)) Tj [(wor) -20 (ld)] TJ <FEFF0041> Tj (new\\012line) ' ET"
    deflated = b"5 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(show) + b"\nendstream\nendobj"
    assert S.pdf_text(deflated) == "Hello (big) world A new\nline" == S.pdf_text(b"stream\n" + show + b"\nendstream")
    assert S.pdf_text(show).startswith("Hello") and S.pdf_text(b"nothing") == ""
    words = b"stream\n" + zlib.compress(b"(" + b"word " * 40 + b") Tj") + b"\nendstream"
    assert S.parse_file("a.pdf", words)[1:] == ("pdf", False)
    scan = S.paged(lambda content: (bytes([i]) for i in range(100)), lambda page: f"page {page[0]}" if page[0] != 1 else " ", 4)
    assert S.parse_file("a.pdf", deflated, scan) == ("page 0\npage 2\npage 3", "ocr", False)


def test_crawl_artifacts(spark, tmp_path):
    rows = [("https://www.example.net/a", '<a href="/f.pdf">x</a><a href="/b">y</a>', None), ("https://www.example.net/b", '<a href="/f.pdf?x=1">x</a>', "see [d](/d.docx)")]
    df = spark.createDataFrame(rows, "url string, html string, markdown string")
    found = S.write_crawl(df, str(tmp_path / "raw"), [{"job_id": "7", "start_url": "https://www.example.net/"}], ["example.net"])
    assert found["record_count"] == 2 and found["job_ids"] == ["7"]
    assert [json.loads(r.value)["url"] for r in spark.read.text(f"{tmp_path}/raw/document_links").collect()] == ["https://www.example.net/d.docx", "https://www.example.net/f.pdf"]
    assert json.loads(spark.read.text(f"{tmp_path}/raw/manifest").first().value) == found
    seed = S.write_seed(df, str(tmp_path / "seeds"), "https://www.example.net/", "8", "completed")
    assert seed["record_count"] == 2 and S.read_seed_records(spark, str(tmp_path / "seeds")).count() == 2


def test_crawl(spark):
    words = " ".join(f"word{i}" for i in range(12))

    def fetch(url):
        pages = {"p1": ("p2", "p3", "x.pdf"), "p2": ("p1", "p4"), "p3": (), "p4": ("p5",), "p5": ()}
        name = url.rsplit("/", 1)[-1]
        if name == "p5":
            raise OSError
        body = "".join(f'<a href="/{x}">{x}</a>' for x in pages[name])
        return (404 if name == "p3" else 200), "text/html; charset=utf-8", f"<p>{'few' if name == 'p4' else words}</p>{body}"

    seeds = spark.createDataFrame([("https://www.example.net/p1",), ("https://www.example.net/p1/",), ("ftp://x",)], "url string")
    rules = dataclasses.replace(SYNTHETIC, hosts=("example.net",))
    got = {(r.url[-2:], r.depth) for r in I.crawl(seeds, fetch, rules).collect()}
    assert got == {("p1", 0), ("p2", 1)}  # p3 isn't there, p4 has too few words, so p5 is never met
    assert I.crawl(seeds, fetch, rules, most_pages=1).count() == 1


def test_checksum_of_a_large_corpus(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    whole = S.corpus_checksum(df, "k", "h").first()[0]
    monkeypatch.setattr(S, "CHECKSUM_ROWS", 60)
    parts = S.corpus_checksum(df, "k", "h").first()[0]
    assert parts == S.corpus_checksum(df.orderBy(F.desc("k")).repartition(3), "k", "h").first()[0] != whole
    assert parts != S.corpus_checksum(df.withColumn("h", F.when(F.col("k") == 9, "x").otherwise(F.col("h"))), "k", "h").first()[0]


def plain_pack(blocks, section, least, most, overlap):
    import re

    count = lambda t: max(1, len(re.findall(T.ESTIMATE, t)))
    out, held, n, heading, tail = [], "", 0, section, ""
    whole = lambda: (f"{tail} {held}" if tail else held).strip()
    for h, b in blocks:
        if held and n + count(b) > most:
            out.append([whole(), heading, min(overlap, len(tail.split()))])
            tail, held, n = " ".join(whole().split()[-overlap:]) if overlap else "", b, 0
        else:
            held = f"{held} {b}" if held else b
        n += count(b)
        heading = h or heading
    if held and (not out or count(whole()) >= least):
        out.append([whole(), heading, min(overlap, len(tail.split()))])
    elif held:
        out[-1][0] = f"{out[-1][0]} {whole()}".strip()
    return [tuple(x) for x in out]


def test_pack_against_a_plain_fold(spark):
    import random

    rng = random.Random(3)
    docs = [(i, [(rng.choice(["", "", f"h{j}"]), " ".join(["w"] * rng.choice([1, 3, 10, 40]))) for j in range(rng.randint(0, 25))]) for i in range(60)]
    df = spark.createDataFrame(docs, "i int, b array<struct<heading:string,block:string>>")
    for least, most, overlap in ((5, 30, 4), (20, 35, 0), (1, 12, 30)):
        got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", I.pack(F.col("b"), F.lit("s"), least, most, overlap).alias("c")).collect()}
        assert got == {i: plain_pack(b, "s", least, most, overlap) for i, b in docs}


def greedy(rows):
    """A row is a duplicate if a kept earlier row has one of its keys."""
    a, b, out = set(), set(), {}
    for o, x, y in sorted(rows):
        out[o] = (x is not None and x in a) or (y is not None and y in b)
        if not out[o]:
            a.add(x), b.add(y)
    return out


def test_two_key_dedupe_against_a_greedy_pass(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.choice([None, *range(25)]), rng.choice([None, *"abcdefghijklmnopqrst"])) for i in range(150)]
    got = I.two_key_dedupe(spark.createDataFrame(rows, "o long, a int, b string"), "o", "a", "b")
    assert {r.o: r.is_duplicate for r in got.collect()} == greedy(rows)


def test_markdown_titles(spark):
    for text, want in (("x\n## Head line  \ny", "Head line"), ("ab\n#\n  Long line here", "Long line here"), ("ab", "file"), ("y" * 200, "y" * 160)):
        assert one(spark, T.markdown_title("t", F.lit("file")).alias("x"), t=text).x == want


def test_profile_from_json():
    raw = {"intents": {"a": {"query_hints": ["x"], "display_keeps": "y"}}, "menu_markers": ["m"]}
    p = Profile.from_json(json.dumps(raw))
    assert p.intents["a"].display_keeps == "y" and p.menu_markers == ("m",) and dataclasses.replace(SYNTHETIC, leading="x").leading == "x"
