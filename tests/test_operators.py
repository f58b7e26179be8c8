import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import ingest as I
from skein.operators import retrieval as R
from skein.operators import sessions as S
from skein.rules import SYNTHETIC as P


def test_dedupe_longest_keeps_the_first_of_equals(spark):
    rows = [(3, "u", "ab"), (1, "u", "a"), (2, "u", "xy"), (4, "v", None)]
    got = I.dedupe_longest(spark.createDataFrame(rows, "o int, k string, t string"), "k", "t", "o").collect()
    assert sorted((r.k, r.o, r.seen) for r in got) == [("u", 2, 1), ("v", 4, 4)]


def greedy(rows):
    seen_a, seen_b, out = set(), set(), {}
    for o, a, b in rows:
        out[o] = (a is not None and a in seen_a) or (b is not None and b in seen_b)
        if not out[o]:
            seen_a.add(a)
            seen_b.add(b)
    return out


def test_two_key_dedupe_is_the_greedy_pass(spark):
    rng = random.Random(3)
    for n in (1, 12, 60):
        rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"pqrstu"])) for i in range(n)]
        got = I.two_key_dedupe(spark.createDataFrame(rows, "o int, a string, b string"), "o", "a", "b").collect()
        assert {r.o: r.is_duplicate for r in got} == greedy(rows)


def test_near_duplicates(spark):
    rows = [(1, "A  b"), (2, "a b"), (3, " "), (4, ""), (5, "c")]
    got = I.near_duplicates(spark.createDataFrame(rows, "o int, t string"), "t", "o").collect()
    assert {r.o: r.is_duplicate for r in got} == {1: False, 2: True, 3: False, 4: False, 5: False}


def blocks_of(text):
    out, heading, held = [], "", []

    def flush():
        if held:
            out.append((heading, " ".join(held).strip()))
            held.clear()

    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            flush()
        elif re.match(r"^(#{1,6}\s+.+|[А-ЯA-Z][^.!?]{3,80}:)$", line):
            flush()
            heading = line.lstrip("#").strip()
        else:
            held.append(re.sub(r"^\s*([-*•]|\d+\.)\s+", "", line))
    flush()
    return out


def packed(blocks, least, most, overlap):
    count = lambda t: max(1, len(re.findall(r"[A-Za-zА-Яа-яЁё0-9_]+", t)))
    out, held, n, tail = [], [], 0, []
    for _, b in blocks:
        if held and n + count(b) > most:
            whole = " ".join([*tail, *held]).strip()
            out.append(whole)
            tail, held, n = whole.split()[-overlap:], [], 0
        held.append(b)
        n += count(b)
    if held:
        whole = " ".join([*tail, *held]).strip()
        if count(whole) >= least or not out:
            out.append(whole)
        else:
            out[-1] = f"{out[-1]} {whole}"
    return out


def test_blocks_and_chunks_follow_a_sequential_fold(spark):
    rng = random.Random(9)
    texts = ["", "\n\n", "# One\na\n- b\n\n2. c\nTitle line here:\nd"]
    for _ in range(60):
        lines = [rng.choice(["", "# Head " + rng.choice("xyz"), "- item", " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(1, 40))]
        texts.append("\n".join(lines))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in df.select("doc_id", I.split_blocks(F.col("text")).alias("b")).collect():
        assert [(b.heading, b.block) for b in r.b] == blocks_of(texts[r.doc_id])
    got = {}
    for r in I.chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: p for i, t in enumerate(texts) if (p := packed(blocks_of(t), 120, 220, 30))}


def test_quality_and_gate(spark):
    rows = [("https://www.example.net/es/1", "t", "free license ### %%% $$$ all rights and the rest"), ("https://www.example.net/en/1", "the", "the " * 50)]
    got = I.assess(spark.createDataFrame([(*r, "web") for r in rows], "canonical_url string, title string, text string, source_type string"), P).collect()
    assert got[0].quality_flags == ["is_boilerplate_heavy", "is_low_priority_source", "is_navigation"] and got[0].quality_score == 0.25
    assert got[1].quality_flags == [] and got[1].page_type == "reference" and got[1].source_facets == ["article", "english"] or got[1].source_facets == ["english"]


def test_records_become_documents(spark):
    from skein.sources.records import RAW

    rows = [("https://www.example.net/a?x=1", "T", "# Head\nthe body text " * 20, None, None, None, None, None, None, None), ("https://www.example.net/a", None, "# Head\nthe body text " * 20, None, None, None, "2011-01-01", None, None, None), ("ftp://x", None, "z", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, RAW).withColumn("ord", F.monotonically_increasing_id())
    got = sorted(I.documents_from_records(df, P).collect(), key=lambda r: r.ord)
    assert [(r.canonical_url, r.title, r.is_duplicate, r.is_archived) for r in got] == [("https://www.example.net/a", "T", False, False), ("https://www.example.net/a", "a", True, True)]
    assert got[1].quality_score <= 0.1


def test_bm25_prefers_the_relevant_document(spark):
    docs = spark.createDataFrame([(1, "dorm rooms and prices"), (2, "faculty of physics"), (3, "prices prices of dorm meals")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "dorm prices"), (1, "physics"), (2, "nothing")], "query_id long, query string")
    got = R.lexical_search(docs, queries, 5, P, expand=False).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 3), (0, 1), (1, 2)] or [(r.query_id, r.doc_id) for r in got] == [(0, 1), (0, 3), (1, 2)]
    web = R.lexical_search(docs, queries, 5, P, expand=False, web_bonus=F.col("doc_id") == 2).filter("query_id = 1").first()
    plain = R.lexical_search(docs, queries, 5, P, expand=False).filter("query_id = 1").first()
    assert round(web.score - plain.score, 6) == 0.1


def test_dense_search_matches_the_jvm(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200, None), (201, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in R.dense_search(v, q, 4).collect()}
    both = v.filter("size(embedding) = 8").crossJoin(q.withColumnRenamed("embedding", "e"))
    want = R.top_k(both.select("query_id", "vec_id", F.round(R.dot(F.col("embedding"), F.col("e")), 6).alias("score")), 4, "score", "vec_id")
    assert got == {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in want.collect()}


def test_diversify_is_the_two_pass_loop(spark):
    rng = random.Random(2)
    for _ in range(5):
        hits = [(0, rng.choice("abc"), i + 1) for i in range(15)]
        out, seen, rest = [], {}, []
        for h in hits:
            (out if seen.get(h[1], 0) < 2 else rest).append(h)
            seen[h[1]] = seen.get(h[1], 0) + 1
        got = R.diversify(spark.createDataFrame(hits, "query_id long, source string, rank int"), 9).orderBy("place").collect()
        assert [r["rank"] for r in got] == [h[2] for h in (out + rest)[:9]]


def test_fusion_and_evidence(spark):
    rows = [(0, 1, "lexical", 0, 4.0, 0.0), (0, 2, "lexical", 0, 2.0, 0.1), (0, 2, "dense", 1, 0.9, 0.1), (0, 3, "dense", 1, 0.9, -2.0)]
    hits = R.fuse(spark.createDataFrame(rows, "query_id long, doc_id long, stage string, stage_order int, score double, policy_score double"))
    got = hits.orderBy("rank").collect()
    assert [(r.doc_id, r.stage, r.adjusted) for r in got] == [(2, "dense", 1.1), (1, "lexical", 1.0), (3, "dense", -1.0)]
    texts = spark.createDataFrame([(0, 1, "w " * 1000), (0, 2, "w"), (1, 1, "a b"), (1, 2, "c " * 899), (1, 3, "d")], "query_id long, rank int, text string")
    assert sorted((r.query_id, r["rank"]) for r in R.evidence(texts).collect()) == [(0, 1), (1, 1)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (1, 7, 3), (2, 8, 1)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(0, 6), (1, 7), (2, 9), (3, None)], "query_id long, doc_id long")
    assert tuple(R.evaluate(ranked, gold).first()) == (4, 0.5, 0.0, 0.5, pytest.approx((0.5 + 0.3333) / 4, abs=1e-4))


def test_intents_and_facets(spark):
    row = spark.range(1).select(R.intents(F.lit("der und with les"), P), R.intents(F.lit("zzz"), P), R.facets(F.lit("shar reti"), P)).first()
    assert row[0] == ["beta", "alpha", "gamma"] and row[1] == ["general"]
    assert row[2] == ["cost", "person", "place"] or "payment" not in row[2]


def test_memory_and_sessions(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in S.memory(turns, 3).orderBy("place").collect()] == [3, 4, 5]
    assert S.history_prompt(turns, 2).first().prompt == "user: t4\nassistant: t5"
    ts = [0, 10, 25, 41, 50, 60, 70, 80]
    ev = spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.session for r in S.bounded_sessions(ev, 15, 30).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 3}
    states = S.session_states(spark.createDataFrame([(1, 0, "wake"), (1, 1, "answer"), (1, 2, "ready"), (1, 3, "query"), (1, 4, "ready")], "s long, o long, kind string"), "kind", "s", "o")
    assert [r.state for r in states.orderBy("o").collect()] == ["listening", "speaking", "speaking", "thinking", "idle"]


def test_frontier_and_filters(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = I.frontier(links, spark.createDataFrame([("a",)], "url string"))
    assert {r.url: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    hits = spark.createDataFrame([(0, "http://spam-farm.x", "alpha"), (0, "http://ok", "alpha"), (1, "http://spam-farm.y", "alpha")], "query_id long, source string, intent string")
    assert sorted((r.query_id, r.source) for r in S.filter_by_intent(hits, P).collect()) == [(0, "http://ok"), (1, "http://spam-farm.y")]
    frames = spark.createDataFrame([(1, i, 0.9 if 10 <= i < 40 else 0.1) for i in range(100)], "stream_id long, frame long, prob double")
    assert [(r.first_frame, r.segment) for r in S.segment_streams(frames).collect()] == [(0, 0)]


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"the {i % 7} thing of reti {i % 3}") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "reti thing 3")], "query_id long, query string")
    runs = [[tuple(r) for r in R.lexical_search(docs.repartition(n), q, 10, P).orderBy("rank").collect()] for n in (1, 7)]
    assert runs[0] == runs[1]
    assert T is not None
