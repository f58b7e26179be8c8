"""The pipeline end to end against a plain-Python version of its five stages."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from skein.llm import language_id, registry
from test_duplicates import every_window, shingles, smallest
from test_models import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int"


def corpus(rng):
    """(documents, benchmark): prose in three languages with repeated lines, copies, passages,
    and rows that hold nothing."""
    items = [(i, prose(rng, "en", rng.randint(12, 40))) for i in range(8)] + [(8, None), (9, "")]
    docs, langs = [], []

    def put(lang, text):
        docs.append(text)
        langs.append(lang)

    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        lines = [prose(rng, lang, rng.randint(6, 30)).replace("\n", " ") for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), "all rights reserved to the owner")
        if i % 7 == 0:
            lines.append(f"page {i} of 60  seen on 2024-01-{i % 28 + 1:02d} by someone here")
        if i % 11 == 0:
            lines.append(items[i % 8][1])
        put(lang if i % 4 else None, "\n".join(lines))
    for base in range(0, 60, 4):  # near copies and exact ones
        for edits in (0, 1, 2):
            w = docs[base].split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited"
            put(langs[base], " ".join(w))
    for text in (None, "", " \n ", "12 34 5678", "Река снова поднялась ночью, и утром нижняя дорога была под водой, школа закрыта на неделю"):
        put(None, text)
    put("en", prose(rng, "en", 12_000))  # a very long one
    rows = [(i, t, g, f"s{i % 3}", len(t or ""), "clash", 7) for i, (t, g) in enumerate(zip(docs, langs))]
    rows += [rows[1], rows[1], (None, docs[2] + " and null ids", "fr", None, None, None, None), (None, docs[2] + " and null ids", "fr", None, None, None, None)]
    return rows, items


def line_keys(line):
    t = " ".join(re.sub(r"[^\s0-9]*[0-9]\S*", "<*>", line, flags=re.A).split())
    w = t.split(" ")
    if 2 * t.count("<*>") > len(w):
        return t, ["=" + " ".join(line.split())]
    tail = len(w) - 3
    keys = ["t" + t]
    if tail >= 4:
        cuts = [3 + tail * j // 4 for j in range(5)]
        parts = [tuple(w[a:b]) for a, b in zip(cuts, cuts[1:])]
        keys += [(len(w), tuple(w[:3]), j, *(p for i, p in enumerate(parts) if i != j)) for j in range(4)]
    return t, keys


def without_lines(rows):
    held = defaultdict(set)
    for r in rows:
        lines = [line_keys(x) for x in r[1].split("\n") if x.strip()]
        for _, keys in lines:
            for k in keys:
                held[k].add(tuple(t for t, _ in lines))
    out = []
    for r in rows:
        left = [x for x in r[1].split("\n") if not x.strip() or all(len(held[k]) < 3 for k in line_keys(x)[1])]
        if len(left) == len(r[1].split("\n")) or "".join(left).strip():
            out.append((r[0], "\n".join(left)))
    return out


def expected(rows, items):
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and not re.search("[а-я]", r[1])]
    kept = without_lines(kept)
    ids = {d for d, _ in kept if d is not None}
    sets = {d: [shingles(t) for e, t in kept if e == d] for d in ids}
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    first = smallest(links, ids)
    once, seen = [], set()
    for d, t in kept:
        if d is None or (first[d] == d and d not in seen):
            once.append((d, t))
            seen.add(d)
    clean = [(d, t) for d, t in once if not every_window([(d, t)], items)]
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    out = []
    for d, t in clean:
        found = model.encode(t, add_eos=True)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((str(d), len(found), digest(" ".join(map(str, found))), digest(model.decode(found))))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, items = corpus(random.Random(5))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_run_against_plain_python(spark, tables):
    folder, rows, items = tables
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())
    want = expected(rows, items)
    assert found == want and 100 < len(want) < len(rows) - 30


def test_stages_keep_the_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(1, "some words of a text", None, "s", 20, None, None), (2, "123", None, "s", 3, None, None)], SCHEMA)
    assert [r.doc_id for r in language_id.keep_identified(one).collect()] == [1]  # nothing to learn from


def test_the_language_stage_goes_by_the_prediction(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = {r[0]: ("en", "de", "fr")[r[0] % 3] for r in rows if r[0] is not None and r[0] < 150}
    kept = {r.doc_id for r in language_id.keep_identified(docs, ["de", "fr"]).collect()}
    assert sum(i in kept for i in lang if lang[i] == "en") <= 2 and sum(i not in kept for i in lang if lang[i] != "en") <= 2
    every = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert set(lang) <= every and not any(r[0] in every for r in rows if r[1] and re.search("[а-я]", r[1]))


def test_queries_cover_all_operators():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert {*names, "pipeline"} <= set(entry.queries()) and set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash", "decontaminate", "sentencepiece"]
