import dataclasses

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine, build_index
from skein.rules import SYNTHETIC
from skein.sources.records import RAW

PROFILE = dataclasses.replace(SYNTHETIC, own_marker="")
TOPICS = {"rooms": "Dormitory rooms and prices are listed here for students. The office opens early.", "physics": "The faculty of physics teaches optics and waves. It has laboratories.", "dates": "Admission dates are announced in spring. Papers are taken in June."}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [(f"https://www.example.net/en/{name}", name.title(), None, f"{text} " * 4, None, None, None, None, None, None) for name, text in TOPICS.items()]
    rows.append(("https://www.example.net/en/rooms?x=1", "Copy", None, rows[0][3], None, None, None, None, None, None))
    df = spark.createDataFrame([(u, t, h, None, None, None, None, None, None, None) for u, t, _, h, *_ in rows], RAW).withColumn("ord", F.monotonically_increasing_id())

    def encode(chunks):
        marks = [F.contains(F.lower("text"), F.lit(w)).cast("float") for w in ("room", "physic", "date")]
        return chunks.select("chunk_id", F.array(*marks).alias("embedding"))

    assert build_index(spark, df, path, PROFILE, encode=encode) == {"doc_count": 4, "chunk_count": 3}
    return path


def queries(spark):
    return spark.createDataFrame([(0, "room prices"), (1, "optics"), (2, "qqq")], "query_id long, query string")


def test_search_and_evidence(spark, index):
    engine = Engine.load(spark, index, PROFILE, "fast")
    got = {(r.query_id, r.place): r for r in engine.evidence(queries(spark)).collect()}
    assert got[0, 1].source.endswith("rooms") and got[1, 1].source.endswith("physics") and (2, 1) not in got
    assert got[0, 1].grounding_score > 0

    def encode(q):
        marks = [F.contains("text", F.lit(w)).cast("float") for w in ("room", "optic", "date")]
        return q.select("query_id", F.array(*marks).alias("embedding"))

    full = Engine.load(spark, index, PROFILE, encode_queries=encode, reranker=lambda q, t: F.lit(1.0))
    best = {r.query_id: r.source for r in full.search(queries(spark)).filter("place = 1").collect()}
    assert best[0].endswith("rooms") and best[1].endswith("physics")


def test_answers(spark, index):
    engine = Engine.load(spark, index, PROFILE, "fast")
    plain = {r.query_id: r for r in engine.answer(queries(spark)).collect()}
    assert "optics" in plain[1].display and plain[1].fallback and plain[1].sources
    reply = lambda q, c: F.lit("<display>The faculty of physics teaches optics and waves [x](y).</display><speaker>Optics are **taught**.</speaker>")
    said = {r.query_id: r for r in engine.answer(queries(spark), reply).collect()}
    assert said[1].display == "The faculty of physics teaches optics and waves x." and said[1].speaker == "Optics are taught." and not said[1].fallback


def test_no_manifest(spark, tmp_path):
    with pytest.raises(Exception):
        Engine.load(spark, str(tmp_path / "none"), PROFILE)
