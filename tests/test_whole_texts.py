"""Catalogue queries take whole texts and tables: no prefix of a text, a turn or a query."""

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import retrieval as R
from skein.plans import answers, ingest, retrieval
from skein.rules import SYNTHETIC as P


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_finalize_tail_takes_whole_documents(spark, tmp_path):
    whole = "word " * 60 + "ends well."
    put(spark, tmp_path, "documents", [(1, whole), (2, whole + " and then it"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.changed, r.out) for r in answers.finalize_tail(spark, str(tmp_path)).collect()}
    assert got == {1: (False, whole), 2: (True, whole), 3: (None, None), 4: (False, "")}


def test_stop_phrases_take_whole_turns(spark, tmp_path):
    phrase = P.stop_phrases[0]
    fill = ["qqq"] * (4 - len(phrase.split()))
    turns = [" ".join([*fill, phrase]), " ".join([phrase, *fill, "qqq"])]  # four words, and five
    put(spark, tmp_path, "conversations", [(1, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r.phrase for r in answers.stop_phrase_filter(spark, str(tmp_path)).collect()}
    assert got == {0: phrase, 1: None}


def test_searches_use_every_token_of_an_item(spark, tmp_path):
    head = " ".join(f"common{'abcdefgh'[i]}" for i in range(8))
    docs = [(1, f"{head} {head} other matter"), (2, f"{head} zebra quartz lantern"), (3, "unrelated words only here"), (4, "a tiny needle")]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    put(spark, tmp_path, "benchmark", [(7, f"{head} zebra quartz lantern"), (8, "tiny needle")], "item_id long, text string")
    items = {r.query_id: r.tokens for r in retrieval._items(spark, str(tmp_path)).collect()}
    assert items[7][-3:] == ["zebra", "quartz", "lantern"] and len(items[7]) == 11
    best = {r.query_id: r.doc_id for r in retrieval.bm25_batch_topk(spark, str(tmp_path)).filter("rank = 1").collect()}
    assert best == {7: 2, 8: 4}
    gold = {(r.query_id, r.doc_id) for r in retrieval.gold(spark, str(tmp_path)).filter("doc_id is not null").collect()}
    assert gold == {(7, 2), (8, 4)}  # document 1 has the item's first 60 characters only


def test_structural_bonus_scores_all_items(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    urls = [r.url for r in pages.select("url").collect()]
    digits = [c for u in urls for c in u if c.isdigit()][:3] or ["1"]
    texts = [*(u.replace("/", " ").replace("-", " ") for u in urls[:8]), *(f"see number {n} of it" for n in digits), "qqqq zzzz", None]
    put(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {(r.item_id, r.page_id): r.bonus for r in retrieval.structural_bonus(spark, str(tmp_path)).collect()}
    b = spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", F.col("text").alias("q"), T.expand(T.tokenize("text", P.stopwords), P.expansions).alias("t"))
    every = ingest.page_records(spark, str(tmp_path)).withColumn("section", U.section("url")).crossJoin(b)
    bonus = F.round(R.structural_bonus(F.col("t"), F.col("q"), F.col("url"), F.col("title"), F.col("section"), P), 6)
    want = {(r.item_id, r.page_id): r.bonus for r in every.select("item_id", "page_id", bonus.alias("bonus")).collect() if r.bonus}
    assert got == want and len({i for i, _ in want}) > 5
