"""The engine end to end: build an index from records and files, search it, answer."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import policy as G
from skein.functions import text as T
from skein.operators import ingest as I
from skein.operators import retrieval as R
from skein.operators import sessions as M
from skein.rules import Profile
from skein.sources import records as S
from skein.sources.shared import cut as written


def file_titles(text: str, url: str) -> Column:
    """Titles of hand-made documents: the heading of plain texts, else the file's name."""
    name = F.regexp_extract(url, "([^/]+)$", 1)
    return F.when(F.lower(name).rlike(r"\.(md|txt)$"), T.markdown_title(text, name)).otherwise(name)


def build_index(spark: SparkSession, records: DataFrame, path: str, profile: Profile, files: DataFrame | None = None, encode: Callable[[DataFrame], DataFrame] | None = None, cut=None) -> dict:
    """Records (and files) to documents, chunks and index tables under ``path``; the manifest
    is written last. encode: (chunk_id, text) to (chunk_id, embedding). Returns the counts."""
    docs = I.documents_from_records(records, profile)
    if files is not None:
        own = files.select(F.concat(F.lit("doc:"), T.content_hash("source_url")).alias("doc_id"), "source_url", F.col("source_url").alias("canonical_url"), file_titles("text", "source_url").alias("title"), F.lit("document").alias("source_type"), F.lit("manual").alias("section"), T.clean("text").alias("text"), (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("ord"))
        own = I.assess(own.withColumns({"language": F.lit(profile.own_language), "is_archived": F.lit(False), "content_hash": T.content_hash("text"), "is_duplicate": F.lit(False), "document_links": T.words_in(())}), profile)
        docs = docs.unionByName(own, allowMissingColumns=True)
    docs = docs.select("doc_id", "ord", "source_url", "canonical_url", "source_type", "title", "section", "language", "content_hash", "is_archived", "page_type", "source_facets", "quality_flags", "quality_score", "document_links", "is_duplicate", "text")
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    # the second pass: kept documents only, by address and (but for preserved facets) by signature
    kept = F.arrays_overlap("source_facets", T.words_in(profile.preserved_facets))
    keyed = docs.filter("not is_duplicate").withColumns({"a": F.xxhash64("canonical_url"), "b": F.when(~kept, F.xxhash64(T.signature("text")))})
    again = I.two_key_dedupe(keyed, "ord", "a", "b", cut)
    fit = docs.join(again.filter("not is_duplicate").select("ord"), "ord", "left_semi")
    fit = I.corpus_gate(fit, profile)
    web, other = fit.filter("source_type = 'web'"), fit.filter("source_type <> 'web'")
    chunks = I.chunk_documents(web, section=F.col("section")).unionByName(I.chunk_documents(other, section=F.col("section"), source_type="document"))
    chunks.withColumn("source", F.col("canonical_url")).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    vectors = encode(chunks.select("chunk_id", "text")) if encode else None
    S.save_index(R.postings(chunks, "chunk_id", "text", profile.stopwords), R.stats(chunks, "text", profile.stopwords), f"{path}/index", vectors=vectors)
    counts = {"doc_count": docs.count(), "chunk_count": chunks.count()}
    checksum = S.corpus_checksum(chunks.select("chunk_id", F.sha2("text", 256).alias("h")), "chunk_id", "h").first()[0]
    S.publish_manifest(spark, f"{path}/manifest", version="1", corpus_checksum=checksum, lexical_path="index/postings", dense_path="index/vectors" if encode else None, built_at=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **counts)
    return counts


@dataclass(frozen=True)
class Engine:
    """A published index. ``fast`` engines use no vectors and no reranker, ``full`` ones do."""

    spark: SparkSession
    path: str
    profile: Profile
    encode_queries: Callable[[DataFrame], DataFrame] | None = None
    reranker: Callable[[Column, Column], Column] | None = None
    lexical_rerank: bool = False

    @classmethod
    def load(cls, spark: SparkSession, path: str, profile: Profile, mode: str = "full", **plugs) -> Engine:
        """Fails if there is no manifest. mode: fast or full."""
        manifest = S.read_manifest(spark, f"{path}/manifest")
        out = cls(spark, path, profile, **plugs)
        if mode == "fast" or not manifest["dense_path"]:
            out = replace(out, encode_queries=None)
        return replace(out, reranker=None) if mode == "fast" else out

    def analysed(self, queries: DataFrame) -> DataFrame:
        return R.analysed(queries, self.profile)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Ranked hits of every query: query_id, place, chunk_id, source, text, score and the
        score's parts."""
        p, deep = self.profile, max(6 * k, 24)
        asked = self.analysed(queries.select("query_id", "query"))
        posts, totals = S.load_index(self.spark, f"{self.path}/index")
        chunks = self.spark.read.parquet(f"{self.path}/chunks")
        found = R.bm25(posts, R.query_terms(asked, F.col("tokens")), totals, "chunk_id").join(chunks.select("chunk_id", "source_type"), "chunk_id")
        score = F.col("base") + F.col("bonus") + F.when(F.col("source_type") == "web", 0.1).otherwise(0.0)
        hits = R.top_k(found.select("query_id", "chunk_id", F.round(score, 6).alias("score")), deep, "score", "chunk_id").withColumns({"stage": F.lit("lexical"), "stage_order": F.lit(0)}).drop("rank")
        if self.encode_queries:
            text = F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(F.col("query"))
            vectors = self.encode_queries(asked.select("query_id", text.alias("text")))
            dense = R.dense_search(self.spark.read.parquet(f"{self.path}/index/vectors"), vectors, deep, "chunk_id")
            hits = hits.unionByName(dense.withColumns({"stage": F.lit("dense"), "stage_order": F.lit(1)}).drop("rank"))
        meta = chunks.select("chunk_id", "doc_id", "source", "title", "section", "section_path", "page_type", "source_facets", "quality_flags", "quality_score", "is_archived")
        hits = R.combined(hits, meta, asked, p, "chunk_id")
        if self.reranker or self.lexical_rerank:
            hits = hits.join(chunks.select("chunk_id", "text"), "chunk_id")
            hits = R.rerank(hits, F.col("tokens"), F.col("text"), deep, p, "chunk_id", self.reranker).drop("text", "score").withColumnRenamed("rerank_score", "score")
        return R.best(hits, k).join(chunks.select("chunk_id", "text"), "chunk_id")

    def augmented(self, queries: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
        """The hits, and for questions for facts whose intent has boost terms one more: the first
        hit of a second search with these terms whose source the intent trusts and allows, if
        it isn't there yet."""
        p, primary = self.profile, F.get(R.intents(F.col("query"), self.profile), F.lit(0))
        asked = queries.select("query_id", "query", primary.alias("intent")).withColumn("boost", G.hints(F.col("intent"), p, "boost_terms"))
        asked = asked.filter(G.fact_sensitive(F.col("query"), p) & (F.size("boost") > 0))
        boosted = asked.select("query_id", F.concat_ws(" ", "query", F.array_join("boost", " ")).alias("query"))
        more = self.search(boosted, max(k + 2, 5)).drop("intent").join(asked.select("query_id", "intent"), "query_id")
        trusted, denied = G.hints(F.col("intent"), p, "trusted_sources"), G.hints(F.col("intent"), p, "denied_sources")
        fits = ((F.size(trusted) == 0) | G.matches_any(F.col("source"), trusted)) & ~G.matches_any(F.col("source"), denied)
        more = more.filter(fits).drop("intent")
        first = more.groupBy("query_id").agg(F.min("place").alias("place"))
        new = more.join(first, ["query_id", "place"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        last = hits.groupBy("query_id").agg(F.max("place").alias("__last"))
        new = new.join(last, "query_id", "left").withColumn("place", F.coalesce("__last", F.lit(0)) + 1).drop("__last")
        return hits.unionByName(new.select(*hits.columns))

    def evidence(self, queries: DataFrame, k: int = 5, budget: int = 900) -> DataFrame:
        """The hits that fit a word budget, with the query's grounding score."""
        chosen = R.evidence(self.search(queries, k), budget, rank="place")
        return chosen.join(R.grounding(chosen).select("query_id", "grounding_score"), "query_id")

    def answer(self, queries: DataFrame, generate: Callable[[Column, Column], Column] | None = None, words: int = 120, chars: int = 160, k: int = 5, turns: DataFrame | None = None) -> DataFrame:
        """(query_id, display, speaker, intent, coverage, grounding, fallback, mode, sources, hits).

        Hits of the search and of the second one with boost terms, less the sources that the
        intent doesn't allow; the model's reply, cleaned, checked against them and cut; the best
        sentences of the hits where it says too little; the intent's summaries where those do.

        generate: Column function of (query, prompt), the plug point for a model; the prompt holds
        the history of ``turns`` (query_id, turn, role, text) and the hits' texts. ``fallback``:
        without a reply, without evidence, or where the hits don't bear the answer out."""
        p = self.profile
        asked = self.analysed(queries.select("query_id", "query")).withColumn("intent", F.get("intents", F.lit(0)))
        hits = written(self.search(queries, k))
        hits = written(self.augmented(queries, hits, k)).drop("intent").join(asked.select("query_id", "intent"), "query_id")
        hits = M.filter_by_intent(hits, p)
        kind = "array<struct<place:int,text:string,source:string,title:string,section:string,path:array<string>,facets:array<string>,score:double>>"
        one = F.struct(F.col("place").cast("int").alias("place"), "text", "source", "title", "section", F.col("section_path").alias("path"), F.col("source_facets").alias("facets"), F.col("score").cast("double").alias("score"))
        packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).cast(kind).alias("hits"))  # a few hits a query
        rows = asked.join(packed, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind)))
        if turns is not None:
            own = M.history_prompt(turns.withColumnRenamed("query_id", "conv_id")).select(F.col("conv_id").alias("query_id"), F.col("prompt").alias("history"))
            rows = rows.join(own, "query_id", "left")
        history = F.coalesce("history", F.lit("")) if turns is not None else F.lit("")
        rows = rows.withColumns({"context": F.array_join(F.transform("hits", lambda h: h["text"]), "\n\n"), "sources": F.transform("hits", lambda h: h["source"])})
        rows = rows.withColumn("given", F.array_distinct(T.tokenize("context", p.stopwords)))
        rows = rows.withColumn("coverage", A.coverage(G.focus(F.col("tokens"), G.hints(F.col("intent"), p, "fact_tokens")), F.col("given")))
        top = F.slice("hits", 1, 3)
        shape = F.transform(top, lambda h: F.concat_ws(" ", h["source"], h["title"], h["section"], F.array_join(h["path"], " "), F.array_join(h["facets"], " "), F.substring(h["text"], 1, 600)))
        own = F.array_distinct(T.tokenize(F.array_join(shape, " "), p.stopwords))
        rows = rows.withColumn("anchored", A.anchor_support(A.anchors(T.tokenize("query", p.stopwords), p.low_signal_stems), own))
        rows = rows.withColumn("faceted", G.facet_support(F.col("facets"), F.array_distinct(F.flatten(F.transform(top, lambda h: h["facets"]))), p))
        rows = written(rows.withColumn("trusted", G.trusted(F.col("sources"), F.col("intent"), p)))

        def cleaned(df: DataFrame, column: str) -> DataFrame:
            # a column a step: a step uses its text several times
            steps = [A.sanitize_markdown, A.strip_links, A.strip_link_soup, A.dedupe_sentences]
            for step in [*steps, lambda c: A.strip_leading(c, p.leading)] if p.leading else steps:
                df = df.withColumn(column, step(F.col(column)))
            return df

        def bounded(column: str, most) -> dict[str, Column]:
            text, cut = most(F.col(column))
            return {column: text, "cut": F.col("cut") | cut}

        reply = generate(F.col("query"), M.prompt(F.col("query"), history, F.col("context"))) if generate else F.lit("")
        display, speaker = A.tagged(F.coalesce(reply, F.lit("")))
        rows = rows.withColumn("silent", F.trim(F.coalesce(reply, F.lit(""))) == "")
        rows = cleaned(rows.withColumns({"display": display, "speaker": speaker, "cut": F.lit(False)}), "display")
        policed = lambda c: A.drop_sentences(c, p.banned_sentences) if p.banned_sentences else (c, F.lit(False))
        named = lambda c: A.enforce_identity(c, p.wrong_identity, p.identity) if p.wrong_identity else (c, F.lit(False))
        rows = rows.withColumns(bounded("display", policed))
        checked, dropped = A.verified("display", F.col("given"), lambda s: T.tokenize(s, p.stopwords))
        rows = rows.withColumns({"display": checked, "cut": F.col("cut") | (dropped > 0)})
        finishing = (named, lambda c: A.limit_words(c, words), A.finish)
        for step in finishing:
            rows = rows.withColumns(bounded("display", step))
        # too little said, but there is evidence: the best sentences of the hits
        poor = A.low_information("display", T.tokenize("display", p.stopwords)) & (F.size("hits") > 0) & ((F.col("coverage") >= 0.1) | F.col("trusted"))
        pairs = F.transform("hits", lambda h: F.struct(h["source"].alias("source"), h["text"].alias("text")))
        # the plan so far is done with; the rest goes on from its rows
        rows = written(rows.withColumn("poor", poor))
        found = F.when(F.col("poor"), G.extract(pairs, F.col("tokens"), F.col("intent"), p)).otherwise(F.lit(""))
        rows = cleaned(rows.withColumn("extract", found), "extract").withColumn("extracted", F.col("extract") != "")
        rows = rows.withColumn("display", F.when(F.col("extracted"), F.col("extract")).otherwise(F.col("display")))
        for step in finishing:
            rows = rows.withColumns(bounded("display", step))
        rows = rows.withColumn("display", G.display_policy(F.col("display"), F.col("sources"), F.col("coverage"), F.col("intent"), p))
        for step in finishing[1:]:
            rows = rows.withColumns(bounded("display", step))
        rows = written(rows)
        rows = rows.withColumn("speaker", F.when(F.col("speaker") != "", F.col("speaker")).otherwise(G.speaker_sentences(F.col("display"), F.col("query"), p)))
        rows = rows.withColumn("speaker", A.dedupe_sentences(A.strip_markdown(A.strip_links("speaker"))))
        for step in (policed, named, lambda c: (A.strip_leading(c, p.leading) if p.leading else c, F.lit(False)), lambda c: (A.first_sentences(c), F.lit(False)), lambda c: (G.speaker_policy(c, F.col("display"), F.col("sources"), F.col("intent"), p), F.lit(False)), lambda c: A.limit_chars(c, chars), A.finish):
            rows = rows.withColumns(bounded("speaker", step))
        guarded = (F.size("hits") > 0) & A.grounded(F.col("trusted"), F.col("coverage"), F.col("anchored"))
        blank = F.col("display") == ""
        mean = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["score"]) / F.greatest(F.lit(1), F.size("hits"))
        share = F.when(F.size("hits") > 0, F.least("anchored", F.greatest("faceted", "coverage"))).otherwise(0.0)
        return rows.select(
            "query_id",
            F.when(blank, p.fallback).otherwise(F.col("display")).alias("display"),
            "speaker",
            "intent",
            "coverage",
            F.round(mean * F.greatest(share, F.lit(0.0)), 4).alias("grounding"),
            (blank | ~guarded | F.col("silent")).alias("fallback"),
            F.when(F.contains(F.lower("display"), F.lit(p.uncertain)) if p.uncertain else F.lit(False), "uncertain").otherwise("grounded").alias("mode"),
            "cut",
            "sources",
            F.size("hits").alias("hits"),
        )
