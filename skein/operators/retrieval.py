"""Lexical and dense search over many queries at once, fusion, evidence, evaluation.

Queries are a table (query_id, ...); every step is keyed by it, so one plan answers all."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.rules import Profile

# fixed values: BM25's constants
K1, B = 1.5, 0.75
# fixed values: weights and limits of the policy
OVERLAP_WEIGHT, NUMBER_IN_ADDRESS, NUMBER_IN_TITLE = 0.45, 0.28, 0.18
STALE, HOME, AWAY = 0.08, 0.08, 0.18
LOW_SIGNAL, BOILERPLATE, LOW_PRIORITY, FAQ, GREETING, FAQ_PAGE = 0.45, 0.18, 0.16, 0.34, 0.16, 0.12
QUALITY, QUALITY_WEIGHT, RERANK_WEIGHT = 0.65, 0.4, 0.35
#: Bytes of query vectors that are broadcast at once; more queries go in blocks.
QUERY_BYTES = 32 << 20


# --- lexical -----------------------------------------------------------------------------


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>>: the distinct tokens of a row and how often each occurs, counted
    within the row."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        ends = lambda at: F.transform(at, lambda p, j: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(t)) - p).alias("tf")))
        return F.when(F.size(t) > 0, T.let(starts, ends))

    return T.let(F.array_sort(tokens), runs)


def postings(docs: DataFrame, key: str, text: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """(term, key, tf, dl): a row per document and distinct term. Counting is within the row,
    so the only shuffles are those of document frequencies and of searches."""
    rows = docs.select(key, T.let(T.tokenize(text, stopwords), lambda t: F.struct(F.size(t).alias("dl"), term_counts(t).alias("terms"))).alias("__t"))
    # outer, so that no filter on the array's size computes it twice
    rows = rows.select(key, F.col("__t.dl").alias("dl"), F.explode_outer("__t.terms").alias("__x"))
    return rows.select(F.col("__x.term").alias("term"), key, F.col("__x.tf").cast("long").alias("tf"), "dl").filter("term is not null")


def stats(docs: DataFrame, text: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """One row: n documents and their average token count (1 at least)."""
    size = F.size(T.tokenize(text, stopwords))
    return docs.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg(size), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def frequencies(posts: DataFrame) -> DataFrame:
    """(term, df)"""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, term, multiplicity, nq): the bag of a query's tokens; nq: its distinct ones."""
    rows = queries.select("query_id", F.size(F.array_distinct(tokens)).alias("nq"), F.explode(tokens).alias("term"))
    return rows.groupBy("query_id", "term", "nq").agg(F.count("*").alias("mult"))


def bm25(posts: DataFrame, terms: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(query_id, key, base, bonus): BM25 over the queries' bags of terms, and the share of
    a query's distinct terms that the document has.

    Only postings of asked terms take part: they are filtered by the join first, and their
    document frequencies come from the same rows."""
    asked = posts.join(terms.select("term").distinct(), "term", "left_semi")
    rows = asked.join(frequencies(asked), "term").join(terms, "term").crossJoin(F.broadcast(totals))  # totals: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.col("avgdl")))
    found = rows.groupBy("query_id", key).agg(F.sum(F.col("mult") * idf * share).alias("base"), (F.count("*") / F.first("nq")).alias("bonus"))
    return found.filter("base > 0")


def top_k(hits: DataFrame, k: int, score: str, tie: str, by: str = "query_id") -> DataFrame:
    """Adds ``rank`` and keeps the first k of each query; ties go by ``tie`` ascending."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, queries: DataFrame, k: int, profile: Profile, key: str = "doc_id", text: str = "text", query: str = "query", expand: bool = True, web_bonus: Column | None = None) -> DataFrame:
    """(query_id, key, score, rank) by BM25 + overlap (+ 0.1 where ``web_bonus`` holds)."""
    tokens = T.tokenize(query, profile.stopwords)
    tokens = T.expand(tokens, profile.expansions) if expand else tokens
    found = bm25(postings(docs, key, text, profile.stopwords), query_terms(queries, tokens), stats(docs, text, profile.stopwords), key)
    score = F.col("base") + F.col("bonus")
    if web_bonus is not None:
        found = found.join(docs.select(key, web_bonus.alias("__web")), key)
        score = score + F.when(F.col("__web"), 0.1).otherwise(0.0)
    return top_k(found.select("query_id", key, F.round(score, 6).alias("score")), k, "score", key)


# --- dense ---------------------------------------------------------------------------------


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, key, score, rank): exact inner products in double precision.

    The queries are a stated set, much smaller than the vectors: they go out in blocks of
    ``QUERY_BYTES`` and each block meets all vectors in matrix products, so work is queries
    times vectors. A batch of vectors returns k rows a query (and ties of the last)."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id long, {key} {kind}, score double"
    out = spark.createDataFrame([], schema)
    block, size = [], 0

    def scan(ids, matrix):
        def run(batches):
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(key).to_pylist(), batch.column(vector).to_pylist()) if v is not None and len(v) == matrix.shape[1]]
                if not rows:
                    continue
                names = np.array([i for i, _ in rows])
                scores = np.round(matrix @ np.array([v for _, v in rows], np.float64).T, 6)
                if exclude_self:
                    scores[ids[:, None] == names[None, :]] = -np.inf
                n = min(k, len(rows))
                # what reaches the n-th best score; ties are cut after all batches have met
                least = np.partition(scores, len(rows) - n, axis=1)[:, len(rows) - n]
                q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(names[c]), pa.array(scores[q, c])], names=["query_id", key, "score"])

        return run

    def put(out):
        ids, matrix = np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64)
        return out.unionByName(vectors.select(key, vector).mapInArrow(scan(ids, matrix), schema))

    for row in queries.select("query_id", vector).filter(F.col(vector).isNotNull()).orderBy("query_id").toLocalIterator():
        if block and (size + 8 * len(row[1]) > QUERY_BYTES or len(row[1]) != len(block[0][1])):
            out, block, size = put(out), [], 0
        block.append((row[0], row[1]))
        size += 8 * len(row[1])
    if block:
        out = put(out)
    return top_k(out, k, "score", key)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm product is next to nothing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-8, 0.0).otherwise(dot(a, b) / norm)


# --- queries: tokens, intents and facets ---------------------------------------------------------------


def analysed(queries: DataFrame, profile: Profile) -> DataFrame:
    """Adds tokens (expanded), intents and facets to (query_id, query); once a query."""
    q = F.col("query")
    return queries.withColumns({"tokens": T.expand(T.tokenize(q, profile.stopwords), profile.expansions), "intents": intents(q, profile), "facets": facets(q, profile)})


def intents(text: Column, profile: Profile) -> Column:
    """Intents by number of hints found, then priority, then name; ``general`` if none."""
    low = F.lower(text)
    scored = [F.when(T.count_markers(low, i.query_hints) > 0, F.struct((-T.count_markers(low, i.query_hints)).alias("n"), F.lit(-i.priority).alias("p"), F.lit(name).alias("name"))) for name, i in profile.intents.items()]
    names = F.transform(F.array_sort(F.array_compact(F.array(*scored))), lambda x: x["name"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("general")))


def facets(text: Column, profile: Profile) -> Column:
    """Sorted facets whose stems start a token (expanded) or occur in the text, with what they
    imply and without what they exclude."""
    low, tokens = F.lower(text), T.expand(T.tokenize(text, profile.stopwords), profile.expansions)
    starts = lambda stems: F.exists(tokens, lambda t: F.greatest(*[t.startswith(s) for s in stems], F.lit(False)))
    held = F.array_compact(F.array(*[F.when(starts(stems) | T.contains_any(low, stems), f) for f, stems in profile.facet_stems.items()]))
    for facet, implied in profile.facet_implies:
        held = F.when(F.array_contains(held, facet), F.array_union(held, F.array(F.lit(implied)))).otherwise(held)
    for stays, goes, stems in profile.facet_excludes:
        both = F.array_contains(held, stays) & F.array_contains(held, goes) & starts(stems)
        held = F.when(both, F.array_except(held, F.array(F.lit(goes)))).otherwise(held)
    return F.array_sort(F.array_distinct(held))


# --- scoring of hits ------------------------------------------------------------------------------


def structural_tokens(source: Column, title: Column, section: Column, profile: Profile) -> Column:
    """Tokens of address, title and section, with their aliases."""
    own = T.tokenize(F.concat_ws(" ", F.replace(U.path(source), F.lit("/"), F.lit(" ")), title, section), profile.stopwords)
    more = F.flatten(F.transform(own, lambda t: F.flatten(F.array(T.words_in(()), *[F.when(t == k, T.words_in(v)).otherwise(T.words_in(())) for k, v in profile.path_aliases.items()]))))
    return F.concat(own, more)


def query_numbers(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?<![\w])(\d+)(?![\w])"), 1))


def structural_candidates(items: DataFrame, pages: DataFrame, item: str, page: str, profile: Profile) -> DataFrame:
    """The pairs (item, page) whose structural bonus isn't 0, by an equi join on tokens and on
    the starts of the numbers in address and title. items: q, t; pages: url, title, section."""
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    starts = lambda c, after: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(after + r"(\d+)"), 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, F.lit(1), i))))
    url, title = F.col("url"), F.col("title")
    held = [named("t", structural_tokens(url, title, F.col("section"), profile)), named("n", starts(url, "/")), named("n", starts(title, "[№ ]"))]
    wanted = [named("t", F.col("t")), named("n", query_numbers(F.col("q")))]
    keys = lambda parts: F.explode(F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))).alias("key")
    return items.select(item, keys(wanted)).join(pages.select(page, keys(held)), "key").select(item, page).distinct()


def structural_bonus(tokens: Column, query: Column, source: Column, title: Column, section: Column, profile: Profile) -> Column:
    """0.45 times the share of query tokens in address, title and section (with aliases), and
    0.28 and 0.18 for each of the query's numbers in address and title."""
    wanted = F.array_distinct(tokens)
    overlap = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, structural_tokens(source, title, section, profile))) / F.size(wanted)).otherwise(0.0)
    numbers = query_numbers(query)
    low, head = F.lower(source), F.lower(title)
    by_number = F.aggregate(numbers, F.lit(0.0), lambda a, n: a + F.when(F.contains(low, F.concat(F.lit("/"), n)), NUMBER_IN_ADDRESS).otherwise(0.0) + F.when(F.contains(head, F.concat(F.lit("№"), n)) | F.contains(head, F.concat(F.lit(" "), n)), NUMBER_IN_TITLE).otherwise(0.0))
    return F.coalesce(OVERLAP_WEIGHT * overlap, F.lit(0.0)) + by_number


def _per_intent(held: Column, profile: Profile, value) -> Column:
    return sum((F.when(F.array_contains(held, name), value(name, i)).otherwise(0.0) for name, i in profile.intents.items()), F.lit(0.0))


def freshness_penalty(is_archived: Column, held: Column, profile: Profile) -> Column:
    """For archived hits: the largest of what the query's intents set, 0.08 at least."""
    worst = F.greatest(F.lit(STALE), *[F.when(F.array_contains(held, n), i.stale_penalty).otherwise(0.0) for n, i in profile.intents.items()], F.lit(0.0))
    return F.when(is_archived, worst).otherwise(0.0)


def source_bonus(source: Column, held: Column, profile: Profile) -> Column:
    low = F.lower(source)
    home = F.when(F.contains(low, F.lit(profile.domain)), HOME).otherwise(0.0)
    return home + _per_intent(held, profile, lambda n, i: F.when(T.contains_any(low, i.preferred_sources), i.source_bonus).otherwise(0.0))


def facet_bonus(source: Column, page_type: Column, source_facets: Column, held: Column, profile: Profile) -> Column:
    low = F.lower(source)
    out = F.lit(0.0)
    for facet, r in profile.facet_rules.items():
        one = F.lit(0.0)
        for rules, sign in ((r.path_bonus, 1), (r.path_penalty, -1)):
            for k, v in rules.items():
                one = one + F.when(F.contains(low, F.lit(k)), sign * v).otherwise(0.0)
        for rules, sign in ((r.page_type_bonus, 1), (r.page_type_penalty, -1)):
            for k, v in rules.items():
                one = one + F.when(page_type == k, sign * v).otherwise(0.0)
        for rules, sign in ((r.source_facet_bonus, 1), (r.source_facet_penalty, -1)):
            for k, v in rules.items():
                one = one + F.when(F.array_contains(source_facets, k), sign * v).otherwise(0.0)
        out = out + F.when(F.array_contains(held, facet), one).otherwise(0.0)
    return out


def source_penalty(source: Column, page_type: Column, flags: Column, quality: Column, held: Column, profile: Profile) -> Column:
    low = F.lower(source)
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    faq = F.contains(low, F.lit("/faq"))
    fixed = on(F.array_contains(flags, "is_low_signal"), LOW_SIGNAL) + on(F.array_contains(flags, "is_boilerplate_heavy"), BOILERPLATE) + on(F.array_contains(flags, "is_low_priority_source"), LOW_PRIORITY)
    fixed = fixed + on(faq | F.contains(low, F.lit("/sitemap")), FAQ) + on(F.contains(low, F.lit("/greeting")), GREETING) + on(page_type == "faq", FAQ_PAGE)
    strict = F.greatest(F.lit(0.0), *[F.when(F.array_contains(held, n) & faq, i.faq_penalty).otherwise(0.0) for n, i in profile.intents.items()], F.lit(0.0))
    away = _per_intent(held, profile, lambda n, i: F.when(F.lit(bool(i.preferred_sources)) & ~T.contains_any(low, i.preferred_sources), AWAY).otherwise(0.0))
    return fixed + strict + away + F.greatest(F.lit(0.0), F.lit(QUALITY) - quality) * QUALITY_WEIGHT


def policy(hits: DataFrame, profile: Profile) -> DataFrame:
    """Adds the five components and ``policy_score``. hits: query, tokens, intents, facets,
    source, title, section, page_type, source_facets, quality_flags, quality_score, is_archived."""
    c = F.col
    out = hits.withColumns({
        "freshness_penalty": F.round(freshness_penalty(c("is_archived"), c("intents"), profile), 6),
        "source_penalty": F.round(source_penalty(c("source"), c("page_type"), c("quality_flags"), c("quality_score"), c("intents"), profile), 6),
        "source_bonus": F.round(source_bonus(c("source"), c("intents"), profile), 6),
        "facet_bonus": F.round(facet_bonus(c("source"), c("page_type"), c("source_facets"), c("facets"), profile), 6),
        "structural_bonus": F.round(structural_bonus(c("tokens"), c("query"), c("source"), c("title"), c("section"), profile), 6),
    })
    return out.withColumn("policy_score", F.round(-c("freshness_penalty") - c("source_penalty") + c("source_bonus") + c("facet_bonus") + c("structural_bonus"), 6))


def normalize_stages(hits: DataFrame) -> DataFrame:
    """Scores divided by the largest of their query and stage (1 if that isn't positive)."""
    most = F.max("score").over(Window.partitionBy("query_id", "stage"))
    return hits.withColumn("score", F.round(F.col("score") / F.when(most > 0, most).otherwise(1.0), 6))


def fuse(hits: DataFrame, key: str = "doc_id", normalized: bool = False) -> DataFrame:
    """The best of each hit's stages (the first of equals), ranked. hits: query_id, key, stage,
    stage_order, score, policy_score."""
    scored = (hits if normalized else normalize_stages(hits)).withColumn("adjusted", F.round(F.col("score") + F.col("policy_score"), 6))
    first = Window.partitionBy("query_id", key).orderBy(F.desc("adjusted"), "stage_order")
    best = scored.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    rank = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "stage_order", key)
    return best.withColumn("rank", F.row_number().over(rank))


def combined(hits: DataFrame, meta: DataFrame, asked: DataFrame, profile: Profile, key: str = "doc_id") -> DataFrame:
    """Stages' hits (query_id, key, score, stage, stage_order) under the policy, fused and
    ranked. meta: the hits' columns that the policy reads; asked: analysed queries."""
    # stages are normalised before hits that the corpus doesn't have drop out
    known = normalize_stages(hits).join(meta, key).join(asked, "query_id")
    return fuse(policy(known, profile), key, normalized=True).withColumnRenamed("score", "semantic_score").withColumnRenamed("adjusted", "score")


def best(hits: DataFrame, k: int, source: str = "source") -> DataFrame:
    """The first k after the first max(2k, 8) are made diverse."""
    return diversify(hits, max(2 * k, 8), source).filter(F.col("place") <= k)


def diversify(hits: DataFrame, k: int, source: str = "source", most: int = 2) -> DataFrame:
    """At most ``most`` hits a source in order of rank, then the others, k in all."""
    nth = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    w = Window.partitionBy("query_id").orderBy(F.col("__n") > most, "rank")
    return hits.withColumn("__n", nth).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("__n")


def rerank(hits: DataFrame, tokens: Column, text: Column, k: int, profile: Profile, key: str = "doc_id", model=None) -> DataFrame:
    """Reorders by a model's score + 0.35 of the score, or without one by token overlap +
    tanh(score). model: Column function of (query, text)."""
    wanted = F.array_distinct(tokens)
    overlap = F.size(F.array_intersect(wanted, T.tokenize(text, profile.stopwords))) / F.greatest(F.lit(1), F.size(wanted))
    new = overlap + F.tanh("score") if model is None else model(F.col("query"), text) + RERANK_WEIGHT * F.greatest("score", F.lit(0.0))
    return top_k(hits.withColumn("rerank_score", F.round(new, 6)).drop("rank"), k, "rerank_score", key)


def evidence(hits: DataFrame, budget: int = 900, text: str = "text", rank: str = "rank") -> DataFrame:
    """The hits in order of rank whose words fit the budget; the first always does."""
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")))
    w = Window.partitionBy("query_id").orderBy(rank)
    out = hits.withColumn("words", words).withColumn("used", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter((F.col("used") <= budget) | (F.col("used") == F.col("words")))


def grounding(chosen: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, hits, grounding_score)"""
    return chosen.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.avg(F.greatest(F.col(score), F.lit(0.0))), 4).alias("grounding_score"))


def evaluate(ranked: DataFrame, gold: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """One row: queries, success at k (any hit), top1, top3 and mean reciprocal rank.
    gold: (query_id, key) pairs and every query with a null key at least."""
    first = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = gold.select("query_id").distinct().join(first, "query_id", "left")
    share = lambda n: F.round(F.avg(F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))), 4)
    return rows.agg(F.count("*").alias("n_queries"), share(k).alias("success_at_k"), share(1).alias("top1"), share(3).alias("top3"), F.round(F.avg(F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0))), 4).alias("mrr"))
