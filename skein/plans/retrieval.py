"""Catalogue: lexical and dense search, policy, fusion, evidence, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import ingest as I
from skein.operators import retrieval as R
from skein.plans import ingest as C
from skein.plans import sql as Q
from skein.plans.base import cut, query, table
from skein.rules import SYNTHETIC as P

LONG = "bigint"
ONE = "the thion onthwh reti"
_DOCS = f"select doc_id, {Q.tok('text')} t from documents"
_ONE = f"select 0 query_id, term, count(*) mult, 3 nq from (select unnest({Q.tok(chr(39) + ONE + chr(39))}) term) group by term"
_ITEM = f"select item_id query_id, text q, {Q.expanded(Q.tok('text'))} t from benchmark"
_ITEMS = f"select query_id, term, count(*) mult, any_value(nq) nq from (select query_id, len(list_distinct(t)) nq, unnest(t) term from ({_ITEM})) group by query_id, term"


def _docs(spark, d):
    return table(spark, d, "documents")


def _found(spark, d, queries: DataFrame, tokens) -> DataFrame:
    docs = _docs(spark, d)
    return R.bm25(R.postings(docs, "doc_id", "text", P.stopwords), R.query_terms(queries, tokens), R.stats(docs, "text", P.stopwords), "doc_id")


def _one(spark) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(ONE).alias("query"))


def _items(spark, d) -> DataFrame:
    """Benchmark items as whole queries, analysed: query_id, query, tokens, intents, facets."""
    return R.analysed(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), P)


def batch_hits(spark, d, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the benchmark's queries over the documents."""
    found = _found(spark, d, _items(spark, d), F.col("tokens"))
    return R.top_k(found.select("query_id", "doc_id", F.round(F.col("base") + F.col("bonus"), 6).alias("score")), k, "score", "doc_id")


@query(f"with {Q.bm25(_DOCS, _ONE)} select doc_id, round(base, 6) score, row_number() over (order by round(base, 6) desc, doc_id)::bigint rank from hits order by score desc, doc_id limit 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d, _one(spark), T.tokenize("query", P.stopwords))
    return R.top_k(found.withColumn("score", F.round("base", 6)), 10, "score", "doc_id").select("doc_id", "score", F.col("rank").cast(LONG).alias("rank"))


_BATCH = f"with {Q.bm25(_DOCS, _ITEMS)}, scored as (select query_id, doc_id, round(base + bonus, 6) score from hits), ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from scored)"


@query(f"{_BATCH} select query_id, doc_id, score, rank::bigint rank from ranked where rank <= 10")
def bm25_batch_topk(spark, d):
    return batch_hits(spark, d, 10).withColumn("rank", F.col("rank").cast(LONG))


@query(f"with {Q.bm25(_DOCS, _ONE)} select doc_id, round(base, 6) base, round(bonus, 6) bonus, round(base + bonus, 6) total from hits")
def bm25_overlap_bonus(spark, d):
    found = _found(spark, d, _one(spark), T.tokenize("query", P.stopwords))
    return found.select("doc_id", F.round("base", 6).alias("base"), F.round("bonus", 6).alias("bonus"), F.round(F.col("base") + F.col("bonus"), 6).alias("total"))


# --- dense ------------------------------------------------------------------------------------------


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::double[], {b}::double[])"


@query(f"select vec_id, round({_dot('e.embedding', 'q.embedding')}, 6) score from embeddings e, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) q order by score desc, vec_id limit 10")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    one = v.orderBy("vec_id").limit(1).select(F.lit(0).cast(LONG).alias("query_id"), "embedding")
    return R.dense_search(v, one, 10).select("vec_id", "score")


_DENSE = f"(select q.vec_id query_id, e.vec_id, round({_dot('e.embedding', 'q.embedding')}, 6) score from embeddings e, (select vec_id, embedding from embeddings where vec_id % 20 = 0) q where e.vec_id <> q.vec_id)"


@query(f"select * from (select *, row_number() over (partition by query_id order by score desc, vec_id)::bigint rank from {_DENSE}) where rank <= 10")
def dense_batch_topk(spark, d):
    v = table(spark, d, "embeddings")
    asks = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_search(v, asks, 10, exclude_self=True).withColumn("rank", F.col("rank").cast(LONG))


_COS = f"round({_dot('e.embedding', 'q.embedding')} / (sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('q.embedding', 'q.embedding')})), 6)"


@query(f"select vec_id, cos, case when cos >= 0.75 then 'accept' when cos < 0.6 then 'reject' else 'uncertain' end verdict from (select e.vec_id, {_COS} cos from embeddings e, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) q)")
def cosine_verify(spark, d):
    v = table(spark, d, "embeddings")
    one = F.broadcast(v.agg(F.min_by("embedding", "vec_id").alias("q")))  # one row
    cos = F.round(R.cosine(F.col("embedding"), F.col("q")), 6)
    return v.crossJoin(one).select("vec_id", cos.alias("cos"), F.when(cos >= 0.75, "accept").when(cos < 0.6, "reject").otherwise("uncertain").alias("verdict"))


# --- policy ---------------------------------------------------------------------------------------------

_PAGE_Q = f"(select item_id, text q, {Q.expanded(Q.tok('text'))} t from benchmark)"
_SECTION = f"coalesce(list_filter(string_split(regexp_extract(url, '{Q.PART}', 3), '/'), lambda s: s <> '')[1], 'home')"


def _structural_sql(tokens: str, q: str) -> str:
    own = Q.tok(f"concat_ws(' ', replace({Q.path('url')}, '/', ' '), title, {_SECTION})")
    alias = ", ".join(f"case when t = '{k}' then {Q.quoted(v)} else []::varchar[] end" for k, v in P.path_aliases.items())
    more = f"flatten(list_transform({own}, lambda t: flatten([{alias}])))"
    wanted = f"list_distinct({tokens})"
    overlap = f"case when len({wanted}) > 0 then len(list_intersect({wanted}, list_distinct(list_concat({own}, {more}))))::double / len({wanted}) else 0 end"
    numbers = f"list_distinct(regexp_extract_all({q}, '\\b(\\d+)\\b', 1))"
    by_number = f"coalesce(list_sum(list_transform({numbers}, lambda n: case when contains(lower(url), '/' || n) then 0.28::double else 0 end + case when contains(lower(title), '№' || n) or contains(lower(title), ' ' || n) then 0.18::double else 0 end)), 0)"
    return f"0.45::double * ({overlap}) + {by_number}"


@query(f"select * from (select item_id, page_id, round({_structural_sql('t', 'q')}, 6) bonus from {_PAGE_Q}, {C.PAGES_SQL}) where bonus <> 0")
def structural_bonus(spark, d):
    """The bonuses other than 0 of every item and page."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"), T.expand(T.tokenize("text", P.stopwords), P.expansions).alias("t"))
    r = C.page_records(spark, d).select("page_id", "url", "title", U.section("url").alias("section"))
    # pages join before the wider items, so that pairs are shuffled as ids
    r = R.structural_candidates(b, r, "item_id", "page_id", P).join(r, "page_id").join(b, "item_id")
    bonus = R.structural_bonus(F.col("t"), F.col("q"), F.col("url"), F.col("title"), F.col("section"), P)
    return r.select("item_id", "page_id", F.round(bonus, 6).alias("bonus")).filter("bonus <> 0")


def _facet_sql() -> str:
    out = []
    for f, r in P.facet_rules.items():
        one = "0::double"
        for rules, sign in ((r.path_bonus, "+"), (r.path_penalty, "-")):
            one += "".join(f" {sign} case when contains(lower(url), '{k}') then {v}::double else 0 end" for k, v in rules.items())
        for rules, sign in ((r.page_type_bonus, "+"), (r.page_type_penalty, "-")):
            one += "".join(f" {sign} case when pt = '{k}' then {v}::double else 0 end" for k, v in rules.items())
        for rules, sign in ((r.source_facet_bonus, "+"), (r.source_facet_penalty, "-")):
            one += "".join(f" {sign} case when list_contains(sf, '{k}') then {v}::double else 0 end" for k, v in rules.items())
        out.append(f"case when list_contains(fs, '{f}') then {one} else 0 end")
    return " + ".join(out)


_INTENT = "case when page_id % 3 = 0 then 'alpha' when page_id % 3 = 1 then 'beta' else 'gamma' end"
_FS = "case when page_id % 2 = 0 then ['motion', 'cost'] else ['place'] end"
_STALE = "case i when 'alpha' then 0.3::double else 0.08::double end"
_PREFERRED = " + ".join(f"case when i = '{n}' and {Q.has('lower(url)', x.preferred_sources)} then {x.source_bonus}::double else 0 end" for n, x in P.intents.items())
_AWAY = " + ".join(f"case when i = '{n}' and not {Q.has('lower(url)', x.preferred_sources)} then 0.18::double else 0 end" for n, x in P.intents.items())


@query(f"""with p as (select *, {_INTENT} i, {_FS} fs, {C.TYPE_SQL} pt, {C.FACETS_SQL} sf, (page_id % 10)::double / 10 quality, page_id % 7 = 0 archived from {C.PAGES_SQL}),
s as (select page_id, round(case when archived then {_STALE} else 0 end, 6) freshness_penalty, round({_AWAY} + greatest(0, 0.65::double - quality) * 0.4::double, 6) source_penalty,
 round(case when contains(lower(url), '{P.domain}') then 0.08::double else 0 end + {_PREFERRED}, 6) source_bonus, round({_facet_sql()}, 6) facet_bonus from p)
select *, round(source_bonus + facet_bonus - freshness_penalty - source_penalty, 6) policy_score from s""")
def source_policy(spark, d):
    r = C.page_records(spark, d)
    i = F.when(F.col("page_id") % 3 == 0, "alpha").when(F.col("page_id") % 3 == 1, "beta").otherwise("gamma")
    fs = F.when(F.col("page_id") % 2 == 0, T.words_in(("motion", "cost"))).otherwise(T.words_in(("place",)))
    c = [F.col(x) for x in ("url", "title", "text")]
    r = r.withColumns({
        "page_type": I.page_type(*c, F.col("source_type"), P), "source_facets": I.source_facets(*c, P), "intents": F.array(i), "facets": fs, "is_archived": F.col("page_id") % 7 == 0,
        "quality_score": (F.col("page_id") % 10).cast("double") / 10, "quality_flags": T.words_in(()), "source": F.col("url"), "query": F.lit(""), "tokens": T.words_in(()), "section": F.lit(""),
    })
    return R.policy(r, P).select("page_id", "freshness_penalty", "source_penalty", "source_bonus", "facet_bonus", "policy_score")


def _intents_sql(col: str) -> str:
    low = f"lower({col})"
    rows = ", ".join(f"case when {Q.count(low, i.query_hints)} > 0 then {{'n': -({Q.count(low, i.query_hints)}), 'p': -{i.priority}, 'name': '{n}'}} end" for n, i in P.intents.items())
    names = f"list_transform(list_sort(list_filter([{rows}], lambda x: x is not null)), lambda x: x.name)"
    return f"case when len({names}) > 0 then array_to_string({names}, ',') else 'general' end"


def _facets_query_sql(source: str = "(select conv_id, turn, text from conversations where role = 'user')", keys: str = "conv_id, turn") -> str:
    starts = lambda stems: "len(list_filter(e, lambda t: " + " or ".join(f"starts_with(t, '{s}')" for s in stems) + ")) > 0"
    held = "list_filter([" + ", ".join(f"case when {starts(s)} or {Q.has('lower(text)', s)} then '{f}' end" for f, s in P.facet_stems.items()) + "], lambda x: x is not null)"
    step = f"select {keys}, e, {held} h0 from (select {keys}, text, {Q.expanded(Q.tok('text'))} e from {source})"
    n = 0
    for f, i in P.facet_implies:
        step = f"select *, case when list_contains(h{n}, '{f}') then list_distinct(list_append(h{n}, '{i}')) else h{n} end h{n + 1} from ({step})"
        n += 1
    for stays, goes, stems in P.facet_excludes:
        step = f"select *, case when list_contains(h{n}, '{stays}') and list_contains(h{n}, '{goes}') and {starts(stems)} then list_filter(h{n}, lambda x: x <> '{goes}') else h{n} end h{n + 1} from ({step})"
        n += 1
    return f"select {keys}, array_to_string(list_sort(list_distinct(h{n})), ',') facets from ({step})"


# --- fusion ------------------------------------------------------------------------------------------------

_LEX = "(select query_id, doc_id, score from ranked where rank <= 30)"
#: The dense stage of a benchmark query: the vector with the query's number.
_DEN = f"(select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) r from (select q.vec_id query_id, e.vec_id doc_id, round({_dot('e.embedding', 'q.embedding')}, 6) score from embeddings e, (select v.vec_id, v.embedding from embeddings v join (select item_id from benchmark) b on v.vec_id = b.item_id) q)) where r <= 30)"


def stages(spark, d) -> DataFrame:
    """Lexical and dense candidates of the benchmark's queries (30 each)."""
    v = table(spark, d, "embeddings")
    asks = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    lexical = batch_hits(spark, d, 30).select("query_id", "doc_id", "score", F.lit("lexical").alias("stage"), F.lit(0).alias("stage_order"))
    dense = R.dense_search(v, asks, 30).select("query_id", F.col("vec_id").alias("doc_id"), "score", F.lit("dense").alias("stage"), F.lit(1).alias("stage_order"))
    return lexical.unionByName(dense)


_NORM = f"""n as (select query_id, doc_id, stage, so, round(score / case when m > 0 then m else 1 end, 6) score from (select *, max(score) over (partition by query_id, stage) m from (select query_id, doc_id, score, 'lexical' stage, 0 so from {_LEX} union all select query_id, doc_id, score, 'dense', 1 from {_DEN})))"""


@query(f"{_BATCH}, {_NORM} select query_id, doc_id, stage, score from n")
def stage_normalize(spark, d):
    return R.normalize_stages(stages(spark, d)).select("query_id", "doc_id", "stage", "score")


#: Documents as hits: an address made of their language and source, and what follows from it.
_URL = "'https://' || case when lang = 'en' then 'www' else 'blog' end || '.example.net/' || lang || '/' || source"
_META = f"(select doc_id, text, source url, 'the ' || lang title, doc_id % 7 = 0 archived, case when n_chars < 500 then 0.5::double else 0.9::double end quality, n_chars < 200 low from (select doc_id, text, lang, n_chars, {_URL} source from documents))"


def doc_meta(spark, d) -> DataFrame:
    """The columns that the policy reads of a hit."""
    url = F.concat(F.lit("https://"), F.when(F.col("lang") == "en", "www").otherwise("blog"), F.lit(".example.net/"), F.col("lang"), F.lit("/"), F.col("source"))
    r = _docs(spark, d).select("doc_id", "text", "n_chars", url.alias("source"), F.concat(F.lit("the "), F.col("lang")).alias("title"))
    c = [F.col(x) for x in ("source", "title", "text")]
    r = r.withColumns({
        "section": U.section("source"), "page_type": I.page_type(*c, F.lit("web"), P), "source_facets": I.source_facets(*c, P), "is_archived": F.col("doc_id") % 7 == 0,
        "quality_score": F.when(F.col("n_chars") < 500, 0.5).otherwise(0.9), "quality_flags": F.when(F.col("n_chars") < 200, F.array(F.lit("is_low_signal"))).otherwise(T.words_in(())),
    })
    return r.drop("text", "n_chars")


def _policy_sql() -> str:
    """The policy of a hit: columns ints, fs, t, q of its query; url, title, text, pt, sf, quality,
    archived, low of the hit."""
    per = lambda value: " + ".join(f"case when list_contains(ints, '{n}') then {value(n, i)} else 0::double end" for n, i in P.intents.items())
    stale = "greatest(0.08::double, " + ", ".join(f"case when list_contains(ints, '{n}') then {i.stale_penalty}::double else 0::double end" for n, i in P.intents.items()) + ")"
    away = per(lambda n, i: f"case when not {Q.has('lower(url)', i.preferred_sources)} then 0.18::double else 0 end")
    prefers = per(lambda n, i: f"case when {Q.has('lower(url)', i.preferred_sources)} then {i.source_bonus}::double else 0 end")
    parts = [
        f"- round(case when archived then {stale} else 0 end, 6)",
        f"- round(case when low then 0.45::double else 0 end + {away} + greatest(0, 0.65::double - quality) * 0.4::double, 6)",
        f"+ round(case when contains(lower(url), '{P.domain}') then 0.08::double else 0 end + {prefers}, 6)",
        f"+ round({_facet_sql()}, 6)",
        f"+ round({_structural_sql('t', 'q')}, 6)",
    ]
    return f"round({' '.join(parts)}, 6)"


def _asked_sql() -> str:
    return f"(select query_id, q, t, string_split({_intents_sql('q')}, ',') ints, case when facets = '' then []::varchar[] else string_split(facets, ',') end fs from ({_ITEM}) join ({_facets_query_sql('(select item_id k, text from benchmark)', 'k')}) on query_id = k)"


def stage_fusion(spark, d) -> DataFrame:
    """The benchmark's queries through both stages, the policy and fusion, as the engine does."""
    return R.combined(stages(spark, d), doc_meta(spark, d), _items(spark, d), P).withColumnRenamed("score", "adjusted")


def searched(spark, d, k: int = 5) -> DataFrame:
    """Fused, diversified, cut to k, with texts."""
    return R.best(stage_fusion(spark, d), k).join(_docs(spark, d).select("doc_id", "text"), "doc_id")


_FUSED = f"""{_NORM}, asked as {_asked_sql()}, meta as (select *, {C.TYPE_SQL} pt, {C.FACETS_SQL} sf from {_META}),
a as (select query_id, doc_id, stage, so, url source, text, ints, t, round(score + {_policy_sql()}, 6) adjusted from n join meta using (doc_id) join asked using (query_id)),
f as (select *, row_number() over (partition by query_id order by adjusted desc, so, doc_id) rank from (select *, row_number() over (partition by query_id, doc_id order by adjusted desc, so) k from a) where k = 1)"""


@query(f"{_BATCH}, {_FUSED} select query_id, doc_id, stage, adjusted, rank::bigint rank from f")
def hybrid_fuse(spark, d):
    return stage_fusion(spark, d).select("query_id", "doc_id", "stage", "adjusted", F.col("rank").cast(LONG).alias("rank"))


_DIVERSE = "v as (select *, row_number() over (partition by query_id order by (k2 > 2), rank) place from (select *, row_number() over (partition by query_id, source order by rank) k2 from f))"


@query(f"{_BATCH}, {_FUSED}, {_DIVERSE} select query_id, doc_id, source, place::bigint place from v where place <= 10")
def diversify_sources(spark, d):
    return R.diversify(stage_fusion(spark, d), 10).select("query_id", "doc_id", "source", F.col("place").cast(LONG).alias("place"))


@query(f"""{_BATCH}, {_FUSED}, w as (select query_id, doc_id, round(len(list_intersect(list_distinct(t), list_distinct({Q.tok('text')})))::double / greatest(1, len(list_distinct(t))) + tanh(adjusted), 6) s from f)
select query_id, doc_id, s rerank_score, r::bigint rank from (select *, row_number() over (partition by query_id order by s desc, doc_id) r from w) where r <= 10""")
def lexical_rerank(spark, d):
    # texts join after the cut to candidates
    hits = stage_fusion(spark, d).withColumnRenamed("adjusted", "score").join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return R.rerank(hits, F.col("tokens"), F.col("text"), 10, P).select("query_id", "doc_id", "rerank_score", F.col("rank").cast(LONG).alias("rank"))


_WORDS = "greatest(1, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')))"
_CHOSEN = f"c as (select * from (select *, sum({_WORDS}) over (partition by query_id order by place) used, {_WORDS} words from v where place <= 5) where used <= 900 or used = words)"


@query(f"{_BATCH}, {_FUSED}, {_DIVERSE}, {_CHOSEN} select query_id, doc_id, words::bigint words, used::bigint used from c")
def evidence_budget(spark, d):
    return R.evidence(searched(spark, d), rank="place").select("query_id", "doc_id", F.col("words").cast(LONG).alias("words"), F.col("used").cast(LONG).alias("used"))


@query(f"{_BATCH}, {_FUSED}, {_DIVERSE}, {_CHOSEN}, g as (select query_id, round(round(avg(greatest(adjusted, 0)), 9)::decimal(18, 9), 4)::double grounding_score from c group by query_id) select query_id, place::bigint place, doc_id, stage, source, adjusted score, sha256(text) digest, grounding_score from c join g using (query_id)")
def hybrid_search(spark, d):
    # written once: the hits go into the result and into their query's grounding
    chosen = cut(R.evidence(searched(spark, d), rank="place"))
    g = R.grounding(chosen, "adjusted").select("query_id", "grounding_score")
    return chosen.join(g, "query_id").select("query_id", F.col("place").cast(LONG).alias("place"), "doc_id", "stage", "source", F.col("adjusted").alias("score"), F.sha2("text", 256).alias("digest"), "grounding_score")


@query(f"""{_BATCH}, gold as (select item_id query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
f as (select b.item_id query_id, min(rank) r from benchmark b left join (select query_id, rank from ranked join gold using (query_id, doc_id) where rank <= 5) on query_id = item_id group by b.item_id)
select count(*)::bigint n_queries, round(avg(coalesce((r <= 5)::int, 0)), 4) success_at_k, round(avg(coalesce((r <= 1)::int, 0)), 4) top1, round(avg(coalesce((r <= 3)::int, 0)), 4) top3, round(avg(coalesce(round(1::double / r, 4), 0)), 4) mrr from f""")
def retrieval_eval(spark, d):
    return R.evaluate(batch_hits(spark, d, 5), gold(spark, d))


def gold(spark, d) -> DataFrame:
    """(query_id, doc_id) of documents that hold a query's whole text; a null doc_id for each
    query. Pairs of words find the candidates, so it is an equi join but for items of fewer
    than four words."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    shifted = lambda t: F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t) - 1))
    pairs = lambda c: T.let(words(c), lambda t: F.array_distinct(F.zip_with(t, shifted(t), lambda x, y: F.xxhash64(x, F.lit(" "), y))))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    n = F.size(words(F.col("item")))
    # the second and third of four words are whole in any document that holds the item
    probe = b.filter(n >= 4).withColumn("s", F.xxhash64(F.get(words(F.col("item")), F.lit(1)), F.lit(" "), F.get(words(F.col("item")), F.lit(2))))
    docs = _docs(spark, d).select("doc_id", "text")
    found = docs.select("doc_id", F.explode(pairs(F.col("text"))).alias("s")).join(probe, "s").select("query_id", "doc_id", "item")
    hits = found.join(docs, "doc_id").filter(F.contains("text", "item")).select("query_id", "doc_id")
    short = docs.join(b.filter((n > 0) & (n < 4)), F.contains("text", "item")).select("query_id", "doc_id")
    hits = hits.unionByName(short).distinct()
    return hits.unionByName(b.select("query_id", F.lit(None).cast(LONG).alias("doc_id")))


# --- queries -------------------------------------------------------------------------------------------------


@query(f"select conv_id, turn, {_intents_sql('text')} intents from conversations where role = 'user'")
def intent_detect(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(R.intents(F.col("text"), P), ",").alias("intents"))


@query(_facets_query_sql())
def facet_detect(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(R.facets(F.col("text"), P), ",").alias("facets"))
