"""Catalogue: answer policy, trust, spoken sentences, history, control events, records and
indexes written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import policy as G
from skein.functions import speech as V
from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import retrieval as R
from skein.operators import sessions as S
from skein.plans import answers as W
from skein.plans import ingest as C
from skein.plans import retrieval as B
from skein.plans import sql as Q
from skein.plans.base import query, table
from skein.rules import SYNTHETIC as P
from skein.sources import records as IO
from skein.sources.shared import shared_dir
from skein.streaming import voice

LONG = "bigint"
_INTENT = "case conv_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end"
#: An address for each turn, so that trust has something to go by.
_SOURCE = "'https://www.example.' || case when turn % 4 = 0 then 'net' else 'com' end || '/x'"


def _columns() -> tuple:
    n = F.col("conv_id") % 3
    intent = F.when(n == 0, "alpha").when(n == 1, "beta").otherwise("gamma")
    return intent, F.concat(F.lit("https://www.example."), F.when(F.col("turn") % 4 == 0, "net").otherwise("com"), F.lit("/x"))


def _trusted_sql(url: str) -> str:
    return W._HAS.format(marks=f"({W._rule_sql('intent', 'trusted_sources')})", text=url)


def _one_of(values: dict[str, str], default: str) -> str:
    return "case intent " + " ".join(f"when '{n}' then {v}" for n, v in values.items()) + f" else {default} end"


@query(f"select page_id, {_trusted_sql('url')} trusted from (select page_id, url, {B._INTENT} intent from pages)")
def trusted_sources(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 3
    intent = F.when(n == 0, "alpha").when(n == 1, "beta").otherwise("gamma")
    return table(spark, d, "pages").select("page_id", G.trusted(F.array("url"), intent, P).alias("trusted"))


_LOW = "(trim({x}) = '' or regexp_matches(trim({x}), '^\\s*(\\d+[.)]?|[-*•])\\s*$') or len({t}) < 4)"
_TEXT = lambda v: "'" + v.replace("'", "''") + "'"
_DISPLAY = {n: _TEXT(i.display_summary) for n, i in P.intents.items()}
_SPEAKER = {n: _TEXT(i.speaker_summary) for n, i in P.intents.items()}
_KEEPS = {k: {n: f"regexp_matches(lower(a), '{getattr(i, k)}')" if getattr(i, k) else "false" for n, i in P.intents.items()} for k in ("display_keeps", "speaker_keeps")}
_FOCUS = f"(case when len(list_intersect(list_distinct({Q.tok('q')}), {W._rule_sql('intent', 'fact_tokens')})) > 0 then list_intersect(list_distinct({Q.tok('q')}), {W._rule_sql('intent', 'fact_tokens')}) else list_distinct({Q.tok('q')}) end)"
_ANSWERS = f"(select conv_id, turn, q, a, {_INTENT} intent, {_SOURCE} url, {Q.tok('a')} t from {W._PAIRS} where a is not null)"


@query(f"""select conv_id, turn, sha256(case when s <> '' and not {_one_of(_KEEPS['display_keeps'], 'false')} and (menu or weak or {_LOW.format(x='a', t='t')} or (len(t) > 36 and {_trusted_sql('url')})) then s else a end) digest
from (select *, {_one_of(_DISPLAY, "''")} s, len(t) > 20 and len(regexp_extract_all(a, '[.!?]')) <= 1 and {Q.has('lower(a)', P.menu_markers)} menu,
 case when len(f) = 0 then 0 else round(len(list_intersect(f, list_distinct(t)))::double / len(f), 4) end < {_one_of({n: f"{i.min_evidence}::double" for n, i in P.intents.items()}, '0.35::double')} and len(list_intersect(list_distinct(t), {W._rule_sql('intent', 'fact_tokens')})) < {_one_of({n: str(i.min_fact_hits) for n, i in P.intents.items()}, '2')} weak
 from (select *, {_FOCUS} f from {_ANSWERS}))""")
def display_policy(spark, d):
    intent, url = _columns()
    t = W.pairs(spark, d).filter("a is not null").withColumns({"intent": intent, "url": url})
    cover = A.coverage(G.focus(T.tokenize("q", P.stopwords), G.hints(F.col("intent"), P, "fact_tokens")), F.array_distinct(T.tokenize("a", P.stopwords)))
    out = G.display_policy(F.col("a"), F.array("url"), cover, F.col("intent"), P)
    return t.select("conv_id", "turn", F.sha2(out, 256).alias("digest"))


@query(f"select conv_id, turn, case when s <> '' and not {_one_of(_KEEPS['speaker_keeps'], 'false')} and ({_trusted_sql('url')} or {_LOW.format(x='h', t=Q.tok('h'))}) then s else h end said from (select *, {_one_of(_SPEAKER, chr(39) * 2)} s, array_to_string(list_slice(regexp_split_to_array(a, ' '), 1, 1 + (turn % 9)::int), ' ') h from {_ANSWERS})")
def speaker_policy(spark, d):
    intent, url = _columns()
    t = W.pairs(spark, d).filter("a is not null").withColumns({"intent": intent, "url": url})
    said = F.array_join(F.slice(F.split("a", " "), F.lit(1), (1 + F.col("turn") % 9).cast("int")), " ")
    return t.select("conv_id", "turn", G.speaker_policy(said, F.col("a"), F.array("url"), F.col("intent"), P).alias("said"))


_NAMED = "list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Zа-яА-Я0-9_]+'), lambda t: lower(t)), lambda t: length(t) > 2)"
_PLAIN = "trim(regexp_replace(regexp_replace(trim(a), '[*_`#>\\[\\]]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""with s as (select conv_id, turn, q, plain, unnest(p) s, generate_subscripts(p, 1) - 1 i from (select conv_id, turn, q, {_PLAIN} plain, {Q.sentences(_PLAIN)} p from {W._PAIRS} where a is not null)),
c as (select *, round(-(len(list_intersect(list_distinct(list_filter({_NAMED.format(x='q')}, lambda t: not list_contains({Q.quoted(P.speaker_stopwords)}, t))), list_distinct({_NAMED.format(x='s')}))) + case when i < 3 then 0.1::double else 0 end - abs(len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) - 12) * 0.03::double), 9) cost from s),
r as (select *, row_number() over (partition by conv_id, turn order by cost, i) n from c)
select conv_id, turn, sha256(string_agg(s, ' ' order by i)) digest from r where n <= 2 group by conv_id, turn""")
def speaker_sentences(spark, d):
    t = W.pairs(spark, d).filter("a is not null")
    return t.select("conv_id", "turn", F.sha2(G.speaker_sentences(F.col("a"), F.col("q"), P), 256).alias("digest"))


@query(f"select conv_id, turn, case when len(n) = 0 then 1 else round(len(list_filter(n, lambda a: len(list_filter(g, lambda s: {W._STEM} >= 4 and substr(a, 1, {W._STEM}) = substr(s, 1, {W._STEM}))) > 0))::double / len(n), 4) end >= 0.3::double or case when len(f) = 0 then 0 else round(len(list_intersect(f, g))::double / len(f), 4) end >= 0.2::double or {_trusted_sql('url')} grounded from (select *, list_distinct(list_filter({Q.tok('q')}, lambda t: length(t) >= 4 and not ({' or '.join(f'starts_with(t, {_TEXT(s)})' for s in P.low_signal_stems)}))) n, list_distinct(t) g, {_FOCUS} f from {_ANSWERS})")
def grounding_guard(spark, d):
    intent, url = _columns()
    t = W.pairs(spark, d).filter("a is not null").withColumns({"intent": intent, "url": url, "g": F.array_distinct(T.tokenize("a", P.stopwords))})
    wanted = T.tokenize("q", P.stopwords)
    cover = A.coverage(G.focus(wanted, G.hints(F.col("intent"), P, "fact_tokens")), F.col("g"))
    anchored = A.anchor_support(A.anchors(wanted, P.low_signal_stems), F.col("g"))
    return t.select("conv_id", "turn", A.grounded(G.trusted(F.array("url"), F.col("intent"), P), cover, anchored).alias("grounded"))


def _sensitive_sql() -> str:
    starts = sorted({t[:5] for i in P.intents.values() for t in i.fact_tokens if len(t) >= 4})
    return f"select conv_id, turn, {Q.has('lower(text)', (*P.fact_markers, *starts))} asks from conversations where role = 'user'"


@query(_sensitive_sql())
def fact_questions(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", G.fact_sensitive(F.col("text"), P).alias("asks"))


# --- markup ------------------------------------------------------------------------------------


@query("select conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[`#>]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\*\\*\\s+', '**', 'g'), '\\*\\*([^*]+)\\*\\*([А-Яа-яA-Za-z«(])', '**\\1** \\2', 'g'))) digest from (select conv_id, turn, '## > ** ' || regexp_replace(text, '\\s+', '**' || chr(10) || chr(10) || chr(10) || '`', 'g') m from conversations)")
def light_markdown(spark, d):
    m = F.concat(F.lit("## > ** "), F.regexp_replace("text", r"\s+", "**\n\n\n`"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(A.sanitize_markdown(m), 256).alias("digest"))


_LINK = "[a](/b) "


@query("select conv_id, turn, sha256(case when turn % 3 = 0 then body || chr(10) || 'end' else body end) digest from (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) || '.' body from conversations) where length(body) > 40")
def link_soup(spark, d):
    t = table(spark, d, "conversations").withColumn("body", F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("."))).filter("length(body) > 40")
    body = F.col("body")
    soup = F.when(F.col("turn") % 3 == 0, F.concat(body, F.lit("\n" + _LINK * 4 + "\nend"))).when(F.col("turn") % 3 == 1, F.concat(body, F.lit(" * * [menu](/m) " + _LINK))).otherwise(F.concat(body, F.lit(" [list](/pubs?x=1) " + _LINK * 8)))
    return t.select("conv_id", "turn", F.sha2(A.strip_link_soup(soup), 256).alias("digest"))


# --- history, tasks, files, control -------------------------------------------------------------


@query("select conv_id, string_agg(case when role = 'user' then 'user' else 'assistant' end, ',' order by turn) roles, count(*)::bigint n from (select conv_id, turn, case when turn % 3 = 0 then 'user' else role end role, case when turn % 4 = 3 then '  ' else text end text from conversations) where trim(text) <> '' group by conv_id")
def external_history(spark, d):
    # missing roles are the user's, blank messages go
    own = F.struct(F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text")).alias("content"))
    packed = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("m")))), lambda x: x["m"]).alias("h"))
    h = S.normalized_history(F.col("h"))
    return packed.select("conv_id", F.array_join(F.transform(h, lambda m: m["role"]), ",").alias("roles"), F.size(h).cast(LONG).alias("n")).filter("n > 0")


@query("select event_id from (select *, max(event_id % 50) over (partition by user_id) newest from events) where event_type = 'purchase' or event_id % 50 = newest")
def live_tasks(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("stream_id"), (F.col("event_id") % 50).alias("generation"), F.when(F.col("event_type") == "purchase", "final").otherwise("partial").alias("kind"))
    return S.latest_generation(e).select("event_id")


@query("select doc_id from (select doc_id, row_number() over (order by n_chars desc, 'f' || doc_id) n from documents) where n > 100")
def old_files(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("modified"), F.concat(F.lit("f"), "doc_id").alias("path"))
    return S.retained(files, 100).select("doc_id")


@query("select user_id, max_by(event_type, event_id) = 'signup' muted from events where event_type in ('signup', 'error') group by user_id")
def mute_state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "signup", "mute").when(F.col("event_type") == "error", "unmute").otherwise("speech").alias("kind"), F.col("event_id").alias("ts"))
    return voice.control_state(e).select(F.col("session_id").alias("user_id"), "muted")


@query("select event_id from (select *, last_value(case when event_type in ('signup', 'error') then event_type end ignore nulls) over (partition by user_id order by event_id) c from events) where event_type not in ('signup', 'error') and coalesce(c, 'error') <> 'signup'")
def gated_frames(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("event_id").alias("ts"), F.when(F.col("event_type") == "signup", "mute").when(F.col("event_type") == "error", "unmute").otherwise("speech").alias("kind"))
    return voice.gated(e.filter("kind = 'speech'"), e).select("event_id")


@query(f"select conv_id, turn, trim(u) = '' or list_contains({Q.quoted(P.stop_phrases)}, trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))) skipped from (select conv_id, turn, case turn % 4 when 0 then ' ' when 1 then 'Stop!' when 2 then 'stop it' else text end u from conversations)")
def skipped_utterances(spark, d):
    n = F.col("turn") % 4
    u = F.when(n == 0, " ").when(n == 1, "Stop!").when(n == 2, "stop it").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", V.skip_text(u, P.stop_phrases).alias("skipped"))


# --- records and indexes, written and read back ----------------------------------------------------


@query(f"select seed, {Q.canonical('url')} canonical_url, count(*)::bigint n, sum(length(html))::bigint n_chars from (select 'www_' || page_id % 2 seed, url, html from pages) group by all")
def seed_records(spark, d):
    folder = f"{shared_dir(spark)}/seeds-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages")
    for n in range(2):
        IO.write_seed(pages.filter(F.col("page_id") % 2 == n).select("url", "html"), folder, f"https://www.{n}/", f"job{n}", "completed")
    rows = IO.read_seed_records(spark, folder)
    seed = F.regexp_extract("file", r"([^/]+)\.records\.jsonl", 1)
    return rows.groupBy(seed.alias("seed"), U.canonicalize_url("url").alias("canonical_url")).agg(F.count("*").alias("n"), F.sum(F.length("html")).cast(LONG).alias("n_chars"))


@query(f"select distinct regexp_replace({C._ROOT} || l, '[?#].*$', '') url from (select url, unnest(regexp_extract_all(replace(html, '/en/', '/x.pdf?/'), '<a[^>]+href=\"([^\"]*)\"', 1)) l from pages) where starts_with(l, '/') and regexp_matches(lower(regexp_replace(l, '[?#].*$', '')), '\\.(pdf|docx?)$') and ends_with({Q.host('url')}, '.{P.domain}')")
def crawl_document_links(spark, d):
    folder = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages").select("url", F.replace("html", F.lit("/en/"), F.lit("/x.pdf?/")).alias("html"))
    IO.write_crawl(pages, folder, [{"job_id": "1", "start_url": "https://www.example.net/"}], [P.domain])
    return spark.read.json(f"{folder}/document_links").select("url") if spark.read.text(f"{folder}/document_links").count() else spark.createDataFrame([], "url string")


@query(f"select term, count(*)::bigint df, sum(tf)::bigint n from (select doc_id, term, count(*) tf from (select doc_id, unnest({Q.tok('text')}) term from documents) group by all) group by term")
def stored_postings(spark, d):
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    IO.save_index(R.postings(docs, "doc_id", "text", P.stopwords), R.stats(docs, "text", P.stopwords), folder)
    posts, _ = IO.load_index(spark, folder)
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast(LONG).alias("n"))


@query(f"select page_id, {Q.title('html')} title, coalesce(nullif(string_split({Q.canonical('url')}, '/')[4], ''), 'home') section, 'web:' || substr(sha256({Q.canonical('url')}), 1, 16) doc_id from pages where {Q.canonical('url')} <> ''")
def page_documents(spark, d):
    from skein.operators.ingest import documents_from_records

    none = {c: F.lit(None).cast("string") for c in ("markdown", "json", "sourceURL", "published_at")}
    meta = F.lit(None).cast("struct<title:string,published_at:string>")
    raw = table(spark, d, "pages").withColumns({**none, "title": T.titles("html"), "metadata": meta, "head": F.lit(None).cast("struct<title:string>"), "ord": F.col("page_id")})
    return documents_from_records(raw, P).select("page_id", "title", "section", "doc_id")


@query("select page_id, m title from (select page_id, case when regexp_matches(t, '(?m)^#{1,6}\\s+\\S') then regexp_extract(t, '(?m)^#{1,6}\\s+(.+?)\\s*$', 1) else substr(coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 4)[1], 'file'), 1, 160) end m from (select page_id, case when page_id % 2 = 0 then 'ab' || chr(10) || '## ' || url || ' ' || chr(10) || 'x' else 'ab' || chr(10) || ' ' || url end t from pages))")
def markdown_titles(spark, d):
    t = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("ab\n## "), "url", F.lit(" \nx"))).otherwise(F.concat(F.lit("ab\n "), "url"))
    return table(spark, d, "pages").select("page_id", T.markdown_title(t, F.lit("file")).alias("title"))


@query(f"select event_id, {Q.cardinal('(event_id % 10000)')} words, 'в ' || {Q.cardinal('(event_id % 24)')} || case when event_id % 60 > 0 then ' ' || case when event_id % 60 < 10 then 'ноль ' else '' end || {Q.cardinal('(event_id % 60)')} else '' end clock from events")
def spoken_numbers(spark, d):
    n = F.col("event_id")
    clock = F.format_string("в %d:%02d", (n % 24).cast("int"), (n % 60).cast("int"))
    return table(spark, d, "events").select("event_id", V.speech_text((n % 10_000).cast("string")).alias("words"), V.speech_text(clock).alias("clock"))
