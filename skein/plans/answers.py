"""Catalogue: answer policy, grounding, memory, sessions, utterances, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import policy as G
from skein.functions import speech as V
from skein.functions import text as T
from skein.operators import sessions as S
from skein.plans import ingest as C
from skein.plans import retrieval as B
from skein.plans import sql as Q
from skein.plans.base import query, table
from skein.rules import SYNTHETIC as P
from skein.sources.shared import shared_dir
from skein.streaming import voice

LONG = "bigint"


def _turns(spark, d):
    return table(spark, d, "conversations")


#: Every user turn with the conversation's first assistant turn after it.
_PAIRS = "(select conv_id, u.turn, u.text q, (select min_by(a.text, a.turn) from conversations a where a.conv_id = u.conv_id and a.role = 'assistant' and a.turn > u.turn) a from conversations u where u.role = 'user')"


def pairs(spark, d) -> DataFrame:
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    t = _turns(spark, d).withColumn("a", F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(after))
    return t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"), "a")


_COVER = "case when len(w) = 0 then 0 else round(len(list_intersect(w, g))::double / len(w), 4) end"


@query(f"select conv_id, turn, {_COVER} coverage from (select conv_id, turn, list_distinct({Q.tok('q')}) w, list_distinct({Q.tok('a')}) g from {_PAIRS} where a is not null)")
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = pairs(spark, d).filter("a is not null")
    return t.select("conv_id", "turn", A.coverage(T.tokenize("q", P.stopwords), T.tokenize("a", P.stopwords)).alias("coverage"))


_STEM = "least(length(a), length(s), 5)"


@query(f"""select conv_id, turn, case when len(w) = 0 then 1 else round(len(list_filter(w, lambda a: len(list_filter(g, lambda s: {_STEM} >= 4 and substr(a, 1, {_STEM}) = substr(s, 1, {_STEM}))) > 0))::double / len(w), 4) end support
from (select conv_id, turn, list_distinct(list_filter({Q.tok('q')}, lambda t: length(t) >= 4)) w, list_distinct({Q.tok('a')}) g from {_PAIRS} where a is not null)""")
def anchor_support(spark, d):
    t = pairs(spark, d).filter("a is not null")
    return t.select("conv_id", "turn", A.anchor_support(A.anchors(T.tokenize("q", P.stopwords)), F.array_distinct(T.tokenize("a", P.stopwords))).alias("support"))


_SUPPORTED = "list_filter(f, lambda x: list_contains(sf, x)" + "".join(f" or (x = '{k}' and len(list_intersect({Q.quoted(v)}, sf)) > 0)" for k, v in P.facet_support.items()) + ")"


@query(f"select page_id, case when len(f) = 0 or len(sf) = 0 then 0 else round(len({_SUPPORTED})::double / len(f), 4) end support from (select page_id, {B._FS} f, {C.FACETS_SQL} sf from {C.PAGES_SQL})")
def facet_support(spark, d):
    r = C.page_records(spark, d)
    wanted = F.when(F.col("page_id") % 2 == 0, T.words_in(("motion", "cost"))).otherwise(T.words_in(("place",)))
    held = C.I.source_facets(F.col("url"), F.col("title"), F.col("text"), P)
    return r.select("page_id", G.facet_support(wanted, held, P).alias("support"))


_OK = f"len(list_distinct({Q.tok('s')})) <= 3 or len(list_intersect(list_distinct({Q.tok('s')}), g))::double / greatest(1, len(list_distinct({Q.tok('s')}))) >= 0.15::double"


@query(f"select conv_id, turn, (len(p) - len(k))::bigint dropped, sha256(case when len(k) > 0 then array_to_string(k, ' ') else a end) digest from (select *, list_filter(p, lambda s: {_OK}) k from (select conv_id, turn, a, {Q.sentences('a')} p, list_distinct({Q.tok('q')}) g from {_PAIRS} where a is not null))")
def verify_grounding(spark, d):
    t = pairs(spark, d).filter("a is not null").withColumn("g", F.array_distinct(T.tokenize("q", P.stopwords)))
    text, dropped = A.verified("a", F.col("g"), lambda s: T.tokenize(s, P.stopwords))
    return t.select("conv_id", "turn", dropped.cast(LONG).alias("dropped"), F.sha2(text, 256).alias("digest"))


def _rule_sql(intent: str, name: str) -> str:
    """A list of the intent's rules."""
    return f"case {intent} " + " ".join(f"when '{n}' then {Q.quoted(getattr(i, name))}" for n, i in P.intents.items()) + " else []::varchar[] end"


_HAS = "len(list_filter({marks}, lambda m: contains(lower({text}), m))) > 0"
_PIECES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 4)"


@query(f"""{B._BATCH}, q as (select query_id, t, string_split({B._intents_sql('q')}, ',')[1] intent from ({B._ITEM})),
r as (select query_id, t, list_intersect(list_distinct(t), {_rule_sql('intent', 'fact_tokens')}) hit, {_rule_sql('intent', 'fact_tokens')} facts, {_rule_sql('intent', 'noisy_sentences')} noisy, {_rule_sql('intent', 'allowed_sources')} allowed, {_rule_sql('intent', 'denied_sources')} denied, {_rule_sql('intent', 'trusted_sources')} trusted from q),
h as (select r.*, rank, text, url, {_PIECES} ss, case when len(hit) > 0 then hit else list_distinct(t) end wanted from r join ranked using (query_id) join {B._META} using (doc_id) where rank <= 3 and (len(allowed) = 0 or {_HAS.format(marks='allowed', text='url')}) and not {_HAS.format(marks='denied', text='url')}),
s as (select query_id, rank, i, s, wanted, facts, noisy, case when {_HAS.format(marks='trusted', text='url')} then 0.18::double else 0 end bonus, list_distinct({Q.tok('s')}) own from (select *, generate_subscripts(ss, 1) i, unnest(ss) s from h)),
c as (select *, len(list_intersect(wanted, own))::double / greatest(1, len(wanted)) overlap, case when len(facts) > 0 then len(list_intersect(facts, own))::double / len(facts) else 0 end fact from s where len(own) > 0),
k as (select *, overlap + 0.6::double * fact + bonus score from c where (overlap > 0 or fact > 0) and not ({_HAS.format(marks='noisy', text='s')}) and not (len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) > 32 and len(facts) > 0 and fact = 0)),
u as (select *, row_number() over (partition by query_id, regexp_replace(lower(s), '\\s+', ' ', 'g') order by score desc, rank, i) n from k),
o as (select *, row_number() over (partition by query_id order by score desc, rank, i) place from u where n = 1)
select query_id, intent, coalesce((select sha256(string_agg(s, ' ' order by place)) from o where o.query_id = q.query_id and place <= 2), sha256('')) digest from q""")
def extractive_fallback(spark, d):
    hits = B.batch_hits(spark, d, 3).join(B.doc_meta(spark, d).select("doc_id", "source"), "doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("hits"))  # three a query
    rows = B._items(spark, d).withColumn("intent", F.get("intents", F.lit(0))).join(packed, "query_id", "left")
    pairs = F.transform("hits", lambda h: F.struct(h["source"].alias("source"), h["text"].alias("text")))
    return rows.select("query_id", "intent", F.sha2(G.extract(pairs, F.col("tokens"), F.col("intent"), P), 256).alias("digest"))


_SENT = f"(select doc_id, {Q.sentences('text')} p from documents)"


@query(f"select doc_id, len(p)::bigint n_sentences, len(list_distinct(list_transform(p, lambda s: regexp_replace(lower(s), '\\s+', ' ', 'g'))))::bigint n_distinct from {_SENT}")
def dedupe_sentences(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.sentences("text").alias("p"), A.distinct_sentences("text").alias("k"))
    return t.select("doc_id", F.size("p").cast(LONG).alias("n_sentences"), F.size("k").cast(LONG).alias("n_distinct"))


_BAN = "|".join(f"(?:{b})" for b in P.banned_sentences)


@query(f"select doc_id, len(k) < len(p) changed, sha256(case when len(k) > 0 then array_to_string(k, ' ') else text end) digest from (select doc_id, text, p, list_filter(p, lambda s: not regexp_matches(lower(s), '{_BAN}')) k from (select doc_id, text, {Q.sentences('text')} p from documents))")
def policy_artifacts(spark, d):
    text, changed = A.drop_sentences("text", P.banned_sentences)
    return table(spark, d, "documents").select("doc_id", changed.alias("changed"), F.sha2(text, 256).alias("digest"))


@query(f"select doc_id, sha256(case when len(p) > 0 then array_to_string(p[1:2], ' ') else trim(text) end) digest from (select doc_id, text, {Q.sentences('text')} p from documents)")
def short_speaker(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(A.first_sentences("text", 2), 256).alias("digest"))


@query(f"""with s as (select doc_id, i, s, sum(n) over (partition by doc_id order by i) used from (select doc_id, unnest(range(1, len(p) + 1)) i, unnest(p) s, len(regexp_split_to_array(unnest(p), '\\s+')) n from {_SENT})),
k as (select doc_id, string_agg(s, ' ' order by i) t from s where used <= 40 group by doc_id),
d as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents),
m as (select *, w[1:40] f, list_max(list_transform(w[1:40], lambda x, i: case when i = 1 or length(regexp_replace(x, '^[.,!?;:-]+|[.,!?;:-]+$', '', 'g')) >= 3 then i else 0 end)) e from d)
select doc_id, len(w) > 40 cut, sha256(case when len(w) <= 40 then text when t is not null then t else trim(regexp_replace(array_to_string(f[1:greatest(1, e)], ' '), '[,;:-]+$', '')) end) digest from m left join k using (doc_id)""")
def limit_words(spark, d):
    text, cut = A.limit_words("text", 40)
    return table(spark, d, "documents").select("doc_id", cut.alias("cut"), F.sha2(text, 256).alias("digest"))


_HEAD = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_STOP = "(length(t) - length(regexp_extract(t, '(?s)^.*[.!?](.*)$', 1)))"


@query(f"""select doc_id, t <> '' and not regexp_matches(t, '[.!?]$') changed, case when t = '' or regexp_matches(t, '[.!?]$') then t when regexp_matches(t, '[.!?]') and {_STOP} - 1 >= floor(length(t) * 0.55::double) then trim(substr(t, 1, {_STOP}))
 when len(w) > 1 and b <> '' then b || '.' else t || '.' end out from (select *, regexp_replace(array_to_string(w[1:len(w) - 1], ' '), '[,;:-]+$', '') b from (select doc_id, {_HEAD} t, list_filter(regexp_split_to_array({_HEAD}, '\\s+'), lambda x: x <> '') w from documents))""")
def finalize_tail(spark, d):
    text, changed = A.finish("text")
    return table(spark, d, "documents").select("doc_id", changed.alias("changed"), text.alias("out"))


@query(None)
def limit_speaker(spark, d):
    text, cut = A.limit_chars("text", 160)
    return table(spark, d, "documents").select("doc_id", cut.alias("cut"), text.alias("out"))


#: Turns with markup around their words, since the texts have none.
_MARKED = "('**' || regexp_extract(text, '^(\\S+)', 1) || '** [' || regexp_extract(text, '^\\S+\\s+(\\S+)', 1) || '](http://x.y/z) `' || text || '` __a__ *b* https://q.r/s (  ) # c')"


def _marked():
    t = F.col("text")
    return F.concat(F.lit("**"), F.regexp_extract(t, r"^(\S+)", 1), F.lit("** ["), F.regexp_extract(t, r"^\S+\s+(\S+)", 1), F.lit("](http://x.y/z) `"), t, F.lit("` __a__ *b* https://q.r/s (  ) # c"))


def _plain_sql() -> str:
    t = "trim(m)"
    for p, to in ((r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), ("__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"https?://[^\s\])]+", ""), (r"[*_`#>\[\]]", ""), (r"\s+", " ")):
        t = f"regexp_replace({t}, '{p}', '{to}', 'g')"
    links = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(m), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://[^\\s)]+', '', 'g'), '\\s{2,}', ' ', 'g'), '\\(\\s*\\)', '', 'g'))"
    return f"select conv_id, turn, sha256(trim({t})) plain, sha256({links}) links from (select conv_id, turn, {_MARKED} m from conversations)"


@query(_plain_sql())
def strip_markdown(spark, d):
    m = _turns(spark, d).withColumn("m", _marked())
    return m.select("conv_id", "turn", F.sha2(A.strip_markdown("m"), 256).alias("plain"), F.sha2(A.strip_links("m"), 256).alias("links"))


@query("select conv_id, turn, trim(text) display, regexp_extract(text, '^(\\S+)', 1) speaker from conversations")
def tagged_response(spark, d):
    t = F.col("text")
    reply = F.concat(F.lit("x <display> "), t, F.lit(" </display>\n<speaker>"), F.regexp_extract(t, r"^(\S+)", 1), F.lit("</speaker>"))
    display, speaker = A.tagged(reply)
    return _turns(spark, d).select("conv_id", "turn", display.alias("display"), speaker.alias("speaker"))


@query(f"select doc_id, {Q.has('lower(text)', P.wrong_identity)} changed from documents")
def identity_guard(spark, d):
    text, changed = A.enforce_identity("text", P.wrong_identity, P.identity)
    # the wrong name is gone wherever it was
    return table(spark, d, "documents").select("doc_id", (changed & ~T.contains_any(F.lower(text), P.wrong_identity)).alias("changed"))


@query(f"select conv_id, turn, trim(text) = '' or regexp_matches(trim(text), '^\\s*(\\d+[.)]?|[-*•])\\s*$') or len({Q.tok('text')}) < 4 low_info, {Q.has('lower(text)', P.fact_markers)} fact_sensitive from conversations")
def low_info_turns(spark, d):
    low = A.low_information("text", T.tokenize("text", P.stopwords))
    return _turns(spark, d).select("conv_id", "turn", low.alias("low_info"), T.contains_any(F.lower("text"), P.fact_markers).alias("fact_sensitive"))


def _allowed_sql() -> str:
    parts = " ".join(f"when intent = '{n}' then not {Q.has('lower(url)', i.denied_sources)} and {Q.has('lower(url)', i.allowed_sources) if i.allowed_sources else 'true'}" for n, i in P.intents.items())
    return f"select query_id, page_id from (select *, max(ok::int) over (partition by query_id) any_ok from (select *, case {parts} else true end ok from (select page_id % 30 query_id, page_id, url, case page_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end intent from pages))) where ok or any_ok = 0"


@query(_allowed_sql())
def intent_source_filter(spark, d):
    n = F.col("page_id") % 3
    hits = table(spark, d, "pages").select((F.col("page_id") % 30).alias("query_id"), "page_id", F.col("url").alias("source"), F.when(n == 0, "alpha").when(n == 1, "beta").otherwise("gamma").alias("intent"))
    return S.filter_by_intent(hits, P).select("query_id", "page_id")


# --- memory and sessions ---------------------------------------------------------------------------


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn)::bigint place from (select *, row_number() over (partition by conv_id order by turn desc) b from conversations) where b <= 4")
def session_memory(spark, d):
    return S.memory(_turns(spark, d), 4).select("conv_id", "turn", "role", F.col("place").cast(LONG).alias("place"))


@query("select conv_id, sha256(string_agg(role || ': ' || text, chr(10) order by turn)) digest from (select *, row_number() over (partition by conv_id order by turn desc) b from conversations) where b <= 6 group by conv_id")
def prompt_history(spark, d):
    return S.history_prompt(_turns(spark, d), 6).select("conv_id", F.sha2("prompt", 256).alias("digest"))


@query("select user_id, min(ts) started, max(ts) ended, count(*)::bigint n_events from (select *, sum(new::int) over (partition by user_id order by ts, event_id) s from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours, true) new from events)) group by user_id, s")
def sessionize_events(spark, d):
    return S.sessions(table(spark, d, "events"), "6 hours").select("user_id", "started", "ended", "n_events")


@query("""with recursive e as (select user_id, event_id, epoch(ts::timestamp) ts, row_number() over (partition by user_id order by ts, event_id) rn from events),
r as (select user_id, event_id, rn, ts, ts begun, 1::bigint session from e where rn = 1
 union all select e.user_id, e.event_id, e.rn, e.ts, case when e.ts - r.ts > 21600 or e.ts - r.begun > 86400 then e.ts else r.begun end, r.session + case when e.ts - r.ts > 21600 or e.ts - r.begun > 86400 then 1 else 0 end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
select user_id, session, count(*)::bigint n_events from r group by user_id, session""")
def session_max_duration(spark, d):
    rows = S.bounded_sessions(table(spark, d, "events"), 21_600, 86_400)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"))


#: Event types as kinds of voice events.
_KINDS = {"signup": "wake", "view": "speech", "click": "query", "purchase": "answer", "error": "ready"}


@query(f"""with k as (select user_id, event_id, ts, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in _KINDS.items())} end kind from events),
s as (select *, case kind when 'wake' then 'listening' when 'speech' then 'listening' when 'query' then 'thinking' when 'answer' then 'speaking' end set_ from k),
w as (select *, last_value(set_ ignore nulls) over (partition by user_id order by ts, event_id) before from s)
select user_id, event_id, case when kind = 'ready' and coalesce(before, 'idle') <> 'speaking' then 'idle' else coalesce(before, 'idle') end state from w""")
def session_state_machine(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")]
    rows = table(spark, d, "events").withColumn("kind", kind)
    return S.session_states(rows, "kind", "user_id", "ts", "event_id").select("user_id", "event_id", "state")


@query("select event_type, (props->>'$.k')::bigint % 10 k, count(*)::bigint n from events group by all")
def event_props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast(LONG) % 10
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("select user_id, event_type, round(sum(value), 2) total, count(*)::bigint n from events group by all having count(*) > 1")
def event_rollup(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n")).filter("n > 1")


# --- utterances ----------------------------------------------------------------------------------------

def _stop_sql() -> str:
    bare = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"
    match = lambda w: f"len(list_filter(ws, lambda x: x = '{w}' or {bare('x')} = '{w}' or (length({bare('x')}) > 2 and {len(w)} > 2 and (contains({bare('x')}, '{w}') or contains('{w}', {bare('x')}))))) > 0"
    cases = " ".join("when " + " and ".join(match(w) for w in p.split()) + f" and len(ws) <= 4 and len(ws) > 0 then '{p}'" for p in P.stop_phrases)
    return f"select conv_id, turn, case {cases} end phrase from (select conv_id, turn, list_filter(regexp_split_to_array(lower(u), '\\s+'), lambda w: w <> '') ws from (select conv_id, turn, trim(text) u from conversations))"


@query(_stop_sql())
def stop_phrase_filter(spark, d):
    return _turns(spark, d).select("conv_id", "turn", V.stop_phrase("text", P.stop_phrases).alias("phrase"))


@query("""select conv_id, turn, case when length(regexp_replace(u, '[^\\p{L}\\p{N}]', '', 'g')) < 2 then 'short' when regexp_matches(lower(u), '^[\\W_]+$') or (length(u) >= 4 and replace(lower(u), substr(lower(u), 1, 1), '') = '') then 'noise' when len(w) >= 3 and 1 - len(list_distinct(w))::double / len(w) > 0.6::double then 'repeats' end reason
from (select conv_id, turn, u, list_filter(regexp_split_to_array(lower(u), '\\s+'), lambda x: x <> '') w from (select conv_id, turn, trim(case turn % 3 when 0 then repeat(regexp_extract(text, '^(\\S+)', 1) || ' ', 4) when 1 then text else substr(text, 1, 1) end) u from conversations))""")
def asr_text_filter(spark, d):
    n = F.col("turn") % 3
    u = F.when(n == 0, F.repeat(F.concat(F.regexp_extract("text", r"^(\S+)", 1), F.lit(" ")), 4)).when(n == 1, F.col("text")).otherwise(F.substring("text", 1, 1))
    return _turns(spark, d).select("conv_id", "turn", V.rejected(F.trim(u)).alias("reason"))


@query(None)
def wake_words(spark, d):
    found, rest = V.wake_word("text", "the and")
    return _turns(spark, d).select("conv_id", "turn", found.alias("found"), F.length(rest).cast(LONG).alias("n_rest"))


@query(f"select n::int n, n_items, {Q.cardinal('n')} words from (select l_quantity::int n, count(*)::bigint n_items from lineitem group by all)")
def number_words(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("n")).agg(F.count("*").alias("n_items"))
    return items.join(F.broadcast(V.number_table(spark, 100)), "n")  # 101 rows


@query(None)
def speech_sentences(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.size(V.speech_sentences(V.speech_text("text"))).cast(LONG).alias("n"))


@query(None)
def vad_segments(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 16).alias("stream_id"), F.col("event_id").alias("frame"), (F.pmod(F.xxhash64(F.floor(F.col("event_id") / 40)), F.lit(1000)) / 1000).alias("prob"))
    return S.segment_streams(e)


# --- streams ---------------------------------------------------------------------------------------------


@query("select user_id, min(ts) started, count(*)::bigint n_events from (select *, sum(new::int) over (partition by user_id order by ts, event_id) s from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours, true) new from events)) group by user_id, s")
def stream_sessions(spark, d):
    """Sessions of the events as a stream of files: closed ones are appended to a file sink as
    the watermark passes them, so neither the state nor the driver keeps them."""
    folder, events = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}", table(spark, d, "events")
    schema = events.schema
    # a mark of no user ends the stream: the watermark passes the last sessions
    ends = events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    ends.select(*[F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{folder}/end")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).unionByName(spark.readStream.schema(schema).parquet(f"{folder}/end"))
    counts = voice.session_counts(rows.withColumn("at", F.col("ts").cast("timestamp")), "6 hours", "0 seconds", "user_id")
    counts = counts.select("user_id", F.col("started").cast(schema["ts"].dataType).alias("started"), "n_events")
    sink = counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
