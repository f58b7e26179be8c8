"""Queries of this package's operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from skein.llm import bitplane, chat_format, decontaminate, html_tree, interpolated_lm, language_id, line_templates, minhash, piece_bpe, pq_dedup

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

#: The conversation that op7 adds: control strings inside texts.
PROBE = r"\### Assistant: </turn> ok"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_tree(spark, sf_dir):
    return html_tree.extract_pages(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark, sf_dir):
    return piece_bpe.digest_documents(table(spark, sf_dir, "documents"), PIECES, surface=True)


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bit_planes(spark, sf_dir):
    return bitplane.round_trip(table(spark, sf_dir, "documents"), BYTES)


def op5_pq_dedup(spark, sf_dir):
    return pq_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_interpolated_lm(spark, sf_dir):
    return interpolated_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_format.format_conversations(turns.unionByName(probe), BYTES)


def op8_minhash(spark, sf_dir):
    return minhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_line_templates(spark, sf_dir):
    return line_templates.dedup_lines(table(spark, sf_dir, "documents"))


def queries():
    own = [op1_html_tree, op2_sentencepiece, op3_decontaminate, op4_bit_planes, op5_pq_dedup, op6_interpolated_lm, op7_chat_format, op8_minhash, op9_language_id, op10_line_templates]
    return {f.__name__: f for f in own}


#: A line is dropped if its template, or one of its four groups, is in documents of three different texts.
_LINES = """with d as (select doc_id, string_split(text, chr(10)) raw from documents),
m as (select *, list_transform(raw, lambda l: trim(regexp_replace(regexp_replace(l, '[^\\s0-9]*[0-9]\\S*', '<*>', 'g'), '\\s+', ' ', 'g'))) ms from d),
l as (select doc_id, md5(array_to_string(list_filter(ms, lambda t: t <> ''), chr(10))) copy, unnest(range(len(ms))) pos, unnest(ms) t, unnest(raw) line from m),
w as (select *, string_split(t, ' ') w from l where t <> ''),
q as (select *, len(w) - 3 tail, 2 * ((length(t) - length(replace(t, '<*>', ''))) // 3) > len(w) own, len(w) || chr(1) || array_to_string(w[1:3], ' ') leaf from w),
p as (select *, list_transform(range(4), lambda j: array_to_string(w[4 + tail * j // 4:3 + tail * (j + 1) // 4], ' ')) p from q),
k as (select doc_id, pos, copy, unnest(case when own then ['=' || trim(regexp_replace(line, '\\s+', ' ', 'g'))] when tail < 4 then ['t' || t]
  else list_prepend('t' || t, list_transform(range(4), lambda j: 'g' || j || chr(1) || leaf || chr(1) || array_to_string(list_transform(range(4), lambda i: case when i = j then '' else p[i + 1] end), chr(1)))) end) key from p),
gone as (select distinct doc_id, pos from k where key in (select key from k group by key having count(distinct copy) >= 3)),
o as (select doc_id, unnest(range(len(raw))) pos, unnest(raw) line from d)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (g is null), '') text, count(*)::bigint n_lines, count(g)::bigint n_dropped from (select o.*, gone.pos g from o left join gone using (doc_id, pos)) group by doc_id"""


def oracle_sql():
    return {"op10_line_templates": _LINES}
