"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its runs without white space. Tokens that hold a digit are variable
fields and become ``<*>``; that makes the line's template. Lines most of whose tokens are
fields have no template but themselves: only equal lines recur. Templates hang in a tree of
fixed depth: number of tokens, then the leading tokens. Lines of a leaf that agree in three
of four equal parts of their tails form a group, whose remaining part is a variable field
too; a line is in four groups, one for each part.

A template or a group recurs if documents of at least ``MIN_DOCS`` different texts hold it;
texts are different if any line's template is. So copies of whole documents count once and
stay intact; they are another operator's work. Lines that near copies of ``MIN_DOCS``
different texts share do recur. All lines of recurring templates and groups are dropped;
other lines, empty ones included, stay as they are and in order.

Edge cases: a null text stays null, an empty one empty; empty lines are never dropped;
repeated rows count once; rows with null ids count by their texts; an empty table gives an
empty result; other columns are kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize

MIN_DOCS, LEADING, PARTS = 3, 3, 4


def _to_clean(text: Column) -> Column:
    """Texts without any of this are their own templates line by line."""
    inner = text.rlike(r"[0-9\t\r\x0B\f]")
    for part in ("  ", "\n ", " \n"):
        inner = inner | F.contains(text, F.lit(part))
    return inner | text.startswith(" ") | text.endswith(" ")


def template(line: Column) -> Column:
    """A line with ``<*>`` for tokens that hold a digit, one space between tokens."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[^\s0-9]*[0-9]\S*", "<*>"), r"\s+", " "))


def _head(text: Column, n: Column | int) -> Column:
    """The first n tokens, or the last -n."""
    return F.call_function("substring_index", text, F.lit(" "), n if isinstance(n, Column) else F.lit(n))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``__doc``: a hash of a row's id and text."""
    return docs.withColumn("__doc", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), F.col("text")))


def _parsed(docs: DataFrame, lead: int) -> DataFrame:
    """A row per line that isn't empty: doc, copy (a hash of the document's templates), pos (the
    line's number) and keys (hashes of its template and, for long lines, of its groups)."""
    split = F.split("text", "\n")
    cleaned = F.transform(split, lambda x, i: F.struct(i.alias("pos"), template(x).alias("t"), x.alias("raw")))
    plain = F.transform(split, lambda x, i: F.struct(i.alias("pos"), x.alias("t"), F.lit(None).cast("string").alias("raw")))
    lines = F.filter(F.when(_to_clean(F.col("text")), cleaned).otherwise(plain), lambda x: x["t"] != "")
    rows = _keyed(docs).select(F.col("__doc").alias("doc"), lines.alias("lines"))
    # the hash is taken before the lines are told apart, so once a document
    rows = rows.select("doc", F.xxhash64("lines.t").alias("copy"), "lines").select("doc", "copy", F.explode("lines").alias("x")).select("doc", "copy", "x.*")
    rows = rows.withColumn("n", F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    # a template is more than fields: at least half of its tokens are fixed
    fields = (F.length("t") - F.length(F.replace("t", F.lit("<*>"), F.lit("")))) / 3
    rows = rows.withColumn("own", 2 * fields > F.col("n"))
    tail, t = F.col("n") - lead, F.col("t")
    long = ~F.col("own") & (tail >= PARTS)
    ends = [lead + F.floor(tail * j / PARTS).cast("int") for j in range(PARTS + 1)]
    # a group is what stands before and after one part; its size and place fix where they end
    after = [_head(t, ends[j + 1] - F.col("n")) for j in range(PARTS - 1)] + [F.lit("")]
    groups = [F.xxhash64("n", F.lit(j), _head(t, ends[j]), after[j]) for j in range(PARTS)]
    exact = F.when(F.col("own"), F.xxhash64(F.lit("="), F.trim(F.regexp_replace(F.coalesce("raw", "t"), r"\s+", " ")))).otherwise(F.xxhash64("t"))
    return rows.select("doc", "copy", "pos", F.when(long, F.array(exact, *groups)).otherwise(F.array(exact)).alias("keys"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEADING) -> DataFrame:
    """(doc, places): for each document that has any, the numbers of the lines to drop."""
    rows = materialize(_parsed(docs.select("doc_id", "text"), lead), "lines")
    held = rows.select(F.explode("keys").alias("key"), "copy").distinct()
    recurring = held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("key")
    recurring = materialize(recurring, "recurring")
    # never broadcast: the keys grow with the documents
    found = rows.select(F.explode("keys").alias("key"), "doc", "pos").join(recurring.hint("merge"), "key", "left_semi")
    return found.groupBy("doc").agg(F.collect_set("pos").alias("places"))


def mark_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEADING) -> DataFrame:
    """``docs`` with the text that is left, and how many lines it had and lost."""
    drop = recurring_lines(docs, min_docs, lead).select(F.col("doc").alias("__drop"), F.col("places").alias("__places"))
    out = _keyed(docs).join(drop, F.col("__doc") == F.col("__drop"), "left")
    lines = F.split("text", "\n")
    left = F.when(F.col("__places").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains("__places", i)))
    out = out.select(*[f"`{c}`" for c in docs.columns], lines.alias("__lines"), left.alias("__left"))
    counts = [F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"), (F.size("__lines") - F.size("__left")).cast("long").alias("n_dropped")]
    return out.select(*[F.array_join("__left", "\n").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: doc_id, the text that is left, n_lines, n_dropped."""
    return mark_lines(docs.select("doc_id", "text"), min_docs)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines dropped, ``n_chars`` as the text now is; rows of which
    nothing but white space is left go."""
    names = {c: f"{c}_" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = mark_lines(docs.withColumnsRenamed(names), min_docs)
    out = out.filter(F.col("n_dropped").isNull() | (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(*[f"`{c}`" for c in docs.columns])
