"""Queries on small odd tables against their DuckDB SQL."""

import hashlib

import duckdb
import pytest

from skein.functions import answer as A
from skein.plans import catalogue
from skein.sources import records as S

BASE = [None, "", " ", "\n", "\u00a0", "\u00a0\n", "\x01", ".", ". .", "\x0b. \x0b", "\u2003One.\u2003 Two. \u3000"]


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query on texts, and its SQL."""

    def check(name, texts):
        rows = [(i, t, "en", "web") for i, t in enumerate([*BASE, *texts])]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = duckdb.execute(catalogue.oracle_sql()[name].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'"))
        columns = [c[0] for c in want.description]
        want = sorted(map(str, want.fetchall()))
        assert sorted(got.columns) == sorted(columns)
        assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
        return want

    return check


def test_chunks_keep_the_digits_at_line_ends(same):
    lines = "\n".join(f"{i % 10} line {i} of some words and {i % 10}" for i in range(90))  # line 1 begins and ends with 1
    spaces = "\n".join(f"\u00a0{i} a\u00a0b\x0bc \u2003" for i in range(300))
    assert len(same("chunk_documents", [lines, spaces, "1\n1\n2", "\n\n x \r\n1 y 2"])) > 8


def test_checksum_of_a_large_corpus_is_that_of_one_string(same, monkeypatch):
    monkeypatch.setattr(S, "CHECKSUM_ROWS", 5)
    monkeypatch.setattr(S, "CHECKSUM_BLOCK", 3, raising=False)
    same("corpus_checksum", [f"text {i}" for i in range(40)])


def test_checksum_in_many_ranges_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "CHECKSUM_BLOCK", 7, raising=False)
    rows = [(None if i == 5 else i * 37 % 1009 - 400, None if i == 8 else f"{i:016x}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, h string").repartition(5)
    full = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0))
    assert S.corpus_checksum(df, "k", "h", whole=True).first()[0] == hashlib.sha256("".join(h for _, h in full).encode()).hexdigest()
    assert S.corpus_checksum(df.filter("h is null"), "k", "h", whole=True).collect() == [(None,)]
    assert S.corpus_checksum(df.limit(0), "k", "h", whole=True).collect() == [(None,)]


#: Sentences that begin and end with digits of their place; odd white space and letters.
SENTENCES = [
    "0 a 0. 1 b 1. 2 c 2. 10 d 3. 4 e 5. x. 3 b 3. 7",
    "1 go. 2 go. go. 3 GO. Go. go",
    "ΑΣ. ας. ασ. İx. ix. Ix.",
    "a.\x0bb. a.\x0bb. a. b\x0bc. b c. b\tc.",
    "a\u00a0. a\u00a0.\u00a0 \u3000a\u00a0. \n a.\n\n a.",
    "one\x01two. one\x01one",
]


def test_equal_sentences_are_counted_as_in_sql(same, spark):
    assert len(same("dedupe_sentences", SENTENCES)) > len(SENTENCES)
    df = spark.createDataFrame([("2 B b. A. 1 a.  a. a. 4 B B. c",)], "t string")
    assert df.select(A.dedupe_sentences("t")).first()[0] == "2 B b. A. 1 a. 4 B B. c"


def test_word_limits_as_in_sql(same):
    long = ["4 a " * 12 + "1. 2 b 1. " + "c d " * 30, "\x0b".join("ab" for _ in range(50)), "word-  " * 41, "w " * 38 + "   , ,  x y", "w " * 39 + ". 1 tail 1. more " + "z " * 9]
    assert len(same("limit_words", [*SENTENCES, *long])) > len(long)


def test_banned_sentences_as_in_sql(same):
    same("policy_artifacts", [*SENTENCES, "The: 1. ontİonre 2. 2 left 2.", "a. the b.  the c. d\x01the e"])


def test_first_sentences_as_in_sql(same):
    same("short_speaker", [*SENTENCES, "password. 1b8a61", "  　", "0 a. 1 1. c"])
