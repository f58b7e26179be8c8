import io
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.sources import records as S


def test_records(spark, tmp_path):
    (tmp_path / "a.records.jsonl").write_text('{"url": "http://x", "markdown": "m"}\n\n{broken\n')
    got = S.read_seed_records(spark, str(tmp_path)).collect()
    assert [r.url for r in got if r.url] == ["http://x"] and sum(r._corrupt_record is not None for r in got) == 1
    S.write_records(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().t == "é"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"hello \xff world")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "c.pdf").write_bytes(b"%PDF (Short) Tj")
    (tmp_path / "d.exe").write_bytes(b"no")
    got = {r.source_url: (r.text, r.extraction_mode, r.needs_ocr) for r in S.read_files(spark, str(tmp_path), ocr=lambda b: "").collect()}
    assert got == {"manual://in/a.txt": ("hello  world", "text", False), "manual://b.docx": ("One\nTwo", "docx", False), "manual://c.pdf": ("Short", "pdf", True)}


def test_markdown():
    assert S.html_to_markdown("<head><title>t</title></head><h1>A</h1><p>b <b>c</b> &amp; <a href='/d'>e</a><ul><li>f<li>g</ul><script>x</script>") == "# A\n\nb **c** & [e](/d)\n\n* f\n* g"


def test_index_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    S.save_index(R.postings(docs, "doc_id", "text"), R.stats(docs, "text"), str(tmp_path / "ix"), 4)
    posts, stats = S.load_index(spark, str(tmp_path / "ix"), ["beta"], 4)
    assert sorted(r.doc_id for r in posts.collect()) == [1, 2] and stats.first().n == 2
    with pytest.raises(Exception):
        S.read_manifest(spark, str(tmp_path / "m"))
    S.publish_manifest(spark, str(tmp_path / "m"), version="1", doc_count=2)
    assert S.read_manifest(spark, str(tmp_path / "m"))["doc_count"] == 2
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    assert S.corpus_checksum(hashed, "doc_id", "h").first() == S.corpus_checksum(hashed.repartition(3), "doc_id", "h").first()


def test_crawl_client():
    replies = [(429, {"Retry-After": "7"}, {}), (200, {}, {"result": "j"}), (200, {}, {"result": {"status": "running"}}), (200, {}, {"result": {"status": "completed"}}), (200, {}, {"result": {"records": [1], "cursor": 5}}), (200, {}, {"result": {"records": [2]}})]
    waits, asked = [], []

    def send(method, path, body):
        asked.append(path)
        return replies.pop(0)

    c = S.CrawlClient(send, waits.append)
    assert c.start("http://x") == "j" and waits == [7.0]
    assert c.wait("j")["status"] == "completed"
    assert list(c.records("j")) == [1, 2] and asked[-1].endswith("cursor=5")
    assert S.backoff(2) == 6.0 and S.seed_file("https://a.b/c/") == "a_b__c.records.jsonl"
    with pytest.raises(RuntimeError):
        S.CrawlClient(lambda *a: (500, {}, {}), waits.append).start("x")
