"""Readers and writers at the edge: crawl records, files, indexes, manifests."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from skein.functions import text as T
from skein.functions import urls as U

RAW = "url string, title string, markdown string, html string, json string, sourceURL string, published_at string, metadata struct<title:string,published_at:string>, head struct<title:string>, _corrupt_record string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records (JSON lines) with ``ord``, their place; blank lines are skipped and broken
    ones kept in ``_corrupt_record``."""
    rows = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_seed_records(spark: SparkSession, folder: str) -> DataFrame:
    """All seeds' records, with the file they came from; order by (file, ord)."""
    return read_records(spark, f"{folder}/*.records.jsonl").withColumn("file", F.input_file_name())


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_crawl(records: DataFrame, path: str, jobs: list[dict], domains: list[str]) -> dict:
    """A crawl's records, the distinct links to documents in them (sorted), and the manifest,
    which is written last. jobs: rows with job_id and start_url. Returns the manifest."""
    spark = records.sparkSession
    write_records(records, f"{path}/records")
    held = read_records(spark, f"{path}/records")
    links = [F.coalesce(U.document_links("html", "markdown", F.coalesce("url", "sourceURL"), d), T.words_in(())) for d in domains]
    found = held.select(F.explode(F.concat(*links)).alias("url")).distinct() if links else spark.createDataFrame([], "url string")
    found.orderBy("url").write.mode("overwrite").json(f"{path}/document_links")
    manifest = {"job_ids": [j["job_id"] for j in jobs], "start_urls": [j["start_url"] for j in jobs if j.get("start_url")], "record_count": held.count(), "status": "completed", "jobs": jobs, "records_path": f"{path}/records", "document_links_path": f"{path}/document_links"}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_seed(records: DataFrame, folder: str, url: str, job: str, status: str) -> dict:
    """One seed's records and manifest, beside the others'."""
    write_records(records, f"{folder}/{seed_file(url)}")
    count = read_records(records.sparkSession, f"{folder}/{seed_file(url)}").count()
    manifest = {"job_id": job, "start_url": url, "status": status, "record_count": count, "records_path": f"{folder}/{seed_file(url)}"}
    name = seed_file(url).replace(".records.jsonl", ".manifest.json")
    records.sparkSession.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return manifest


def paged(pages: Callable[[bytes], Iterable[bytes]], read: Callable[[bytes], str], most: int = 8) -> Callable[[bytes], str]:
    """A reader of scanned files from one that renders their pages and one that reads a page: the
    first ``most`` pages' texts."""
    return lambda content: "\n".join(t for t in (read(p) for p in islice(pages(content), most)) if t.strip())


def read_files(spark: SparkSession, root: str, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """Hand-made documents (.pdf, .docx, .txt) under a folder: path, url, text, mode, needs_ocr.

    ``ocr`` is the plug point for scanned files (see ``paged``); without it their text stays as
    found."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx,txt,md}").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_file(p, c, ocr) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "text": [x[0] for x in parsed], "extraction_mode": [x[1] for x in parsed], "needs_ocr": [x[2] for x in parsed]})

    out = files.select("path", "content").mapInPandas(run, "path string, text string, extraction_mode string, needs_ocr boolean")
    root = re.sub(r"^file:/*", "/", root).rstrip("/")
    relative = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return out.withColumn("source_url", F.concat(F.lit("manual://"), F.regexp_replace(relative, f"^{re.escape(root)}/", ""))).orderBy("path")


def pdf_text(content: bytes) -> str:
    """The strings that a PDF's pages show, of plain and of deflated streams: what stands in
    brackets (or as hex) before Tj, TJ and the quote operators."""
    out = []
    for found in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = found[1]
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            pass  # a plain stream, or one that isn't text
        if b"Tj" in data or b"TJ" in data:
            out.append(data)
    shown = []
    for data in out or [content]:
        for array, one in re.findall(rb"\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>)\s*(?:Tj|['\"])", data, re.S):
            pieces = re.findall(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>", array or one, re.S)
            shown.append("".join(_pdf_string(x) for x in pieces))
    return " ".join(x for x in shown if x.strip())


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else plain.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "ignore") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def parse_file(path: str, content: bytes, ocr: Callable[[bytes], str] | None = None) -> tuple[str, str, bool]:
    """(text, mode, needs_ocr) of a file by its name."""
    content = bytes(content)
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        with zipfile.ZipFile(BytesIO(content)) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in tree.iter(f"{space}p"))
        return "\n".join(x for x in lines if x.strip()), "docx", False
    if kind == "pdf":
        text = pdf_text(content)
        if len(text.split()) < 30:
            read = ocr(content) if ocr else ""
            return read or text, "ocr" if read else "pdf", not read
        return text, "pdf", False
    return content.decode("utf-8", "ignore"), "text", False


class _Markdown(HTMLParser):
    SKIP, BREAKS = frozenset("script style head title noscript template".split()), frozenset("p div section article ul ol table tr header footer nav br".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += tag not in ("head",)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in self.BREAKS:
            self.out.append("\n" if tag in ("br", "tr") else "\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - (tag not in ("head",)))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in self.BREAKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None) -> str:
    """Minimal markdown: headings, lists, links and bold stay, images go, nothing is wrapped."""
    parser = _Markdown()
    parser.feed(page or "")
    lines = [re.sub(" +", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown_of(page):
    """The column's pages as markdown (an Arrow-batched pandas UDF)."""
    return F.pandas_udf(lambda pages: pages.map(html_to_markdown), "string")(page)


# --- indexes and manifest -----------------------------------------------------------------


def save_index(postings: DataFrame, stats: DataFrame, path: str, buckets: int = 32, vectors: DataFrame | None = None) -> None:
    """Postings by hash of the term, so a search reads the buckets of its terms only; collection
    totals; vectors if there are any."""
    postings.withColumn("bucket", term_bucket("term", buckets)).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def term_bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def load_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 32) -> tuple[DataFrame, DataFrame]:
    """(postings, stats); with ``terms`` only their buckets are read."""
    rows = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(term_bucket("term", buckets).alias("b")).distinct()
        rows = rows.filter(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("term").isin(terms))
    return rows.drop("bucket"), spark.read.parquet(f"{path}/stats")


#: Rows whose hashes are joined in one place, in the mean.
CHECKSUM_ROWS = 100_000
#: Hashes in a row of ``_chained``: 8 KB with hashes of 16 characters.
CHECKSUM_BLOCK = 512


def corpus_checksum(chunks: DataFrame, order: str, digest: str, whole: bool = False) -> DataFrame:
    """One row: SHA-256 over the chunks' hashes in order.

    Up to ``CHECKSUM_ROWS`` the hashes are joined as they are. Those of a larger corpus are dealt
    out by a hash of their place, and the checksum is that of the parts' checksums, so that no
    task holds more than a part; equal chunks give equal checksums either way.

    With ``whole`` the checksum is that of all hashes in one string at any size (null without
    any), see ``_chained``."""
    if whole:
        return _chained(chunks, order, digest)
    joined = lambda x, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda r: r[x]), ""), 256)
    parts = -(-chunks.count() // CHECKSUM_ROWS)
    if parts <= 1:
        return chunks.agg(joined(digest, order).alias("checksum"))
    dealt = chunks.groupBy(F.pmod(F.xxhash64(order), F.lit(parts)).alias("part")).agg(joined(digest, order).alias("own"))
    return dealt.agg(joined("own", "part").alias("checksum"))


def _chained(chunks: DataFrame, order: str, digest: str) -> DataFrame:
    """SHA-256 of all hashes joined in order (nulls of ``order`` last), in bounded memory.

    Ranges of ``order`` are sorted side by side and joined to blocks of ``CHECKSUM_BLOCK``
    hashes. SHA-256 is a chain, so one task reads the blocks in order, as a stream."""
    size = CHECKSUM_BLOCK

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, []

        def block(some: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "hashes": pa.array(["".join(some)], pa.string())})

        for batch in batches:
            held += batch.column("digest").to_pylist()
            while len(held) >= size:
                yield block(held[:size])
                held, at = held[size:], at + 1
        if held:
            yield block(held)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_ = hashlib.sha256(), False
        for batch in batches:
            for text in batch.column("hashes").to_pylist():
                state.update(text.encode())
                any_ = True
        if any_:
            yield pa.RecordBatch.from_pydict({"checksum": pa.array([state.hexdigest()], pa.string())})

    place = [F.col("place").asc_nulls_last(), F.col("digest").asc()]
    rows = chunks.select(F.col(order).alias("place"), F.col(digest).alias("digest")).filter("digest is not null")
    ranges = rows.repartitionByRange(F.col("place").asc_nulls_last()).sortWithinPartitions(*place).select("digest")
    joined = ranges.mapInArrow(blocks, "part int, at long, hashes string")
    own = joined.repartition(1).sortWithinPartitions("part", "at").select("hashes").mapInArrow(chain, "checksum string")
    return own.agg(F.max("checksum").alias("checksum"))


MANIFEST = S.StructType([S.StructField(n, S.StringType()) for n in ("version", "corpus_checksum", "lexical_path", "dense_path", "embedding_model", "reranker_model", "built_at")] + [S.StructField("doc_count", S.LongType()), S.StructField("chunk_count", S.LongType())])


def publish_manifest(spark: SparkSession, path: str, **values) -> None:
    """Written last: an index without a manifest isn't there yet."""
    row = tuple(values.get(f.name) for f in MANIFEST)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest as a dict; fields that it doesn't know are an error."""
    rows = spark.read.text(path).collect()
    if not rows:
        raise FileNotFoundError(path)
    found = json.loads(rows[0]["value"])
    if unknown := set(found) - set(MANIFEST.names):
        raise ValueError(f"unknown manifest fields: {sorted(unknown)}")
    return {n: found.get(n) for n in MANIFEST.names}


# --- crawl service ---------------------------------------------------------------------------

TERMINAL = ("completed", "failed", "cancelled", "errored", "timed_out")


def backoff(attempt: int, retry_after: float | None = None, base: float = 2.0) -> float:
    """Seconds to wait after a refused request."""
    return max(base * (attempt + 1), retry_after or 0.0)


class CrawlClient:
    """Starts and reads crawl jobs through ``send(method, path, body) -> (status, headers,
    json)``, the plug point for HTTP."""

    def __init__(self, send, sleep=time.sleep, retries: int = 5) -> None:
        self.send, self.sleep, self.retries = send, sleep, retries

    def request(self, method: str, path: str, body: dict | None = None) -> dict:
        for attempt in range(self.retries + 1):
            status, headers, found = self.send(method, path, body)
            if status == 429 and attempt < self.retries:
                self.sleep(backoff(attempt, float(headers.get("Retry-After") or 0)))
                continue
            if status >= 400:
                raise RuntimeError(f"{method} {path}: status {status}")
            return found
        raise RuntimeError(f"{method} {path}: refused")

    def start(self, url: str, **options) -> str:
        return self.request("POST", "/crawl", {"url": url, **options})["result"]

    def wait(self, job: str, every: float = 5.0, most: int = 1000) -> dict:
        for _ in range(most):
            found = self.request("GET", f"/crawl/{job}?limit=1")["result"]
            if found["status"] in TERMINAL:
                return found
            self.sleep(every)
        raise TimeoutError(job)

    def records(self, job: str) -> Iterator[dict]:
        cursor = None
        while True:
            found = self.request("GET", f"/crawl/{job}?status=completed" + (f"&cursor={cursor}" if cursor else ""))["result"]
            yield from found.get("records", [])
            cursor = found.get("cursor")
            if not cursor:
                return


def seed_file(url: str) -> str:
    """File name of a seed's records."""
    return re.sub("^https?://", "", url).strip("/").replace("/", "__").replace(".", "_") + ".records.jsonl"


