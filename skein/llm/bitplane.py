"""Token ids in a bit-plane file format.

Documents go in ascending id order into shards (one per range of ids), shards into chunks
of whole documents. A chunk's ids are cut into blocks of a fixed size, each block is
transposed into bit planes (or byte planes), each plane is compressed with zstandard, and a
block index in front tells every plane's size, so a reader can take single blocks. A shard
is a Parquet part file whose rows are chunks with their index columns: Spark's committer
writes it on any file system and repeats lost tasks without leaving half a file.

Frame: ``SKBP``, kind (1 bit planes, 2 byte planes), three zero bytes, number of blocks,
ids per block, ids in all (little-endian u32 each); then per block: number of planes (u32)
and each plane's compressed size (u32); then the planes in the same order.

Edge cases: a null or empty text has the end id alone; null ids come first; rows with equal
ids are ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import byte_bpe
from skein.llm.common import bounded_batches, shared_dir, slices

MAGIC, BIT, BYTE = b"SKBP", 1, 2
#: Ids per block, and ids after which a chunk is closed.
BLOCK_IDS, CHUNK_IDS = 16_384, 262_144
CHUNK = "shard long, chunk int, before long, n_ids long, doc_ids array<long>, doc_sizes array<long>, frame binary"


def pack(ids: np.ndarray, kind: int = BIT, block: int = BLOCK_IDS) -> bytes:
    """A frame of ids (unsigned 32-bit)."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    index, body = [], []
    blocks = range(0, len(ids), block)
    for at in blocks:
        x = ids[at : at + block]
        top = int(x.max()).bit_length()
        if kind == BIT:
            planes = [np.packbits((x >> np.uint32(k)).astype(np.uint8) & 1) for k in range(top)]
        else:
            planes = list(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-top // 8)]))
        packed = [squeeze(p.tobytes()) for p in planes]
        index.append(struct.pack(f"<I{len(packed)}I", len(packed), *map(len, packed)))
        body += packed
    return b"".join([MAGIC, bytes([kind, 0, 0, 0]), struct.pack("<III", len(blocks), block, len(ids)), *index, *body])


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of this format")
    kind, (blocks, block, total) = frame[4], struct.unpack_from("<III", frame, 8)
    at, sizes = 20, []
    for _ in range(blocks):
        (n,) = struct.unpack_from("<I", frame, at)
        sizes.append(struct.unpack_from(f"<{n}I", frame, at + 4))
        at += 4 + 4 * n
    expand, ids = zstandard.ZstdDecompressor().decompress, np.zeros(total, np.uint32)
    for b, planes in enumerate(sizes):
        x = ids[b * block : (b + 1) * block]
        for k, size in enumerate(planes):
            plane = np.frombuffer(expand(frame[at : at + size]), np.uint8)
            if kind == BIT:
                x |= np.unpackbits(plane, count=len(x)).astype(np.uint32) << np.uint32(k)
            else:
                x |= plane.astype(np.uint32) << np.uint32(8 * k)
            at += size
    return ids


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, kind: int = BIT) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the shards to ``path``."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe, shard, number, before = byte_bpe.loaded(tokenizer_file), None, 0, 0
        end, keys, texts, held = np.uint32(end_id).tobytes(), [], [], 0

        def chunk():
            ids = np.frombuffer(b"".join(texts), "<u4")
            sizes = [len(x) // 4 for x in texts]
            arrays = [pa.array([x], t) for x, t in ((shard, pa.int64()), (number, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (keys, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (pack(ids, kind), pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "before", "n_ids", "doc_ids", "doc_sizes", "frame"])

        for batch in batches:
            for part in slices(batch, "text"):
                for key, ids in zip(part.column("doc_id").to_pylist(), bpe.encode_batch(part.column("text").to_pylist())):
                    if shard is None:
                        shard = -(1 << 63) if key is None else key
                    keys.append(key)
                    texts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= CHUNK_IDS:
                        yield chunk()
                        number, before, held, keys, texts = number + 1, before + held, 0, [], []
        if texts:
            yield chunk()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, CHUNK).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, ids of every document, from the files alone."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    # one row per shard, and there are as many shards as ranges of ids
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = unpack(row["frame"]), row["doc_sizes"]
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                pieces = [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(edges[:-1] + row["base"] + row["before"]), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "ids"])

    joined = chunks.join(F.broadcast(first), "shard").select("base", "before", "doc_ids", "doc_sizes", "frame")
    return joined.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_file: str, kind: int = BIT) -> DataFrame:
    """Writes ``docs`` and returns doc_id, start, n_tokens, ids_crc32 as read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/planes-{uuid.uuid4().hex}"
    write(docs, tokenizer_file, path, kind=kind)
    back = read(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids) -> int:
    """What ``ids_crc32`` holds, for ids in memory."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
