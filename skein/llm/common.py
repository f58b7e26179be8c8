"""What the operators of this package share: bounded Arrow batches, word and
shingle hashing, and tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Together with SLICE_BYTES it bounds a worker's memory.
BATCH_ROWS = 1000
#: Text bytes that an operator works on at once (one longer text counts alone).
SLICE_BYTES = 1 << 20

M64 = (1 << 64) - 1


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Caps Arrow batches at ``rows`` rows for this session (never raises the cap)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one, but only in a
    session of one machine (tests); on a cluster that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            held = now.get()
        elif spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set")
        else:
            held = "file://" + tempfile.mkdtemp(prefix="skein-")
            spark.sparkContext.setCheckpointDir(held)
            held = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return held.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and
    later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most ``most`` bytes of ``column``."""
    n = batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + sizes[i] > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    if n > start:
        yield batch.slice(start, n - start)


def doc_key(column: str = "doc_id"):
    """The id as text; null ids count as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", modulus: int = 10):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_key(column).cast("binary")), F.lit(modulus))


# --- hashing -----------------------------------------------------------------

_PLUS, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + _PLUS
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(m, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the offsets of each text's words.

    A word is a run without ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased first. A null
    text has no words."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    n = len(raw)
    space = _SPACE[raw]
    after = np.empty(n, bool)  # the byte before is a space
    after[0], after[1:] = True, space[:-1]
    starts = np.flatnonzero(after & ~space)
    ends = np.flatnonzero(space & ~after)
    up, down = _POWERS.upto(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * up[:n], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([0] + [len(p) + 1 for p in parts])
    return h, np.searchsorted(starts, edges)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (none if there are fewer)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = mix64(h ^ words[i : i + m])
    return h


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the word shingles in order; a shorter text has its whole sequence as one,
    an empty one none."""
    if len(words) == 0:
        return words
    return gram_hashes(words, min(n, len(words)))
