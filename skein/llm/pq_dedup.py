"""Embedding near-duplicates by product quantisation.

A coarse quantiser deals unit vectors into inverted lists: each half of a vector has a
codebook, and a list is a pair of their entries, so the number of lists follows the number
of vectors (about ``PER_LIST`` in each) while the codebooks stay small. A vector is entered
in the ``PROBES`` lists nearest to it, and asks in the same ones; what is left after
subtracting a list's centre is coded by one byte per subspace. Asymmetric distances from
lookup tables keep what can lie within the radius (each entry's own quantisation error is
stored, so by the triangle inequality no neighbour in a common list is lost), and the kept
ones are ranked by exact cosine in double precision. A pair counts in its first common list.

The quantisers are fitted on at most ``SAMPLE`` vectors chosen by a hash of their ids; all
vectors are indexed and all are queries. Equal vectors are one class with one entry. Work
follows the number of vectors times ``PROBES`` times a list's length, which is bounded
but for groups of vectors that are all close to each other, whose links have to be counted
(and until ``HALF`` squared lists, for some 10^9 vectors). Lists of over ``BLOCK`` entries
are dealt out in pairs of blocks, so a long list is many tasks of bounded size; a task
returns counts and a spanning forest of its links, not its pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths don't link with each other; a cosine that equals
the limit (a tie) links; repeated ids count as vectors each; a null id links with nothing;
an empty table gives an empty result; labels and other columns are ignored; vectors of any
length are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, materialize, mix64
from skein.llm.components import components, forest

COSINE = 0.9
#: Vectors that the quantisers are fitted on at most, and codes per subspace.
SAMPLE, CODES = 16_384, 256
SUBSPACES = 8
#: Vectors in a list (in the mean), lists of a vector, and entries of a codebook at most.
PER_LIST, PROBES, HALF = 64, 6, 4096
#: Entries of a list that one task compares with as many others.
BLOCK = 2048

VALID = "vec_id long, k1 long, k2 long, width int, vector binary"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, width, vector): the usable vectors as doubles, with their checksums."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if key is None or not x or None in x:
                    continue
                v = np.asarray(x, np.float64)
                v = v + 0.0  # -0.0 and 0.0 are one value
                if np.isfinite(v).all() and v.any():
                    bits = mix64(v.view(np.uint64) ^ mix64(np.arange(len(v), dtype=np.uint64)))
                    rows.append((key, int(bits.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix64(bits)).astype(np.int64)), len(v), v.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["vec_id", "k1", "k2", "width", "vector"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, VALID)


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres; starts from evenly spaced rows and refills empty ones from the farthest rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        score = x @ centres.T - 0.5 * (centres**2).sum(1)
        of, best = score.argmax(1), score.max(1)
        n = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]])) / n[full, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(best)[: len(empty)]]
    return centres


class Quantizer:
    """Coarse codebooks of the halves and residual codebooks of the subspaces."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        width = sample.shape[1]
        k = min(len(sample), HALF, max(2, round(math.sqrt(lists))))
        self.halves = [(0, width // 2), (width // 2, width)] if width > 1 else [(0, 1)]
        self.centres = [_k_means(sample[:, a:b], k) for a, b in self.halves]
        self.size = k ** len(self.halves)
        self.probes = min(self.size, PROBES)
        self.cuts = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
        left = sample - self.centre(self.nearest(sample)[:, 0])
        self.books = [_k_means(left[:, a:b], min(CODES, len(left))) for a, b in zip(self.cuts, self.cuts[1:])]

    def centre(self, of) -> np.ndarray:
        """Centres of lists."""
        k = len(self.centres[0])
        places = [np.asarray(of)] if len(self.centres) == 1 else [np.asarray(of) // k, np.asarray(of) % k]
        return np.concatenate([c[p] for c, p in zip(self.centres, places)], axis=-1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lists nearest to each vector, in order: the least sums of both halves' distances
        are among the least of each half."""
        most, first = min(len(self.centres[0]), PROBES), []
        for (a, b), c in zip(self.halves, self.centres):
            far = (c**2).sum(1) - 2 * x[:, a:b] @ c.T
            order = np.argsort(far, axis=1, kind="stable")[:, :most]
            first.append((order, np.take_along_axis(far, order, 1)))
        (lists, far), rest = first[0], first[1:]
        for order, more in rest:
            lists = (lists[:, :, None] * len(self.centres[0]) + order[:, None, :]).reshape(len(x), -1)
            far = (far[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        return np.take_along_axis(lists, np.argsort(far, axis=1, kind="stable")[:, : self.probes], 1)

    def encode(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of the quantisation error, of vectors in lists."""
        left, codes, error = x - self.centre(of), [], np.zeros(len(x))
        for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books):
            part = left[:, a:b]
            code = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            error += ((part - book[code]) ** 2).sum(1)
            codes.append(code.astype(np.uint8))
        return np.stack(codes, 1), np.sqrt(error)

    def squares(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances from queries to the coded vectors of one list."""
        left, out = queries - self.centre(of), np.zeros((len(queries), len(codes)))
        for n, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.books)):
            part = left[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += table[:, codes[:, n]]
        return out


def _compare(quantizer: Quantizer, table: pa.Table, cosine: float) -> list[tuple[int, int, int]]:
    """(representative, links, label) for what two blocks of a list, or one with itself, link."""
    of, low, high = (table.column(c)[0].as_py() for c in ("list", "low", "high"))
    rep = np.array(table.column("rep").to_pylist(), np.int64)
    copies = np.array(table.column("n").to_pylist(), np.int64)
    block = np.array(table.column("block").to_pylist(), np.int64)
    lists = np.array(table.column("lists").to_pylist(), np.int64).reshape(len(rep), -1)
    x = _unit(table.column("vector").to_pylist())
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(rep), -1)
    asking, held = np.flatnonzero(block == low), np.flatnonzero(block == high)
    reach = (math.sqrt(max(0.0, 2 - 2 * cosine)) + np.array(table.column("error").to_pylist())[held] + 1e-6) ** 2
    left, right, links = [], [], np.zeros(len(rep), np.int64)
    for at in range(0, len(asking), 256):
        q = asking[at : at + 256]
        i, j = np.nonzero(quantizer.squares(x[q], of, codes[held]) <= reach)
        i, j = q[i], held[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65_536):  # exact, in double precision
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            ok = ((x[a] * x[b]).sum(1) >= cosine) & (rep[a] != rep[b])
            a, b = a[ok], b[ok]
            common = (lists[a][:, :, None] == lists[b][:, None, :]).any(2)
            first = np.where(common, lists[a], quantizer.size).min(1, initial=quantizer.size) == of
            np.add.at(links, a[first], copies[b[first]])
            np.add.at(links, b[first], copies[a[first]])
            left.append(rep[a])
            right.append(rep[b])
    if not left:
        return []
    out = [(int(rep[a]), int(links[a]), int(rep[a])) for a in np.flatnonzero(links)]
    return out + [(int(v), 0, int(to)) for v, to in zip(*forest(np.concatenate(left), np.concatenate(right))) if v != to]


def _met(classes: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, label) of the classes of one width: counts, and edges that connect links."""
    spark = classes.sparkSession
    total = classes.count()
    share = min(1.0, 0.9 * SAMPLE / total)
    place = F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = classes.filter(place < share).select("rep", "vector").orderBy("rep").limit(SAMPLE).collect() or classes.select("rep", "vector").orderBy("rep").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(Quantizer(_unit([bytes(r["vector"]) for r in rows]), total // PER_LIST))  # codebooks of bounded number

    def encode(batches):
        quantizer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _unit(part.column("vector").to_pylist())
                near = quantizer.nearest(x)
                rows = np.repeat(np.arange(len(x)), near.shape[1])
                codes, error = quantizer.encode(x[rows], near.reshape(-1))
                taken = part.take(pa.array(rows))
                lists = pa.array(near.tolist(), pa.list_(pa.int32())).take(pa.array(rows))
                columns = [pa.array(near.reshape(-1), pa.int32()), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=["rep", "n", "vector", "list", "lists", "codes", "error"])

    index = classes.select("rep", "n", "vector").mapInArrow(encode, "rep long, n long, vector binary, list int, lists array<int>, codes binary, error double")
    index = materialize(index, "index")
    long = materialize(index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "long")
    held = index.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = held.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("blocks", "with")

    def compare(table: pa.Table) -> pa.Table:
        found = _compare(shared.value, table, cosine)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("rep", "links", "label"))})

    return held.groupBy("list", "low", "high").applyInArrow(compare, "rep long, links long, label long")


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    bounded_batches(vectors.sparkSession)
    every = materialize(valid(vectors), "vectors")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    # the checksums tell vectors of different widths apart as well
    classes = materialize(every.groupBy("width", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    widths = [r["width"] for r in classes.groupBy("width").count().filter("count > 1").orderBy("width").collect()]  # a number for each length of vectors
    met = vectors.sparkSession.createDataFrame([], "rep long, links long, label long")
    for width in widths:
        met = met.unionByName(materialize(_met(classes.filter(F.col("width") == width), cosine), "met"))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "rep")
    of = classes.select("width", "k1", "k2", "rep", "n").join(links, "rep", "left").join(found, "rep", "left")
    of = materialize(of.select("width", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "of")
    linked = every.select("vec_id", "width", "k1", "k2").join(of, ["width", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    linked = materialize(linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
