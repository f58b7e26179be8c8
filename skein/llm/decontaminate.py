"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item gets a 64-bit SimHash of its word pairs. Documents are read in windows
of exactly an item's number of words, at every word. A window's fingerprint is looked up in
four 16-bit blocks: two fingerprints within ``RADIUS`` differ by at most RADIUS // 4 bits in
one of the blocks, so tables of all block values within that many bits of an item's block
return every item within the radius. Candidates are verified exactly: weighted Jaccard of
the window's and the item's word shingles (five words), of which ``THRESHOLD`` must be
reached; a shingle weighs more the fewer items hold it. A window that shares no shingle
with any item has similarity 0, so fingerprints are made only where one does.

A shingle that the item doesn't hold weighs most, so a similarity doesn't depend on how the
benchmark is cut. The benchmark is the query set: it is taken in blocks of bounded size, each
broadcast and met with all documents; lookup tables are made as windows ask for them and
``TABLE_BYTES`` of them are kept.

Edge cases: null and empty texts and items match nothing; an item or text shorter than five
words is one shingle; a document shorter than an item is one window of it; of windows with
equal similarity (ties) the first is reported; repeated items and rows are each reported,
and ``drop_contaminated`` judges each row by its own text, whatever its id; very long texts
are read whole, in runs of windows; an empty table on either side gives an empty result;
other columns are ignored (all are kept by ``drop_contaminated``).
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, gram_hashes, materialize, shingle_hashes, slices, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 20, 4, 16
#: Items and their text bytes in one broadcast.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Items of one multi-index, and bytes of lookup tables that a worker keeps.
CLASS_ITEMS, TABLE_BYTES = 512, 48 << 20

#: Windows in one run of fingerprints.
RUN = 4096

HITS = "doc_id long, item_id long, similarity double, first_word long"


def _pairs(words: np.ndarray) -> np.ndarray:
    """The features of a run of words: its adjacent pairs (a single word is its own)."""
    return gram_hashes(words, 2) if len(words) > 1 else words


def fingerprints(features: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """SimHashes of the windows of ``size`` features that begin at ``at``."""
    low, high = int(at.min()), int(at.max()) + size
    bits = np.unpackbits(np.ascontiguousarray(features[low:high]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    ones = sums[at - low + size] - sums[at - low]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").reshape(-1)


def _near_values(bits: int, distance: int) -> np.ndarray:
    """Masks that flip at most ``distance`` of ``bits`` bits."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= distance]


_MASKS = _near_values(BLOCK_BITS, RADIUS // BLOCKS)


class _Class:
    """Items of one size, with their multi-index: for each block and block value, a bit for
    each item within the block's radius."""

    def __init__(self, size: int, items: list[int], prints: list[int]) -> None:
        self.size, self.items = size, items
        self.prints = np.array(prints, np.uint64)
        kind = np.dtype(f"u{max(1, 1 << (min(64, len(items)) - 1).bit_length() >> 3)}")
        bits = 8 * kind.itemsize
        self.tables = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(items) // bits)), kind)
        for n, p in enumerate(prints):
            for b in range(BLOCKS):
                value = (p >> (BLOCK_BITS * b)) & ((1 << BLOCK_BITS) - 1)
                self.tables[b, _MASKS ^ np.uint32(value), n // bits] |= kind.type(1 << (n % bits))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) numbers of all pairs within the radius."""
        seen = np.zeros((len(prints), self.tables.shape[2]), self.tables.dtype)
        for b in range(BLOCKS):
            seen |= self.tables[b, (prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)]
        on = np.unpackbits(seen.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
        window, item = np.nonzero(on)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]


class Index:
    """A block of the benchmark: shingles, their weights, and fingerprints by size. rows: id,
    text, and how many of all ``total`` items hold each of its shingles."""

    def __init__(self, rows: list[tuple[int, str, dict[int, int]]], total: int) -> None:
        words, edges = word_hashes([r[1] for r in rows])
        self.ids = [r[0] for r in rows]
        self.unseen = 1 + float(np.log(max(1, total)))
        self.bags, by_size = [], defaultdict(list)
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            own, times = np.unique(shingle_hashes(words[a:b], SHINGLE), return_counts=True)
            held = rows[n][2]
            weight = np.array([self.unseen - np.log(held[s]) for s in own.view(np.int64).tolist()])
            self.bags.append((own, times, weight, float((weight * times).sum())))
            if b > a:
                f = _pairs(words[a:b])
                by_size[int(b - a)].append((n, int(fingerprints(f, len(f), np.array([0]))[0])))
        # classes of one size and a bounded number of items
        self.classes = [(size, [n for n, _ in x[i : i + CLASS_ITEMS]], [p for _, p in x[i : i + CLASS_ITEMS]]) for size, x in sorted(by_size.items()) for i in range(0, len(x), CLASS_ITEMS)]
        # for each width (items shorter than five words have a narrower one): shingles, and the
        # classes whose items hold them
        self.shingles = {}
        for width in {min(size, SHINGLE) for size, *_ in self.classes}:
            pairs = [np.stack([bag := np.unique(np.concatenate([self.bags[n][0] for n in items])), np.full(len(bag), k, np.uint64)]) for k, (size, items, _) in enumerate(self.classes) if min(size, SHINGLE) == width]
            known, of = np.concatenate(pairs, axis=1)
            order = np.argsort(known, kind="stable")
            known, starts = np.unique(known[order], return_index=True)
            self.shingles[width] = (known, np.append(starts, len(order)), of[order].astype(np.int64))
        self.tables: OrderedDict[int, _Class] = OrderedDict()

    def similarity(self, grams: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's bag of shingles and an item's."""
        own, times, weight, all_ = self.bags[item]
        seen, n = np.unique(grams, return_counts=True)
        at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
        held = own[at] == seen
        w, t, m = weight[at[held]], times[at[held]], n[held]
        either = all_ + float((w * np.maximum(0, m - t)).sum()) + self.unseen * float(n[~held].sum())
        return float((w * np.minimum(t, m)).sum()) / either if either else 0.0

    def _table(self, k: int) -> _Class:
        if k not in self.tables:  # made on the executors, not sent to them
            self.tables[k] = _Class(*self.classes[k])
            while len(self.tables) > 1 and sum(x.tables.nbytes for x in self.tables.values()) > TABLE_BYTES:
                self.tables.popitem(last=False)
        self.tables.move_to_end(k)
        return self.tables[k]

    def _hits(self, words: np.ndarray):
        """(class, shingles of the document, places of those that the class's items hold)."""
        for width, (known, starts, of) in self.shingles.items():
            grams = gram_hashes(words, width)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            places = np.flatnonzero(known[at] == grams)
            if len(places):
                counts = starts[at[places] + 1] - starts[at[places]]
                first = np.repeat(starts[at[places]] - np.cumsum(counts) + counts, counts)
                classes, places = of[first + np.arange(len(first))], np.repeat(places, counts)
                for k in np.unique(classes).tolist():
                    yield k, grams, places[classes == k]

    def scan(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best (similarity, first word) of each item that a document's windows match."""
        best: dict[int, tuple[float, int]] = {}
        features = None
        for k, grams, hits in self._hits(words):
            size = self.classes[k][0]
            features = _pairs(words) if features is None else features
            span = max(1, size - SHINGLE + 1)
            if len(words) <= size:  # the whole document is the window
                starts, prints = np.array([0]), fingerprints(features, len(features), np.array([0]))
            else:
                # windows that hold one of the shingles found
                near = np.zeros(len(words) + span + 1, np.int32)
                np.add.at(near, np.maximum(hits - span + 1, 0), 1)
                np.add.at(near, hits + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[: len(words) - size + 1] > 0)
                if not len(starts):
                    continue
                if size == 1:
                    prints = fingerprints(words, 1, starts)
                else:
                    # in runs, so that memory doesn't follow the distance between them
                    runs = np.split(starts, np.flatnonzero((np.diff(starts) > size) | (np.arange(1, len(starts)) % RUN == 0)) + 1)
                    prints = np.concatenate([fingerprints(features, size - 1, x) for x in runs])
            items = self.classes[k][1]
            for window, item in zip(*self._table(k).lookup(prints)):
                n, first = items[item], int(starts[window])
                found = self.similarity(grams[first : first + span], n)
                if found >= THRESHOLD and found > best.get(n, (0.0, 0))[0]:
                    best[n] = (found, first)
        return best


def _held(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, shingles, holders) and the number of items: how many items hold each
    shingle is counted over the whole benchmark."""
    bounded_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "items")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, edges = word_hashes(part.column("text").to_pylist())
                sets = [np.unique(shingle_hashes(words[a:b], SHINGLE)) for a, b in zip(edges, edges[1:])]
                at = pa.array(np.repeat(np.asarray(part.column("row")), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate(sets).view(np.int64))], names=["row", "shingle"])

    pairs = materialize(rows.select("row", "text").mapInArrow(run, "row long, shingle long"), "shingles")
    holders = pairs.groupBy("shingle").agg(F.count("*").alias("holders"))
    lists = pairs.join(holders, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "holders")).alias("x"))
    return rows.join(lists, "row", "left").select("item_id", "text", "row", F.col("x.shingle").alias("shingles"), F.col("x.holders").alias("holders")), rows.count()


def _indexes(items: DataFrame):
    """The benchmark's index in blocks of bounded size, in order of id."""
    held, total = _held(items)
    block, size = [], 0
    for row in held.orderBy("item_id", "text", "row").toLocalIterator():
        block.append((row["item_id"], row["text"], dict(zip(row["shingles"] or (), row["holders"] or ()))))
        size += len(row["text"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Index(block, total)
            block, size = [], 0
    if block:
        yield Index(block, total)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): a row for each document and item that one
    of the document's windows matches, with its best window."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searcher(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    words, edges = word_hashes(part.column("text").to_pylist())
                    rows = []
                    for key, a, b in zip(part.column("doc_id").to_pylist(), edges, edges[1:]):
                        for n, (found, first) in index.scan(words[a:b]).items():
                            rows.append((key, index.ids[n], found, first))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "item_id", "similarity", "first_word"])

        return run

    out = spark.createDataFrame([], HITS)
    for index in _indexes(items):
        out = out.unionByName(docs.mapInArrow(searcher(spark.sparkContext.broadcast(index)), HITS))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text matches no item, in one pass without a shuffle (and one
    more for each further block of the benchmark)."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def judge(shared):
        def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value
            for batch in texts:
                out = []
                for part in slices(pa.RecordBatch.from_arrays([pa.array(batch, pa.string(), from_pandas=True)], names=["text"]), "text"):
                    words, edges = word_hashes(part.column("text").to_pylist())
                    out += [not index.scan(words[a:b]) for a, b in zip(edges, edges[1:])]
                yield pd.Series(out, dtype=bool)

        return F.pandas_udf(clean, "boolean")

    for n, index in enumerate(_indexes(items)):
        docs = materialize(docs, "clean") if n else docs
        docs = docs.filter(judge(spark.sparkContext.broadcast(index))("text"))
    return docs
