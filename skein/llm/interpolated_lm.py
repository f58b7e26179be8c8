"""Language-model scoring with deleted interpolation.

Maximum-likelihood estimates of orders n to 1 and a uniform floor are mixed; the weights
depend on how often the longest known context occurred (frequency buckets) and are learned
by expectation-maximisation on deleted counts: every training token is predicted from the
counts of all the others, so the whole training corpus serves as held-out data.

How it runs. Documents are packed into blocks of a few MB and written once. Each block
sends its distinct n-grams (hashes, with its training counts) to n-gram parts, dealt by the
hashes' leading bits, where counts are added up and sent back in the same order; a block
rebuilds the order from its texts. A block sends to ``FAN`` parts an order at most, and a
part hears ``FAN`` senders at most: with more blocks than that, parts add up what a group of
blocks sends and pass it on to parts of the next level, by the next bits. So messages follow
the number of blocks (times the levels, which grow as its logarithm), and what a task holds
is about a block's n-grams at any size. Frequent n-grams cost one entry per sender, so they
make no hot key, and nothing but the weights, two totals and a histogram of fixed
resolution reaches the driver.

Tokens are words (runs without ``\\x20``, ``\\x09-\\x0D``; A-Z lower-cased) and one end;
n-grams of an order are told apart by 56-bit hashes.

Edge cases: a null or empty text is the end alone; null ids count as the empty id text;
repeated rows count each; a very long text is hashed in its block, alone if it fills one;
equal frequencies (ties) fall into one bucket; without training rows N = V = 0 and every score is 0; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SLICE_BYTES, bounded_batches, fold, materialize, mix64, slices, word_hashes

ORDER = 3
#: Text bytes in a block, and leading bits that deal its n-grams out: 256 parts an order.
BLOCK_BYTES, FAN_BITS = 5 << 20, 8
END, BEGIN = np.uint64(0x0E2D), np.uint64(0xBE61)
#: Frequency buckets per order; log2 steps of the histogram that the weights are fitted on.
BUCKETS, STEP = 12, 2.0
ADD = 0.1

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- blocks --------------------------------------------------------------------


def _packed(ids: list, held: list, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts, pa.string())], names=["id", "held", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _unpacked(payload: bytes) -> tuple[list, np.ndarray, list]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
    return table.column("id").to_pylist(), np.array(table.column("held").to_pylist(), bool), table.column("text").to_pylist()


def blocks(docs: DataFrame) -> DataFrame:
    """(block, size, payload): runs of documents as they stand, written to the shared folder."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for i, h, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                    ids.append(i), held.append(h), texts.append(t)
                    size += len(t or "") + 8
                if size >= BLOCK_BYTES:
                    yield pa.record_batch([pa.array([size]), pa.array([_packed(ids, held, texts)])], names=["size", "payload"])
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pa.record_batch([pa.array([size]), pa.array([_packed(ids, held, texts)])], names=["size", "payload"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), "text")
    packed = rows.mapInArrow(run, "size long, payload binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "size", "payload"), "blocks")


# --- n-grams of a block ----------------------------------------------------------


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's documents, each with its end, and the documents' offsets."""
    out, sizes, at = [], [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < SLICE_BYTES):
            size += len(texts[stop] or "")
            stop += 1
        h, edges = word_hashes(texts[at:stop])
        for a, b in zip(edges, edges[1:]):
            out += [h[a:b], np.array([END])]
            sizes.append(b - a + 1)
        at = stop
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def _grams(tokens: np.ndarray, edges: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the 56-bit hash of the n-gram that ends at each token (padded with
    begins)."""
    starts = np.repeat(edges[:-1], np.diff(edges))
    place = np.arange(len(tokens))
    out = []
    h = mix64(tokens)
    for n in range(1, order + 1):
        if n > 1:
            back = place - (n - 1)
            word = np.where(back >= starts, tokens[np.maximum(back, 0)], BEGIN)
            h = mix64(h ^ mix64(word + np.uint64(n)))
        out.append(h & ~np.uint64(255))
    return out


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _whole(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


_MESSAGE = "part long, team long, sender long, keys binary, counts binary"
_ANSWER = "receiver long, part long, data binary, words long, total long"


def _dealt(n: int, keys: np.ndarray, counts: np.ndarray, shift: int, team: int, sender: int):
    """Messages to the parts that the keys belong to. A part is an order and the top bits of its
    n-grams' hashes, so parts in order are n-grams in order."""
    part = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    ends = list(zip([0, *cuts], [*cuts, len(keys)])) if len(keys) else []
    yield pa.record_batch(
        [
            pa.array([n << (64 - shift) | int(part[a]) for a, _ in ends], pa.int64()),
            pa.array([team] * len(ends), pa.int64()),
            pa.array([sender] * len(ends), pa.int64()),
            pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in ends], pa.binary()),
            pa.array([_planes(counts[a:b]) for a, b in ends], pa.binary()),
        ],
        names=["part", "team", "sender", "keys", "counts"],
    )


def _requests(block: int, payload: bytes, order: int, bits: int, teams: int):
    """The messages of a block, which belongs to a team by a hash of its number."""
    _, held, texts = _unpacked(payload)
    tokens, edges = _tokens(texts)
    training = np.repeat(~held, np.diff(edges))
    for n, g in enumerate(_grams(tokens, edges, order), 1):
        keys, place = np.unique(g, return_inverse=True)
        counts = np.bincount(place, weights=training, minlength=len(keys)).astype("<u8")
        yield from _dealt(n, keys, counts, 64 - bits, int(mix64(np.array([block], np.uint64))[0] % np.uint64(teams)), block)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a part's messages, their sums, the place of each message's n-grams
    among them, and where each message ends."""
    keys = [np.cumsum(_whole(k, "<u8"), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_whole(c, "<u8") for c in table.column("counts").to_pylist()])
    return every, np.bincount(place, weights=counts, minlength=len(every)).astype("<u8"), place, np.cumsum([0, *map(len, keys)])


def _answers(table: pa.Table, total: np.ndarray, place: np.ndarray, edges: np.ndarray, words: int, tokens: int) -> pa.Table:
    """Total counts in each sender's order. One more row, to no receiver, has the distinct and
    all training tokens of a part of order 1."""
    part, senders = table.column("part")[0].as_py(), table.column("sender").to_pylist()
    data = [_planes(total[place[a:b]]) for a, b in zip(edges, edges[1:])]
    zeros = [0] * len(senders)
    return pa.table({"receiver": pa.array([*senders, None], pa.int64()), "part": pa.array([part] * (len(senders) + 1), pa.int64()), "data": pa.array([*data, None], pa.binary()), "words": pa.array([*zeros, words], pa.int64()), "total": pa.array([*zeros, tokens], pa.int64())})


def _summed(messages: DataFrame, teams: int, level: int, bits: int) -> DataFrame:
    """The answers to the messages of so many teams, of about ``1 << bits`` senders each."""
    if teams == 1:

        def answer(table: pa.Table) -> pa.Table:
            _, total, place, edges = _added(table)
            first = table.column("part")[0].as_py() >> (level * bits) == 1
            return _answers(table, total, place, edges, int((total > 0).sum()) if first else 0, int(total.sum()) if first else 0)

        return materialize(messages.groupBy("part").applyInArrow(answer, _ANSWER), "counts")

    above_teams = -(-teams >> bits)

    def name(part: int, team: int) -> int:
        return part << 26 | team

    def merge(table: pa.Table) -> pa.Table:
        every, sums, _, _ = _added(table)
        part, team = table.column("part")[0].as_py(), table.column("team")[0].as_py()
        return pa.Table.from_batches(list(_dealt(part >> (level * bits), every, sums, 64 - (level + 1) * bits, team % above_teams, name(part, team))))

    onward = materialize(messages.groupBy("part", "team").applyInArrow(merge, _MESSAGE), "requests")
    above = _summed(onward, above_teams, level + 1, bits)
    back = above.filter("receiver is not null").select(F.shiftright("receiver", 26).alias("part"), F.col("receiver").bitwiseAND((1 << 26) - 1).alias("team"), F.lit(None).cast("long").alias("sender"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), F.col("part").alias("finer"), "data")
    own = messages.withColumns({"finer": F.lit(None).cast("long"), "data": F.lit(None).cast("binary")})

    def hand_down(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_valid(table.column("sender")))
        got = sorted(zip(*(table.filter(pc.is_null(table.column("sender"))).column(c).to_pylist() for c in ("finer", "data"))))
        _, _, place, edges = _added(asked)
        return _answers(asked, np.concatenate([_whole(d, "<u8") for _, d in got]), place, edges, 0, 0)

    down = own.unionByName(back).groupBy("part", "team").applyInArrow(hand_down, _ANSWER).filter("receiver is not null")
    return materialize(down.unionByName(above.filter("receiver is null")), "counts")


class _Counts:
    """Counts of a block's tokens: for each order the n-gram's and its context's."""

    def __init__(self, payload: bytes, answers: list[tuple[int, bytes]], order: int, total: int, documents: int) -> None:
        self.ids, self.held, texts = _unpacked(payload)
        tokens, self.edges = _tokens(texts)
        known = np.concatenate([_whole(d, "<u8") for _, d in sorted(answers)]).astype(np.float64)
        self.grams, at = [], 0
        for g in _grams(tokens, self.edges, order):
            keys, place = np.unique(g, return_inverse=True)
            self.grams.append(known[at : at + len(keys)][place])
            at += len(keys)
        first = np.zeros(len(tokens), bool)
        first[self.edges[:-1]] = True
        self.contexts = [np.full(len(tokens), float(total))]
        for n in range(1, order):
            # the context of order n + 1 is the n-gram that ends one token before
            before = np.concatenate([[0.0], self.grams[n - 1][:-1]])
            self.contexts.append(np.where(first, float(documents), before))


def _buckets(contexts: list[np.ndarray]) -> np.ndarray:
    """Bucket of each token: the longest context that occurred, and the log2 of how often."""
    bucket = np.zeros(len(contexts[0]), np.int64)
    for n in range(1, len(contexts)):
        size = np.minimum(np.log2(np.maximum(contexts[n], 1)).astype(np.int64), BUCKETS - 1)
        bucket = np.where(contexts[n] > 0, n * BUCKETS + size, bucket)
    return bucket


def _shares(grams: list[np.ndarray], contexts: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Estimates of the uniform floor and of each order, a column each."""
    out = [np.full(len(grams[0]), 1.0 / (vocabulary + 1))]
    for g, c in zip(grams, contexts):
        out.append(np.divide(g, c, out=np.zeros_like(g), where=c > 0))
    return np.stack(out, 1)


# --- weights -----------------------------------------------------------------------


def fit_weights(cells: np.ndarray, counts: np.ndarray, bucket: np.ndarray, order: int, vocabulary: int, rounds: int = 40) -> np.ndarray:
    """Mixture weights per bucket by expectation-maximisation. cells: each row the quantised
    estimates of orders 1 to n (-1: zero)."""
    weights = np.full((order * BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(cells):
        return weights
    shares = np.hstack([np.full((len(cells), 1), 1.0 / (vocabulary + 1)), np.where(cells < 0, 0.0, np.exp2(-cells / STEP))])
    for _ in range(rounds):
        mixed = weights[bucket] * shares
        mixed *= (counts / mixed.sum(1))[:, None]
        for j in range(order + 1):
            # a little of every weight stays, so no token gets probability 0
            weights[:, j] = np.bincount(bucket, weights=mixed[:, j], minlength=len(weights)) + (1e-3 if j == 0 else 1e-6)
        weights /= weights.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores every whole text by the model learned from the rows outside the held-out tenth."""
    packed = blocks(docs)
    teams = max(1, -(-packed.count() >> FAN_BITS))
    documents = docs.filter(fold() != 0).count()

    def request(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _requests(row["block"], row["payload"], order, FAN_BITS, teams)

    asked = packed.select("block", "payload").mapInArrow(request, _MESSAGE)
    answers = _summed(asked, teams, 1, FAN_BITS)
    sums = answers.agg(F.sum("words"), F.sum("total")).first()
    vocabulary, total = sums[0] or 0, sums[1] or 0

    both = packed.select("block", F.lit(-1).alias("part"), F.col("payload").alias("data")).unionByName(answers.filter("receiver is not null").select(F.col("receiver").alias("block"), "part", "data"))

    def counted(table: pa.Table) -> _Counts:
        parts = dict(zip(table.column("part").to_pylist(), table.column("data").to_pylist()))
        payload = parts.pop(-1)
        return _Counts(payload, list(parts.items()), order, total, documents)

    def histogram(table: pa.Table) -> pa.Table:
        c = counted(table)
        mine = np.repeat(~c.held, np.diff(c.edges))
        grams = [np.maximum(g[mine] - 1, 0) for g in c.grams]  # all other tokens' counts
        contexts = [np.maximum(x[mine] - 1, 0) for x in c.contexts]
        shares = _shares(grams, contexts, vocabulary)[:, 1:]
        cells = np.where(shares > 0, np.round(-np.log2(np.maximum(shares, 1e-30)) * STEP), -1).astype(np.int64)
        key = _buckets(contexts)
        for n in range(order):
            key = key * 256 + cells[:, n] + 1
        keys, counts = np.unique(key, return_counts=True)
        return pa.table({"cell": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())})

    rows = both.groupBy("block").applyInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    key, cells = rows["cell"].to_numpy(np.int64), []
    for _ in range(order):
        cells.insert(0, key % 256 - 1)
        key = key // 256
    weights = fit_weights(np.stack(cells, 1) if len(key) else np.zeros((0, order)), rows["n"].to_numpy(np.float64), key, order, vocabulary)

    def scored(table: pa.Table) -> pa.Table:
        c = counted(table)
        shares = _shares(c.grams, c.contexts, vocabulary)
        p = (weights[_buckets(c.contexts)] * shares).sum(1)
        base = np.log10((c.grams[0] + ADD) / (total + ADD * (vocabulary + 1)))
        at, n = c.edges[:-1], np.diff(c.edges)
        known = np.add.reduceat((c.grams[0] > 0).astype(np.int64), at)
        columns = [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.groupBy("block").applyInArrow(scored, RESULT)
