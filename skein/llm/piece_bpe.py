"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score (then by place) and
merges the best pair until none is in the vocabulary; characters that are left over fall
back to bytes. Text is cut where no piece can cross, so a segment's ids don't depend on
what stands around it and frequent segments are encoded once. Each new segment of an
Arrow batch is checked against the sentencepiece library; the library's ids hold if they
ever differ, and the difference is counted.

Edge cases: a null or empty text gives the end id alone and decodes to the empty text;
repeated rows and ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from skein.llm.common import bounded_batches, slices

#: Segments held per worker; when full, the table starts anew. Longer segments aren't held.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 40
#: Segments up to this length are merged together, row by row of a table of agendas.
ROW_CHARS, ROWS = 24, 2000
NORMAL, BYTE, USER = 1, 6, 4

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, mismatches long"


class PieceBpe:
    """Encoder and decoder for one model file (merge-type, identity normaliser)."""

    def __init__(self, model_file: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only merge-type models are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.end = self.library.eos_id()
        numbers = list(range(len(proto.pieces)))  # shared objects: cached tuples stay small
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are cut out before any merge; models with them aren't supported")
        self.pieces = {p.piece: (p.score, numbers[i]) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): numbers[i] for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any("▁" in p.lstrip("▁") for p in self.pieces) or any("\n" in p for p in self.pieces):
            raise ValueError("pieces cross white space")
        self.pieces = {p.replace("▁", " "): x for p, x in self.pieces.items()}  # " " stands for the mark from here on
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.cut = re.compile(" *[^ \n]+| +|\n").findall
        self.decimals = [str(i) for i in numbers]
        self.known: dict[str, tuple[int, ...]] = {}
        self.mismatches = 0
        self._tables()

    def _tables(self) -> None:
        """Numbers for symbols (characters and pieces), and which pair makes which symbol."""
        self.symbol = {c: i for i, c in enumerate(sorted({*self.pieces, *(c for p in self.pieces for c in p)}))}
        pairs = {}
        for p, (score, _) in self.pieces.items():
            for i in range(1, len(p)):
                if p[:i] in self.symbol and p[i:] in self.symbol:
                    pairs[self.symbol[p[:i]] << 32 | self.symbol[p[i:]]] = (score, self.symbol[p])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_scores = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.float64)
        self.pair_makes = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        self.symbol_ids = [self._ids(x) for x in self.symbol]
        self.plain_id = np.array([x[0] if len(x) == 1 else -1 for x in self.symbol_ids], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        self.characters = frozenset(x for x in self.symbol if len(x) == 1)
        for c in self.characters:
            self.of_char[ord(c)] = self.symbol[c]

    def _ids(self, symbol: str) -> list[int]:
        """A piece's id; for other characters the ids of their bytes."""
        found = self.pieces.get(symbol)
        return [found[1]] if found else [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and results of pairs; -inf where they make no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (right >= 0)
        return np.where(hit, self.pair_scores[at], -np.inf), np.where(hit, self.pair_makes[at], -1)

    def merge_rows(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of many short segments: each row holds a segment's agenda, and every round
        merges each row's best pair (the leftmost of equals)."""
        sizes = np.array([len(s) for s in segments])
        n, width = len(segments), int(sizes.max()) + 1
        table = np.full((n, width), -1, np.int32)
        table[np.arange(width) < sizes[:, None]] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        scores, makes = self._pairs(table[:, :-1], table[:, 1:])
        live, columns = np.arange(n), np.arange(width)
        held, done = table, np.empty((n, width), np.int32)
        while len(live):
            best = scores.argmax(1)
            row = np.arange(len(live))
            on = scores[row, best] > -np.inf
            done[live[~on]] = held[~on]
            live, held, scores, makes, best = live[on], held[on], scores[on], makes[on], best[on]
            if not len(live):
                break
            row = np.arange(len(live))
            held[row, best] = makes[row, best]
            held = np.take_along_axis(held, np.minimum(columns + (columns > best[:, None]), width - 1), 1)
            moved = np.minimum(columns[:-1] + (columns[:-1] >= best[:, None]), width - 2)
            scores, makes = np.take_along_axis(scores, moved, 1), np.take_along_axis(makes, moved, 1)
            for at in (best, best - 1):
                ok = (at >= 0) & (at < width - 1)
                r, c = row[ok], at[ok]
                scores[r, c], makes[r, c] = self._pairs(held[r, c], held[r, c + 1])
        counts, plain = (done >= 0).sum(1).tolist(), self.plain_id[done]
        out = [tuple(r[:k]) for r, k in zip(plain.tolist(), counts)]
        for i in np.flatnonzero(((plain < 0) & (done >= 0)).any(1)).tolist():  # characters that fall back to bytes
            out[i] = tuple([x for s in done[i, : counts[i]].tolist() for x in self.symbol_ids[s]])
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda of adjacent pairs."""
        pieces, symbols = self.pieces, list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if found := pieces.get(symbols[i] + symbols[i + 1]):
                agenda.append((-found[0], i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if after[left] != right or len(symbols[left]) + len(symbols[right]) != len(piece) or not symbols[left]:
                continue  # one of the two has been merged elsewhere meanwhile
            symbols[left], symbols[right] = piece, ""
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                if found := pieces.get(both := piece + symbols[beyond]):
                    heapq.heappush(agenda, (-found[0], left, beyond, both))
            if (earlier := before[left]) >= 0 and (found := pieces.get(both := symbols[earlier] + piece)):
                heapq.heappush(agenda, (-found[0], earlier, left, both))
        return [i for symbol in symbols if symbol for i in self._ids(symbol)]

    def segments(self, text: str) -> list[str]:
        return self.cut(self.prefix + text.replace("▁", " ")) if text else []

    def _by_library(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of segments, each on its own. It sets the prefix before a text,
        so a segment that doesn't start with one goes behind a line feed."""
        bare = [not (self.prefix and s.startswith(self.prefix)) for s in segments]
        lead = len(self.library.encode("\n"))
        got = self.library.encode(["\n" + s if b else s[1:] for s, b in zip(segments, bare)], num_threads=1)
        return [ids[lead:] if b else ids for ids, b in zip(got, bare)]

    def learn(self, segments: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodes new segments and checks them against the library in one call."""
        known = self.characters.issuperset
        # rows of one length waste no width
        short = sorted((s for s in segments if len(s) <= ROW_CHARS and known(s)), key=len)
        out = {}
        for at in range(0, len(short), ROWS):
            out.update(zip(short[at : at + ROWS], self.merge_rows(short[at : at + ROWS])))
        for s in segments.difference(out):
            out[s] = tuple(self.merge(s))
        # the prefix alone is the one segment that the library can't be given on its own
        checked = [s for s in out if s != self.prefix]
        for s, theirs in zip(checked, self._by_library(checked)):
            if out[s] != (theirs := tuple(theirs)):
                self.mismatches += 1
                out[s] = theirs
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, with the end id."""
        cut = [self.segments(t) if t else [] for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        table, collects = self.known, gc.isenabled()
        gc.disable()  # the many small tuples make no cycles
        try:
            new = set(chain.from_iterable(cut)).difference(table)
            if new:
                table.update(self.learn(new))
            out = [[*chain.from_iterable(map(table.__getitem__, segments)), self.end] for segments in cut]
            for s in new:
                if len(s) > CACHE_CHARS:
                    del table[s]
        finally:
            if collects:
                gc.enable()
        return iter(out)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_LOADED: dict[str, PieceBpe] = {}


def loaded(model_file: str) -> PieceBpe:
    """One encoder per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceBpe(model_file)
    return _LOADED[model_file]


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's ``key`` and token ids (``ids`` array<int>, with the end id)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = loaded(model_file)
        for batch in batches:
            for part in slices(batch, text):
                ids = list(bpe.encode_batch(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str, key: str = "doc_id") -> DataFrame:
    """Every row's ``key`` and the text that its ``ids`` decode to."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        bpe = loaded(model_file)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def digest_documents(docs: DataFrame, model_file: str, surface: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; returns ids' and decoded texts' digests. With
    ``surface`` one more column, ``mismatches``: how many new segments' agendas the library's
    check corrected, on the first row of each slice (0 everywhere but for a fault)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids_sha, texts_sha, was = [], [], [], bpe.mismatches
                for ids in bpe.encode_batch(part.column("text").to_pylist()):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                    texts_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                wrong = [bpe.mismatches - was] + [0] * (len(counts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(texts_sha), pa.array(wrong, pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mismatches"],
                )

    out = docs.select("doc_id", "text").mapInArrow(run, RESULT)
    return out if surface else out.drop("mismatches")
