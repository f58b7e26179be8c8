"""Vectors of texts, from an encoder that plugs in.

An encoder is made once in each worker process, so a model is loaded as often as there are
workers; texts go through it in small batches. Vectors are float32 of length 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MADE: dict[str, object] = {}


@dataclass(frozen=True)
class Encoder:
    """A model by name. make: a callable that loads it (called with ``device``) and returns
    ``texts -> rows of numbers``; None: there is no model, and vectors are zeros.

    ``devices`` are tried in order, the next one where making or a batch runs out of memory.
    Queries get ``prompt`` in front; texts are cut to ``most_words`` words."""

    name: str
    dimension: int
    make: Callable[[str], Callable[[Sequence[str]], Sequence[Sequence[float]]]] | None = None
    batch: int = 8
    prompt: str = ""
    most_words: int = 1024
    devices: tuple[str, ...] = ("cpu",)

    @property
    def available(self) -> bool:
        return self.make is not None

    def _run(self, texts: list[str]) -> np.ndarray:
        """The model's rows; on the first device that has the memory."""
        for n, device in enumerate(self.devices):
            key = f"{self.name}@{device}"
            try:
                if key not in _MADE:
                    _MADE[key] = self.make(device)
                return np.asarray(_MADE[key](texts), np.float32).reshape(len(texts), -1)
            except MemoryError:
                _MADE.pop(key, None)
                if n + 1 == len(self.devices):
                    raise
        raise ValueError("no devices")

    def encode(self, texts: Sequence[str | None], query: bool = False) -> np.ndarray:
        """Unit vectors, a row a text (zeros for a text that the model gives zeros, or without a
        model)."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        if not self.available:
            return out
        head = self.prompt if query else ""
        whole = [head + " ".join((t or "").split()[: self.most_words]) for t in texts]
        for at in range(0, len(whole), self.batch):
            rows = self._run(whole[at : at + self.batch])
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            out[at : at + len(rows)] = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
        return out

    def _column(self, query: bool):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(self.encode(texts.tolist(), query)))

        return F.pandas_udf(run, "array<float>")

    def documents(self, chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
        """(key, embedding) of every text."""
        return chunks.select(key, self._column(False)(text).alias("embedding"))

    def queries(self, asked: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
        return asked.select(key, self._column(True)(text).alias("embedding"))


@dataclass(frozen=True)
class Reranker:
    """A model that scores (question, text) pairs, plugged in like an encoder. Without one,
    ``column`` is None and results are reranked by their words."""

    name: str
    make: Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[float]]] | None = None
    batch: int = 8

    @property
    def available(self) -> bool:
        return self.make is not None

    @property
    def column(self):
        """Column function of (query, text) for ``retrieval.rerank``."""
        if not self.available:
            return None

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for query, text in batches:
                if self.name not in _MADE:
                    _MADE[self.name] = self.make()
                pairs, out = list(zip(query, text)), []
                for at in range(0, len(pairs), self.batch):
                    out += [float(x) for x in _MADE[self.name](pairs[at : at + self.batch])]
                yield pd.Series(out, dtype=float)

        return F.pandas_udf(run, "double")
