"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines
separate the languages within it. Both steps vote over pairwise machines on hashed byte
n-grams (1 to 3) of the lower-cased letters, square-rooted relative frequencies of the
whole text. Training uses a bounded sample of labelled rows (``per_language``, chosen by a
hash of the id); nothing but the text enters a prediction.

Edge cases: a text that is null, empty or has no letter gives ``und`` with score 0, and so
does every text if there is nothing to learn from; with one learned language all others
give it. Rows whose lang is null aren't learned from. Repeated rows are predicted alike;
other columns are ignored. Ties go to the class whose name comes first; very long texts are
read whole. ``keep_identified`` goes by the prediction: it drops what isn't predicted to be one
of the wanted languages, and what the machines can't tell (a score under ``FLOOR``) since it is
unlike all texts that they learned from (a cosine with their mean under ``NEAR``; texts in two
learned languages are hard to tell, too, but near). Texts of fewer than ``SHORT`` letters hold
too few n-grams for that and go by the language only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, doc_key, fold, slices

BINS = 4096
#: Labelled rows per language that training may use at most, in the mean of the hash.
PER_LANGUAGE = 400
#: Languages by family (fixed values, ISO 639-1); a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne"),
}
UNKNOWN = "und"
#: Score and nearness under which ``keep_identified`` takes a text for none of the learned
#: languages, and letters that this takes.
FLOOR, NEAR, SHORT = 0.5, 0.3, 20
_LETTER = regex.compile(r"\p{L}").search
#: Bytes that stay: a-z and all of other scripts' bytes; the rest become one space.
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def family_of(lang: str) -> str:
    """The family's name, or the language itself if it is in none."""
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram frequencies; their squares sum to 1."""
    b = _KEEP[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)  # runs of spaces become one
    x = b[keep].astype(np.uint32)
    two = x[:-1] * np.uint32(256) + x[1:]
    three = two[:-1] * np.uint32(256) + x[2:]
    n = np.zeros(BINS)
    for grams, by in ((x, 2654435761), (two, 2246822519), (three, 3266489917)):
        n += np.bincount((grams * np.uint32(by)) >> np.uint32(20), minlength=BINS)
    return np.sqrt(n / n.sum())


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """A linear machine (weights and bias) with squared hinge loss, by accelerated descent.
    y: 1 or -1; both sides weigh the same."""
    x = np.hstack([x, np.full((len(x), 1), 0.5)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.35
    for t in range(1, steps + 1):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (penalty * v - 2 * x.T @ (weight * y * gap))
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


class _Vote:
    """One-versus-one machines over classes; scores are mean pairwise probabilities."""

    def __init__(self, x: np.ndarray, of: np.ndarray) -> None:
        self.classes = sorted(set(of.tolist()))
        k = len(self.classes)
        self.pairs = [(i, j) for i in range(k) for j in range(i)]
        machines = []
        for i, j in self.pairs:
            rows = (of == self.classes[i]) | (of == self.classes[j])
            machines.append(_machine(x[rows], np.where(of[rows] == self.classes[i], 1.0, -1.0)))
        self.weights = np.array(machines).T if machines else np.zeros((x.shape[1] + 1, 0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1.0
        chance = 1 / (1 + np.exp(-np.clip(3.0 * (x @ self.weights[:-1] + 0.5 * self.weights[-1]), -40, 40)))
        for n, (i, j) in enumerate(self.pairs):
            out[:, i] += chance[:, n]
            out[:, j] += 1 - chance[:, n]
        return out / (len(self.classes) - 1)


class Model:
    """Families' votes, then the languages' votes within the family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        of, families = np.array(langs, object), np.array([family_of(x) for x in langs], object)
        self.family = _Vote(x, families) if langs else None
        self.within = {f: _Vote(x[families == f], of[families == f]) for f in self.family.classes} if langs else {}
        mean = x.mean(0) if langs else np.ones(x.shape[1])
        self.mean = mean / np.linalg.norm(mean)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        if self.family is None or not len(x):
            return [(UNKNOWN, 0.0)] * len(x)
        score, out = self.family.scores(x), [None] * len(x)
        best = score.argmax(1)
        for f, name in enumerate(self.family.classes):
            rows = np.flatnonzero(best == f)
            if len(rows):
                vote = self.within[name]
                inner = vote.scores(x[rows])
                for r, k in zip(rows.tolist(), inner.argmax(1).tolist()):
                    out[r] = (vote.classes[k], 0.0)
                for r, s in zip(rows.tolist(), (inner.max(1) * score[rows, f]).tolist()):
                    out[r] = (out[r][0], float(min(1.0, max(0.0, s))))
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows with text and lang. A language with more rows than ``per_language``
    is sampled by the hash of its ids, so the driver gets a bounded number of vectors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.select(doc_key().alias("key"), "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, BINS)), [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(lang, features(t).astype("<f4").tobytes()) for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()) if _LETTER(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["lang", "x"])

    sample = labelled.filter(place < share[F.col("lang")]).select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in sample], dtype=np.float64).reshape(len(sample), BINS)
    return Model(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``nearness`` (the cosine of a text's features with the
    mean of the learned ones) to the columns ``keep`` (default: all)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # a few vectors per language pair, whatever the input
    inside = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("body"))
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "body"):
                texts = part.column("body").to_pylist()
                rows = [i for i, t in enumerate(texts) if t and _LETTER(t)]
                out, near = [(UNKNOWN, 0.0)] * len(texts), np.zeros(len(texts))
                if rows:
                    x = np.array([features(texts[i]) for i in rows])
                    near[rows] = x @ model.mean
                    for i, found in zip(rows, model.predict(x)):
                        out[i] = found
                columns = [part.column(i) for i in range(len(keep))] + [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"k{i}" for i in range(len(keep))] + ["lang_pred", "score", "nearness"])

    return inside.mapInArrow(run, f"{kinds}, lang_pred string, score double, nearness double").toDF(*keep, "lang_pred", "score", "nearness")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows outside the held-out third."""
    model = train(docs.filter(fold("doc_id", 3) != 1), per_language)
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(out, model, "text", ["doc_id", "held_out"]).drop("nearness")


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None, floor: float = FLOOR, near: float = NEAR, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` that are predicted to be in one of ``languages`` (default: any that
    was learned), but for those that fit none of the learned ones. Without any labelled row
    nothing is learned and every text with a letter stays."""
    model = train(docs.filter(fold("doc_id", 3) != 1), per_language)
    if model.family is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = [f"`{c}`" for c in docs.columns]
    names = {c: f"{c}__own" for c in ("lang_pred", "score", "nearness") if c in docs.columns}
    out = predict(docs.withColumnsRenamed(names), model)
    fits = (F.col("score") >= floor) | (F.col("nearness") >= near) | (F.length(F.regexp_replace("text", r"\P{L}", "")) < SHORT)
    wanted = F.col("lang_pred").isin(*languages) if languages is not None else F.lit(True)
    out = out.filter((F.col("lang_pred") != UNKNOWN) & wanted & fits)
    return out.drop("lang_pred", "score", "nearness").withColumnsRenamed({v: k for k, v in names.items()}).select(*kept)
