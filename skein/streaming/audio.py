"""Audio at the edge: sample rates, a bounded queue of frames, and the plug points of models.

Nothing here needs a device or a model; both come in as callables."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, FRAME = 16_000, 512


def resampled(samples: Sequence[float], rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, by linear interpolation between evenly spaced places."""
    x = np.asarray(samples, np.float32)
    if rate == to or not len(x):
        return x
    places = np.linspace(0, len(x) - 1, int(len(x) * to / rate))
    return np.interp(places, np.arange(len(x)), x).astype(np.float32)


def mono(samples: Sequence[Sequence[float]]) -> np.ndarray:
    """The mean of the channels of (sample, channel) rows."""
    x = np.asarray(samples, np.float32)
    return x.mean(1) if x.ndim > 1 else x


def faster(samples: Sequence[float], speed: float) -> np.ndarray:
    """Speech ``speed`` times as fast, by taking samples at other places."""
    return resampled(samples, RATE, max(1, int(RATE / speed))) if speed != 1 else np.asarray(samples, np.float32)


def resample(samples: Column, rate: int, to: int = RATE) -> Column:
    """``resampled`` over a column of arrays (an Arrow-batched pandas UDF)."""
    return F.pandas_udf(lambda rows: rows.map(lambda x: None if x is None else resampled(x, rate, to)), "array<float>")(samples)


def frames(samples: np.ndarray, size: int = FRAME) -> Iterable[np.ndarray]:
    """Whole frames of a recording."""
    return (samples[i : i + size] for i in range(0, len(samples) - size + 1, size))


class FrameQueue:
    """Frames between a device and a reader: at most ``most`` wait, further ones are dropped and
    counted, so a slow reader never makes memory grow."""

    def __init__(self, most: int = 200) -> None:
        self.waiting: queue.Queue = queue.Queue(most)
        self.dropped = 0

    def put(self, frame: np.ndarray) -> bool:
        try:
            self.waiting.put_nowait(frame)
        except queue.Full:
            self.dropped += 1
            return False
        return True

    def get(self, timeout: float = 0.5) -> np.ndarray | None:
        try:
            return self.waiting.get(timeout=timeout)
        except queue.Empty:
            return None


@dataclass(frozen=True)
class Models:
    """Plug points of the neural models. None: the step isn't there, and its default holds (no
    speech, no text, every voice accepted, silence)."""

    speech: Callable[[np.ndarray], float] | None = None
    transcribe: Callable[[np.ndarray], str] | None = None
    voice: Callable[[np.ndarray], Sequence[float]] | None = None
    synthesize: Callable[[str], np.ndarray] | None = None

    def probability(self, frame: np.ndarray) -> float:
        return float(self.speech(frame)) if self.speech else 0.0

    def text(self, audio: np.ndarray) -> str:
        return self.transcribe(audio) if self.transcribe else ""

    def same_voice(self, anchor: Sequence[float] | None, audio: np.ndarray, least: float = 0.75) -> bool:
        """Whether the audio is in the anchor's voice; so it is without a model or an anchor."""
        if self.voice is None or anchor is None:
            return True
        a, b = np.asarray(anchor, float), np.asarray(self.voice(audio), float)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return bool(norm >= 1e-8 and a @ b / norm >= least)

    def audio(self, text: str) -> np.ndarray:
        return self.synthesize(text) if self.synthesize else np.zeros(0, np.float32)


def transcripts(segments: pd.DataFrame, models: Models) -> pd.Series:
    """Texts of a batch of recorded segments (column ``samples``)."""
    return segments["samples"].map(lambda x: models.text(np.asarray(x, np.float32)))


def devices(listing: Callable[[], Iterable[dict]] | None = None) -> list[tuple[int, str]]:
    """(number, name) of the devices that record, from a listing like an audio library's."""
    return [(i, str(d.get("name", ""))) for i, d in enumerate(listing() if listing else ()) if d.get("max_input_channels", 0) > 0]


@dataclass(frozen=True)
class RuntimePaths:
    """Where a voice runtime keeps its files."""

    runtime_dir: Path
    asr_output: Path
    llm_output: Path
    display_output: Path
    speaker_output: Path
    events_output: Path
    control_output: Path
    tts_dir: Path

    @classmethod
    def of(cls, folder: str | Path) -> RuntimePaths:
        # fixed values: the files' names
        names = ("asr_output.txt", "asr_llm_output.jsonl", "display_output.txt", "speaker_output.txt", "voice_events.jsonl", "voice_control.json", "tts")
        return cls(Path(folder), *(Path(folder) / n for n in names))
