"""Structured Streaming: sessions, session state, the answering bridge and its sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "kind string, session_id string, text string, meta map<string,string>, ts double"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Voice events (JSON lines) as files arrive; ``at`` is their time."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances, one a line, from files that arrive in a folder."""
    return spark.readStream.text(folder).withColumnRenamed("value", "text").filter(F.trim("text") != "")


def session_counts(events: DataFrame, gap: str, late: str, by: str = "session_id", at: str = "at") -> DataFrame:
    """Events and span of each session; a session closes ``gap`` after its last event."""
    rows = events.withWatermark(at, late)
    return rows.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "n_events")


def active_sessions(utterances: DataFrame, wake: str, stop: tuple[str, ...], idle_ms: int = 15_000, most_ms: int = 120_000, late: str = "5 seconds") -> DataFrame:
    """The wake-word session machine: a wake word opens a stream's session, a stop word,
    ``idle_ms`` without speech or ``most_ms`` in all close it; what is said meanwhile goes on.
    A silent session ends by a timer once the stream's time (less ``late``) has passed its end.

    utterances: stream_id, text, at (timestamp). Output: stream_id, kind, text."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, last = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            out, begun = [("timeout", "")] if begun else [], 0
        else:
            # a micro-batch's rows of one stream: what was said since the last trigger
            rows = pd.concat(list(batches)).sort_values("at")
            for text, at in zip(rows["text"], rows["at"]):
                now, low = int(at.timestamp() * 1000), text.lower().strip()
                if begun and (now - last > idle_ms or now - begun > most_ms):
                    out.append(("timeout", ""))
                    begun = 0
                if begun and low in stop:
                    out.append(("stop", text))
                    begun = 0
                elif wake in low:
                    out.append(("wake", low.split(wake, 1)[1].strip(" ,.!?")))
                    begun, last = begun or now, now
                elif begun:
                    out.append(("query", text))
                    last = now
        state.update((begun, last))
        if begun:
            state.setTimeoutTimestamp(max(min(last + idle_ms, begun + most_ms) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"stream_id": key[0], "kind": [k for k, _ in out], "text": [t for _, t in out]})

    kind = utterances.schema["stream_id"].dataType.simpleString()
    return utterances.withWatermark("at", late).groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, kind string, text string", "begun long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def remembered(turns: DataFrame, most: int = 10) -> DataFrame:
    """Streaming conversation memory: after each batch the last ``most`` messages of the
    conversations it touched."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists and state.get[0] else []
        rows = pd.concat(list(batches)).sort_values("turn")
        held = (held + list(zip(rows["role"], rows["text"])))[-most:]
        state.update(([r for r, _ in held], [t for _, t in held]))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(held)], "last_role": [held[-1][0]]})

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, n long, last_role string", "roles array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


class Bridge:
    """Answers each micro-batch of utterances and hands the rows to sinks. A failing answer
    becomes a row with its error, and the stream goes on."""

    def __init__(self, answer: Callable[[DataFrame], DataFrame], sinks: list[Callable[[DataFrame, int], None]], skip=None) -> None:
        self.answer, self.sinks, self.skip = answer, sinks, skip

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch if self.skip is None else batch.filter(~self.skip(F.col("text")))
        try:
            out = self.answer(rows).withColumn("error", F.lit(None).cast("string"))
            out = out.persist()
            out.count()
        except Exception as e:  # the loop goes on with the next batch
            out = rows.withColumns({"display": F.lit(""), "error": F.lit(f"{type(e).__name__}: {e}"[:300])})
        for sink in self.sinks:
            sink(out, number)
        out.unpersist()

    def start(self, utterances: DataFrame, checkpoint: str):
        return utterances.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_sink(path: str, column: str = "display") -> Callable[[DataFrame, int], None]:
    """Appends a column's texts, separated by ``---`` lines."""

    def put(rows: DataFrame, number: int) -> None:
        rows.select(F.concat(F.coalesce(column, F.lit("")), F.lit("\n---")).alias("value")).write.mode("append").text(path)

    return put


def json_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, number: rows.write.mode("append").json(path)


def control_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Overwrites the mute control (one JSON row a session) with the last state of each batch."""
    return lambda rows, number: control_state(rows).write.mode("overwrite").json(path)


def control_state(events: DataFrame) -> DataFrame:
    """(session_id, muted): whether the last control event muted the microphone."""
    last = F.max_by("kind", "ts")
    return events.filter(F.col("kind").isin("mute", "unmute")).groupBy("session_id").agg((last == "mute").alias("muted"))


def gated(frames: DataFrame, controls: DataFrame, by: str = "session_id", at: str = "ts") -> DataFrame:
    """The frames that weren't said into a muted microphone: the last control event of their
    session before them isn't ``mute``. Both sides are streamed in order, in bounded memory."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    both = frames.withColumns({"__control": F.lit(None).cast("string")})
    own = controls.filter(F.col("kind").isin("mute", "unmute")).select(by, at, F.col("kind").alias("__control"))
    rows = both.unionByName(own, allowMissingColumns=True).repartition(by).sortWithinPartitions(by, at, F.desc_nulls_last("__control"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, muted = None, False
        for batch in batches:
            keep = []
            for u, c in zip(batch[by], batch["__control"]):
                if u != who:
                    who, muted = u, False
                muted = muted if c is None else c == "mute"
                keep.append(c is None and not muted)
            yield batch[keep].drop(columns="__control")

    return rows.mapInPandas(run, kinds)


def appended_lines(before: str, after: str) -> list[str]:
    """New lines of a file that was read before; from the first difference if it was rewritten."""
    old, new = before.splitlines(), after.splitlines()
    same = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
    return new[same:]


class FileWatch:
    """Hands a file's new lines on as it grows or is rewritten. What stands in it at the start
    counts as read; ``poll`` looks once, ``run`` until ``stop`` says so."""

    def __init__(self, path: str, handle: Callable[[str], None]) -> None:
        self.path, self.handle = Path(path), handle
        self.seen, self.text = self._mark(), self._read()

    def _mark(self) -> tuple[int, int] | None:
        return (s.st_mtime_ns, s.st_size) if self.path.exists() and (s := self.path.stat()) else None

    def _read(self) -> str:
        return self.path.read_text("utf-8") if self.path.exists() else ""

    def poll(self) -> int:
        """How many lines were handed on; blank ones aren't."""
        mark = self._mark()
        if mark is None or mark == self.seen:
            return 0
        now = self._read()
        lines = [x.strip() for x in appended_lines(self.text, now) if x.strip()]
        self.seen, self.text = mark, now
        for line in lines:
            self.handle(line)
        return len(lines)

    def run(self, stop: Callable[[], bool], every: float = 0.2) -> None:
        while not stop():
            self.poll()
            time.sleep(every)
