"""Conversation memory and event sessions, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.rules import Profile


def memory(turns: DataFrame, most: int = 10) -> DataFrame:
    """The last ``most`` messages of every conversation, oldest first as ``place``."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("__back", F.row_number().over(last)).filter(F.col("__back") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("__back")


def history_prompt(turns: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, prompt): the last messages as ``role: text`` lines."""
    rows = memory(turns, most).withColumn("line", F.concat("role", F.lit(": "), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))


def prompt(question: Column, history: Column, evidence: Column) -> Column:
    """History, evidence and question as one prompt; empty parts go."""
    parts = [F.when(F.trim(p) != "", F.concat(F.lit(head), p)) for head, p in (("History:\n", history), ("Context:\n", evidence), ("Question: ", question))]
    return F.concat_ws("\n\n", *parts)


def normalized_history(history: Column) -> Column:
    """Messages with a role and a text that isn't blank; a missing role is the user's."""
    named = F.transform(history, lambda m: F.struct(F.coalesce(F.nullif(F.trim(m["role"]), F.lit("")), F.lit("user")).alias("role"), F.trim(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(named, lambda m: m["content"] != "")


def sessions(events: DataFrame, gap: str = "15 seconds", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions that end after more than ``gap`` without an event."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(user, w.alias("w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended")).drop("w")


def bounded_sessions(events: DataFrame, idle: float, most: float, user: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """(user, event, session): sessions that end when idle for over ``idle`` seconds or when
    they would last over ``most``; where one ends depends on where it began, so events are
    streamed in order (bounded memory, however many a user has)."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(user, event, F.col(ts).cast("timestamp").cast("double").alias("__at"))
    rows = rows.repartition(user).sortWithinPartitions(user, "__at", event)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, begun, last, n = object(), 0.0, 0.0, 0
        for batch in batches:
            out = []
            for u, at in zip(batch[user], batch["__at"]):
                if u != who:
                    who, begun, n = u, at, 1
                elif at - last > idle or at - begun > most:
                    begun, n = at, n + 1
                last = at
                out.append(n)
            yield batch[[user, event]].assign(session=out)

    return rows.mapInPandas(run, f"{user} {kinds[user]}, {event} {kinds[event]}, session long")


#: State that each kind of event sets; a ready event while speaking changes nothing.
STATES = {"wake": "listening", "speech": "listening", "query": "thinking", "answer": "speaking", "error": "error", "ready": "idle"}


def session_states(events: DataFrame, kind: str, by: str, *order: str) -> DataFrame:
    """Adds ``state``: the state after each event of a session."""
    w = Window.partitionBy(by).orderBy(*order)
    set_ = F.create_map(*[F.lit(x) for k, v in STATES.items() if k != "ready" for x in (k, v)])[F.col(kind)]
    # the last event that isn't "ready" decides whether a ready one takes effect
    before = F.last(set_, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ready_after = F.last(F.when(F.col(kind) == "ready", F.lit("ready")).when(set_.isNotNull(), set_), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when((ready_after == "ready") & (F.coalesce(before, F.lit("idle")) != "speaking"), "idle").otherwise(F.coalesce(before, F.lit("idle")))
    return events.withColumn("state", state)


#: What segments speech, in frames of 32 ms: probabilities that open and trail, silence that
#: closes, frames at most, frames kept from before, frames of a final and of a partial at least,
#: and frames between partials.
VAD = {"start": 0.5, "stop": 0.35, "silence": 22, "longest": 780, "preroll": 16, "least": 8, "partial_least": 16, "partial_every": 19}


class Segmenter:
    """One stream's speech segments, frame by frame: a segment opens at ``start``, with the
    frames before it; below ``stop`` it trails, and it closes after ``silence`` such frames or
    ``longest`` in all. Shorter than ``least`` is no speech. An open segment gives a partial
    every ``partial_every`` frames once it has ``partial_least``."""

    def __init__(self, **options) -> None:
        self.o = {**VAD, **options}
        self.state, self.begun, self.quiet, self.number, self.at = "idle", 0, 0, 0, -1

    def _row(self, kind: str) -> tuple:
        return kind, self.number, max(0, self.begun - self.o["preroll"]), self.at, self.at - self.begun + 1

    def close(self) -> list[tuple]:
        """Ends an open segment."""
        open_, self.state = self.state != "idle", "idle"
        if not open_ or self.at - self.begun + 1 - self.quiet < self.o["least"]:
            return []
        row = self._row("final")
        self.number += 1
        return [row]

    def push(self, prob: float) -> list[tuple]:
        """(kind, segment, first frame, last frame, frames) rows that a frame completes."""
        self.at += 1
        if self.state == "idle":
            if prob >= self.o["start"]:
                self.state, self.begun, self.quiet = "speech", self.at, 0
            return []
        trails = prob < self.o["stop"] or (self.state == "trailing" and prob < self.o["start"])
        self.quiet = self.quiet + 1 if trails else 0
        self.state = "trailing" if self.quiet else "speech"
        n = self.at - self.begun + 1
        if self.quiet >= self.o["silence"] or n >= self.o["longest"]:
            return self.close()
        return [self._row("partial")] if n % self.o["partial_every"] == 0 and n >= self.o["partial_least"] else []


SEGMENT = "kind string, segment long, first_frame long, last_frame long, n_frames long"


def segment_streams(frames: DataFrame, by: str = "stream_id", order: str = "frame", partials: bool = False, **options) -> DataFrame:
    """Speech segments of every stream of (stream, frame, prob); with ``partials`` their partial
    results as well (``kind``). Frames are streamed in order in bounded memory."""
    kind = frames.schema[by].dataType.simpleString()
    rows = frames.select(by, order, "prob").repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, machine = None, None
        for batch in batches:
            out = []
            for u, p in zip(batch[by], batch["prob"]):
                if machine is None or u != who:
                    out += [(who, *x) for x in (machine.close() if machine else [])]
                    who, machine = u, Segmenter(**options)
                out += [(u, *x) for x in machine.push(p)]
            yield pd.DataFrame(out, columns=[by, "kind", "segment", "first_frame", "last_frame", "n_frames"])
        if machine:
            yield pd.DataFrame([(who, *x) for x in machine.close()], columns=[by, "kind", "segment", "first_frame", "last_frame", "n_frames"])

    out = rows.mapInPandas(run, f"{by} {kind}, {SEGMENT}")
    return out if partials else out.filter("kind = 'final'").drop("kind")


def latest_generation(tasks: DataFrame) -> DataFrame:
    """Recognition tasks that still count: finals, and partials of the newest generation."""
    newest = tasks.groupBy(F.col("stream_id").alias("__s")).agg(F.max("generation").alias("__newest"))
    held = tasks.join(newest, F.col("stream_id").eqNullSafe(F.col("__s")), "left")
    return held.filter((F.col("kind") == "final") | (F.col("generation") == F.col("__newest"))).drop("__s", "__newest")


def retained(files: DataFrame, most: int) -> DataFrame:
    """Files beyond the newest ``most``, to be deleted. The newest come from a top-k, so no task
    sees all files."""
    newest = files.orderBy(F.desc("modified"), "path").limit(most).select("path")
    return files.join(newest, "path", "left_anti")


def filter_by_intent(hits: DataFrame, profile: Profile, intent: str = "intent", source: str = "source") -> DataFrame:
    """Hits whose source the query's intent allows; all of a query's hits if none is."""
    low, keep = F.lower(source), F.lit(True)
    for name, i in profile.intents.items():
        ok = ~T.contains_any(low, i.denied_sources) & (T.contains_any(low, i.allowed_sources) if i.allowed_sources else F.lit(True))
        keep = F.when(F.col(intent) == name, ok).otherwise(keep)
    some = F.max("__keep").over(Window.partitionBy("query_id"))
    return hits.withColumn("__keep", keep).withColumn("__some", some).filter(F.col("__keep") | ~F.col("__some")).drop("__keep", "__some")
