"""Chat formatting at the level of tokens.

Every turn is assembled from segments that are encoded separately: a reserved id opens the
turn (one per known role, or a general one followed by the role's own ids and a separator),
the escaped text follows, a reserved id closes it. Reserved ids stand above the vocabulary,
so no text can produce them. Strings that the template would read as control strings are
escaped by a backslash, and so are backslashes, which makes the escape reversible. A turn's
loss mask covers an assistant's text alone; places within a conversation are prefix sums
over the segments' lengths.

Turns are encoded and decoded row by row in parallel. Only the digests of a conversation
need its turns in order: rows are dealt by conversation, sorted and streamed, so a very long
conversation costs time in one task but no memory.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own;
turns with equal numbers are ordered by role, then text, and repeated rows count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import byte_bpe
from skein.llm.common import bounded_batches, materialize, slices

ROLES = ("system", "user", "assistant", "tool")
LEARNED = "assistant"
#: What the reserved ids are written as.
OPEN, OTHER, SEPARATOR, CLOSE = {r: f"### {r.capitalize()}: " for r in ROLES}, "### Role ", ": ", " </turn>\n"
#: Strings that are escaped inside texts (after the backslash itself).
CONTROL = ("###", "</turn>", "<turn>", "<|")
_ESCAPED = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROL))).sub
_PLAIN = re.compile(r"\\(.)", re.S).sub

ASSEMBLED = "conv_id long, turn long, role string, ids array<int>, loss_from int, loss_to int"


def escape(text: str) -> str:
    return _ESCAPED(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN(lambda m: m[1], text)


class Template:
    """Ids of turns for one tokenizer file."""

    def __init__(self, tokenizer_file: str) -> None:
        self.bpe = byte_bpe.loaded(tokenizer_file)
        first = self.bpe.size
        self.role_id = {r: first + i for i, r in enumerate(ROLES)}
        self.other, self.separator, self.close = (first + len(ROLES) + i for i in range(3))
        self.shown = {i: OPEN[r] for r, i in self.role_id.items()} | {self.other: OTHER, self.separator: SEPARATOR, self.close: CLOSE}
        self.role_of = {i: r for r, i in self.role_id.items()}

    def assemble(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], int, int]]:
        """Each turn's ids, and from where to where its loss mask is set."""
        bodies = self.bpe.encode_batch([escape(t) for t in texts])
        others = iter(self.bpe.encode_batch([escape(r) for r in roles if r not in self.role_id]))
        out = []
        for role, body in zip(roles, bodies):
            body = np.frombuffer(body, "<u4").tolist()
            head = [self.role_id[role]] if role in self.role_id else [self.other, *np.frombuffer(next(others), "<u4").tolist(), self.separator]
            edges = np.cumsum([0, len(head), len(body), 1]).tolist()
            out.append(([*head, *body, self.close], edges[1], edges[2] if role == LEARNED else edges[1]))
        return out

    def take_apart(self, ids: list[int]) -> tuple[str, str, str]:
        """Role, text and the formatted string of a turn's ids."""
        if ids[0] == self.other:
            cut = ids.index(self.separator)
            role, body = unescape(self.bpe.decode(ids[1:cut])), ids[cut + 1 : -1]
        else:
            cut, role, body = 0, self.role_of[ids[0]], ids[1:-1]
        text = self.bpe.decode(body)
        head = self.shown[ids[0]] + (escape(role) + SEPARATOR if cut else "")
        return role, unescape(text), head + text + CLOSE


def assemble(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per turn: conv_id, turn, role, ids, loss_from, loss_to (places in ids)."""
    bounded_batches(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        template = Template(tokenizer_file)
        for batch in batches:
            for part in slices(batch, "text"):
                done = template.assemble(part.column("role").to_pylist(), part.column("text").to_pylist())
                rest = [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.list_(pa.int32()), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("conv_id", "turn", "role")] + rest, names=["conv_id", "turn", "role", "ids", "loss_from", "loss_to"])

    return plain.mapInArrow(run, ASSEMBLED)


def read_back(assembled: DataFrame, tokenizer_file: str) -> DataFrame:
    """Turns as decoded from their ids: role, text, what the loss mask covers (null: nothing),
    number of ids and formatted characters."""

    def run(batches):
        template = Template(tokenizer_file)
        for batch in batches:
            ids, begins, ends = (batch.column(c).to_pylist() for c in ("ids", "loss_from", "loss_to"))
            turns = [template.take_apart(x) for x in ids]
            masked = [unescape(template.bpe.decode(x[a:b])) if t[0] == LEARNED else None for x, a, b, t in zip(ids, begins, ends, turns)]
            columns = [pa.array([t[0] for t in turns]), pa.array([t[1] for t in turns]), pa.array(masked, pa.string()), pa.array([len(x) for x in ids], pa.int32()), pa.array([len(t[2]) for t in turns], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], names=["conv_id", "turn", "role", "text", "masked", "n_ids", "n_chars"])

    return assembled.select("conv_id", "turn", "ids", "loss_from", "loss_to").mapInArrow(run, "conv_id long, turn long, role string, text string, masked string, n_ids int, n_chars int")


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, digests of all turns and of the masked text, formatted size."""

    def run(batches):
        now, state, out = object(), None, []

        def flush(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            done = [(k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]) for k, s in rows]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for conv, role, text, masked, n_ids, n_chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "masked", "n_ids", "n_chars"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if masked is not None:
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += n_chars
                state[5] += n_ids
            if out:
                yield flush(out)
                out = []
        if state is not None:
            yield flush([(now, state)])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"
    return dealt.mapInArrow(run, schema)


def format_conversations(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """Formats all conversations, writes the assembled ids and digests what is read back."""
    return digest(read_back(materialize(assemble(turns, tokenizer_file), "chat"), tokenizer_file))
