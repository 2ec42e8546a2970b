"""Chat formatting in budgeted windows.

Turns of a conversation stream through one task in order (rows are hashed by conv_id and
sorted inside the partitions, so no conversation is ever held as a whole). Running sums of
turn tokens, counted over the turn as it is written with its markers, choose windows that end at turns: a window holds the conversation's system turn
(its first turn, if that is one), some of the turns before, repeated up to ``HISTORY``
tokens, and then new turns while the sum stays within ``BUDGET``. A turn is never cut: one
that is larger than the budget makes a window of its own, marked ``over``. The loss mask
covers the texts of new assistant turns; repeated turns and all markers are outside, so
every assistant text is learnt once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts, every ``<``
that k backslashes and ``|`` follow gets one more backslash, so no control string of the
template can come from data, and dropping one backslash gives the data back. In roles, ``\\``
and line feeds are written ``\\\\`` and ``\\n`` before that.

Order of turns: turn (null first), then role, then text; rows that are equal stay as many
as they are. Null roles and texts are empty. A null conv_id is a conversation like any
other. A turn of any length is kept whole. Only the role ``assistant`` is learnt. An empty table gives an empty result. Columns
beyond conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyring.llm.tokens import encoder, vocabulary as place

BUDGET, HISTORY = 2048, 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text starts and ends in that."""
    head, body = f"{OPEN}{role_out(role)}\n", escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


WINDOW = [("window", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64()), ("over", pa.bool_()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))]
WINDOW_SQL = "window long, first_turn long, n_repeated long, n_new long, n_tokens long, over boolean, text string, loss_starts array<long>, loss_ends array<long>"


class Conversation:
    """Windows of one conversation, as its turns come. Turns are encoded apart; as each begins and
    ends with a marker, a window has as many tokens as its turns together."""

    def __init__(self, conv_id, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.past: deque = deque()
        self.past_tokens = 0
        self.new: list[tuple] = []
        self.new_tokens = 0
        self.turns = self.windows = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.new and self._base() + self.new_tokens + tokens > self.budget:
            yield self.close()
        self.new.append(turn)
        self.new_tokens += tokens
        self.turns += 1
        if self._base() + self.new_tokens > self.budget:
            self._fit()

    def _base(self) -> int:
        return self.past_tokens + (self.system[2] if self.system else 0)

    def _fit(self) -> None:
        """Give up repeated turns, oldest first, that the new turn leaves no room for."""
        while self.past and self._base() + self.new_tokens > self.budget:
            self.past_tokens -= self.past.popleft()[2]

    def close(self) -> tuple:
        repeated = ([self.system] if self.system else []) + list(self.past)
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(repeated + self.new):
            written, lo, hi = render(role, text)
            if k >= len(repeated) and role == "assistant":
                starts.append(at + lo)
                ends.append(at + hi)
            parts.append(written)
            at += len(written)
        total = self._base() + self.new_tokens
        row = (self.conv_id, self.windows, self.turns - len(self.new), len(repeated), len(self.new), total, total > self.budget, "".join(parts), starts, ends)
        fresh = self.new
        if self.windows == 0 and fresh and fresh[0][0] == "system":
            self.system, fresh = fresh[0], fresh[1:]
        for turn in fresh:
            self.past.append(turn)
            self.past_tokens += turn[2]
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[2]
        self.new, self.new_tokens = [], 0
        self.windows += 1
        return row


def _windows(vocabulary: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(place(vocabulary))
        current, rows, size = None, [], 0
        kind = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            names = ["conv_id", *[n for n, _ in WINDOW]]
            kinds = [kind, *[k for _, k in WINDOW]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            turns = [(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            tokens_of = map(len, coder.texts([render(*turn)[0] for turn in turns]))
            for conv, (role, text), tokens in zip(batch.column("conv_id").to_pylist(), turns, tokens_of, strict=True):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        rows.append(current.close())
                    current = Conversation(conv, budget, history)
                for row in current.add(role, text, tokens):
                    rows.append(row)
                    size += len(row[7])
                if rows and (size > 4 << 20 or len(rows) > 2000):
                    yield batch_of(rows)
                    rows, size = [], 0
        if current is not None:
            rows.append(current.close())
            yield batch_of(rows)

    return run


def format_windows(conversations: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row a window: conv_id, window, first_turn (index of its first new turn), n_repeated,
    n_new, n_tokens, over, text, loss_starts and loss_ends (code points of ``text``).

    Rows of a conversation stand together, in order, in one partition."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_windows(vocabulary, budget, history), f"conv_id {kind}, {WINDOW_SQL}")


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window's turns."""
    turns = []
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        turns.append((role_in(role), unescape(body[: -len(CLOSE)])))
    return turns


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, kind, out = None, None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def done() -> tuple:
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if now is None or now[0] != row["conv_id"] or row["window"] == 0:
                if now is not None:
                    out.append(done())
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(row["text"])[row["n_repeated"] :]:
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for lo, hi in zip(row["loss_starts"], row["loss_ends"], strict=True):
                learnt = unescape(row["text"][lo:hi])
                now[3] += len(learnt)
                now[4].update(learnt.encode())
            now[5] += len(row["text"])
            now[6] += 1
        if len(out) > 5000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield batch_of(out)


def read_back(windows: DataFrame, placed: bool = False) -> DataFrame:
    """Digests of the turns and of the learnt text of every conversation, from its windows alone.

    ``placed``: rows still stand as ``format_windows`` gave them; else they are brought together."""
    if not placed:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = windows.schema["conv_id"].dataType.simpleString()
    needed = windows.select("conv_id", "window", "n_repeated", "text", "loss_starts", "loss_ends")
    return needed.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
