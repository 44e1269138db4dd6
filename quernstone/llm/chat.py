r"""Chat formatting by prefix-target expansion.

Method. Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is
trainable. What follows the last reply (or a conversation without replies) becomes one more example, of which nothing is
trainable, so that no turn is lost.

Template. user: `[INST]text[/INST]`; assistant: `<s>text</s>`; any other role: `<<SYS>>role<<:>>text<</SYS>>`. Inside texts
and roles a backslash goes before each backslash, `<` and `[`; so no control string can come from a text, and
removing the backslashes restores it. The loss mask of an example is one span: the reply's escaped text.

Size. Conversations are dealt by conv_id and sorted by turn (the sort spills). A task streams turn after turn and holds what it has
formatted of one conversation, which the last example has all of anyway; examples leave as they are made. What is made of a
conversation grows with the square of its turns, as each reply has all turns before it: that is the method.

Cases. Null texts and roles count as empty. Rows of one conversation with the same turn stand by role, then text; repeated rows
are turns of their own; null turns stand first. Null conv_ids make one conversation. An empty table gives no
rows. Columns other than conv_id, turn, role and text are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

ESCAPED = re.compile(r"[\\<\[]")
UNESCAPED = re.compile(r"\\([\\<\[])")
# A turn of a formatted text: one alternative a template.
BODY = r"((?:[^\\<\[]|\\[\\<\[])*)"
TURN = re.compile(rf"\[INST\]{BODY}\[/INST\]|<s>{BODY}</s>|<<SYS>>{BODY}<<:>>{BODY}<</SYS>>")


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str]:
    """What stands before the escaped text, and what after."""
    if role == "user":
        return "[INST]", "[/INST]"
    if role == "assistant":
        return "<s>", "</s>"
    return f"<<SYS>>{escape(role)}<<:>>", "<</SYS>>"


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(target turn, formatted text, start and end of the loss mask) of each example; no target: None, 0, 0."""
    prefix, fresh = "", False
    for k, (role, text) in enumerate(turns):
        before, after = render(role, text)
        inner = escape(text)
        prefix, start = prefix + before + inner + after, len(prefix) + len(before)
        fresh = role != "assistant"
        if not fresh:
            yield k, prefix, start, start + len(inner)
    if fresh:
        yield None, prefix, 0, 0


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        user, assistant, role, other = m.groups()
        turns.append(("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other)))
        at = m.end()
    return turns


def examples(conversations: DataFrame) -> DataFrame:
    """A row an example: conv_id, example (from 0), target_turn, text, loss_start, loss_end; a conversation's in a row."""
    names = ["conv_id", "example", "target_turn", "text", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64()]

    def batch(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        def stream():
            for b in batches:
                for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield c, role or "", text or ""

        ready, size = [], 0
        for conv, turns in groupby(stream(), key=itemgetter(0)):
            # turns come as they are read: only what was formatted so far is held
            for k, (target, text, start, end) in enumerate(expand((role, text) for _, role, text in turns)):
                ready.append((conv, k, target, text, start, end))
                size += len(text)
                if size > 1 << 22 or len(ready) == 4096:
                    yield batch(ready)
                    ready, size = [], 0
        if ready:
            yield batch(ready)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ship(dealt).mapInArrow(run, "conv_id long, example long, target_turn long, text string, loss_start long, loss_end long")


def read_back(made: DataFrame) -> DataFrame:
    """A row a conversation, from its examples alone (as `examples` gives them): n_turns, digests of the turns and of all
    text under the loss masks, and how many characters the examples have. The last example has every turn.

    A conversation's examples must lie together, in order, as `examples` leaves them; rows in another order are an error."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        done, conv, at, last, chars, formatted, loss = [], None, -1, None, 0, 0, hashlib.sha256()

        def row():
            said = hashlib.sha256()
            turns = parse(last)
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode())
            return conv, len(turns), said.hexdigest(), chars, loss.hexdigest(), formatted

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            for c, k, text, start, end in zip(*columns, strict=True):
                if k == 0:
                    if last is not None:
                        done.append(row())
                    conv, chars, formatted, loss = c, 0, 0, hashlib.sha256()
                elif (c, k) != (conv, at + 1):
                    raise ValueError(f"example {k} of conversation {c} follows example {at} of conversation {conv}")
                at = k
                part = unescape(text[start:end])
                chars, formatted, last = chars + len(part), formatted + len(text), text
                loss.update(part.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done])
                done = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))])

    columns = made.select("conv_id", "example", "text", "loss_start", "loss_end")
    return ship(columns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
