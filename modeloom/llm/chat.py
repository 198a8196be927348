"""Chat formatting with templates as black boxes.

A template is any function from turns to one string.  It is rendered for successive
prefixes of a conversation; what a prefix adds to the one before is the span of its last
turn.  A prefix whose output does not begin with the output before shows a template that
rewrites history.  Within a span, a second rendering with a marker for the text shows
where the text stands, which gives the loss mask.

The query's template is rendered for each prefix, whole, in conversations of any length.  A template
may declare, as its attribute ``context``, how many turns before a turn decide what
that turn adds.  It is then rendered after so many turns instead of whole prefixes;
what it declares is tested on every turn and on the whole
output, and whole prefixes are rendered where it fails.  Such a declaration is taken at its word for prefixes
that are not rendered: a rewriting that the whole output no longer shows is not found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import table

Turn = tuple[str, str]
CONTROL = r"<s>|</s>|\[/?(?:INST|OUT|ROLE|NAME)\]"
_IN_TEXT, _ESCAPED = re.compile(rf"(\\*)({CONTROL})"), re.compile(rf"\\(\\*)({CONTROL})")
MARK = "\x00\x01\x00"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
FORMATTED = "conv_id long, formatted string, roles array<string>, span_starts array<long>, loss_starts array<long>, loss_ends array<long>, rewritten_at long"


def escape(text: str) -> str:
    """A backslash more before each control string, so that none without one is left."""
    return _IN_TEXT.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@lru_cache(maxsize=2048)
def _turn(role: str, text: str) -> str:
    if role == "user":
        return f"[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f"[OUT] {escape(text)} </s>"
    return f"[ROLE] {escape(role)} [NAME] {escape(text)} [/ROLE]"


def instruction_template(turns: list[Turn]) -> str:
    """The default template; a blank stands on either side of each text.  Turns that were written lately are not escaped again."""
    return "<s>" + "".join([_turn(role, text) for role, text in turns])


def parse(formatted: str) -> list[Turn]:
    """Turns of a string of the default template."""
    out: list[Turn] = []
    role, begin = "", 0
    for m in _IN_TEXT.finditer(formatted):
        if m[1]:
            continue
        kind, text = m[2], unescape(formatted[begin + 1 : m.start() - 1])
        if kind == "[NAME]":
            role = text
        elif kind in ("[/INST]", "</s>", "[/ROLE]"):
            out.append(({"[/INST]": "user", "</s>": "assistant"}.get(kind, role), text))
        begin = m.end()
    return out


class Located:
    """Output of a template, where each turn and each text stands in it, and the first turn that rewrites history."""

    def __init__(self, formatted: str, spans: list[tuple[int, int]], texts: list[tuple[int, int]], rewritten_at: int | None):
        self.formatted, self.spans, self.texts, self.rewritten_at = formatted, spans, texts, rewritten_at


def _added(old: str, new: str) -> str | None:
    return new[len(old) :] if new.startswith(old) else None


def _text_place(added: str, frame: str | None) -> tuple[int, int] | None:
    """Where the text stands in what a turn adds, seen from what the turn with the marker for a text adds."""
    if frame is None or MARK not in frame:
        return None
    head, tail = frame.split(MARK, 1)
    if added.startswith(head) and added.endswith(tail) and len(added) >= len(head) + len(tail):
        return len(head), len(added) - len(tail)
    return None


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], context: int | None = None) -> Located:
    """Renders prefix after prefix; what each adds to the one before is the span of its last turn.

    With ``context``, a turn is rendered after that many turns, and after one more: both must add
    the same, and the parts, one after the other, must be the rendering of the whole; else
    every prefix is rendered whole.  A turn without a place for its text has an empty one.
    """
    parts = [previous := render([])]
    spans: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    rewritten, at = None, len(previous)
    for k, turn in enumerate(turns):
        begin = 0 if context is None else max(0, k - context)
        before = turns[begin:k]
        old = previous if context is None else render(before)
        now = render([*before, turn])
        added = _added(old, now)
        if context is not None and begin and added is not None:
            more = turns[begin - 1 : k]
            if _added(render(more), render([*more, turn])) != added:
                added = None
        if added is None:
            if context is not None:
                return locate(render, turns)
            rewritten = k
            break
        place = _text_place(added, _added(old, render([*before, (turn[0], MARK)])))
        texts.append((at + place[0], at + place[1]) if place else (at, at))
        spans.append((at, at + len(added)))
        parts.append(added)
        at += len(added)
        previous = now
    whole = previous if context is None and rewritten is None else render(turns)
    if context is not None and "".join(parts) != whole:
        return locate(render, turns)
    return Located(whole, spans, texts, rewritten)


def format_conversations(conversations: DataFrame, render: Callable[[list[Turn]], str] = instruction_template) -> DataFrame:
    """One row per conversation with the output, its spans and its loss mask (texts of the assistant).

    ``conversations``: conv_id, turn, role, text.  Rows are ordered by turn (null first), equal
    turns by role and text; a null role or text is empty; rows without a conv_id make one
    conversation with a null id; other columns are ignored; an empty table gives no row.  A
    conversation that its template rewrites has ``rewritten_at`` set to that turn and spans
    for the turns before only.  Tasks stream over sorted rows and hold one conversation, which is
    one row of output, so memory is that of the longest conversation.  A template that declares
    no ``context`` is rendered for each prefix: time grows with the square of a conversation's length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {x.split()[0]: [] for x in FORMATTED.split(", ")}
        size, key, turns, begun = 0, None, [], False

        def close() -> None:
            nonlocal size
            got = locate(render, turns, getattr(render, "context", None))
            loss = [x for x, (role, _) in zip(got.texts, turns) if role == "assistant"]
            for name, v in zip(out, (key, got.formatted, [r for r, _ in turns], [a for a, _ in got.spans], [a for a, _ in loss], [b for _, b in loss], got.rewritten_at)):
                out[name].append(v)
            size += len(got.formatted)

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if begun and conv != key:
                    close()
                    turns = []
                    if size > 4_000_000:
                        yield rows()
                        size = 0
                key, begun = conv, True
                turns.append((role, text))
        if begun:
            close()
            yield rows()

    df = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the default template's output says when it is parsed, and of the text under its loss mask."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
            cols = [batch.column(i).to_pylist() for i in (0, 1, 4, 5)]
            for conv, text, starts, ends in zip(*cols):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                for name, v in zip(out, (conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in out.items()], list(out))

    return formatted.mapInArrow(work, SCHEMA)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations of the table and one of control strings, formatted and read back; see :func:`format_conversations` for odd rows."""
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))
