"""Chat formatting by incremental black-box rendering.

A template is any function from messages (role, text) to one string; nothing is asked of it. The
successive prefixes of a conversation are rendered and consecutive outputs compared: what the
next output has more is the new turn's span. Two more renderings, with the turn's text replaced by
one probe or the other, show which part of the span is the text and which is markup. An output
that doesn't hold the previous one unchanged tells that the template rewrites history; the texts
are then looked for in the last output, again by probes, and a text that is no longer there has
no span."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python

Message = tuple[str, str]
Template = Callable[[Sequence[Message]], str]

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common public chat formats, which no text may contain as they stand.
CONTROL = (START, SEPARATOR, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|endoftext|>", "<|startoftext|>")


#: Escaped texts of late: rendering every prefix asks for the same texts again and again.
_ESCAPED: dict[str, str] = {}


def escape(text: str) -> str:
    r"""Double every backslash and put one after the first character of each control string."""
    known = _ESCAPED.get(text)
    if known is None:
        known = text.replace("\\", "\\\\")
        for control in CONTROL:
            known = known.replace(control, control[0] + "\\" + control[1:])
        if len(_ESCAPED) >= 2048:
            _ESCAPED.clear()
        _ESCAPED[text] = known
    return known


def unescape(text: str) -> str:
    """What `escape` was given: a pair of backslashes is one, a single one is left out."""
    return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))


def markup(messages: Sequence[Message]) -> str:
    """Every turn between marks of its own, its role and text escaped."""
    return "".join(f"{START}{escape(role)}{SEPARATOR}{escape(text)}{END}"
                   for role, text in messages)


def read_back(formatted: str) -> list[Message]:
    """The messages that `markup` was given."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(START).split(SEPARATOR)
        out.append((unescape(role), unescape(text)))
    return out


def _longest(most: int, same: Callable[[int, int], bool]) -> int:
    """The largest n up to `most` for which all of [0, n) is the same, by halving: slices are
    compared as wholes, and each character a few times at most."""
    if same(0, most):
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if same(low, middle) else (low, middle)
    return low


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    return _longest(min(len(a), len(b)), lambda i, j: a[i:j] == b[i:j])


def _shared_end(a: str, b: str, most: int) -> int:
    """Length of the common suffix, `most` at most."""
    n, m = len(a), len(b)
    return _longest(most, lambda i, j: a[n - j:n - i] == b[m - j:m - i])


@dataclass
class Rendered:
    """A formatted conversation; a span is [start, end) in characters, None if there is none."""

    text: str
    turns: list[tuple[int, int] | None] = field(default_factory=list)
    contents: list[tuple[int, int] | None] = field(default_factory=list)
    rewritten: list[int] = field(default_factory=list)


#: Two texts that differ at both ends.
PROBES = ("q0q", "x1x")


def _content(render: Template, messages: Sequence[Message], i: int, whole: str
             ) -> tuple[int, int] | None:
    """Where the text of message i stands in `whole`, which is the rendering of all messages."""
    role = messages[i][0]
    one, two = (render([*messages[:i], (role, p), *messages[i + 1:]]) for p in PROBES)
    if one == two:
        return None
    before = _shared(one, two)
    after = _shared_end(one, two, min(len(one), len(two)) - before)
    start, end = before, len(whole) - after
    if end < start or whole[:start] != one[:before] or whole[end:] != one[len(one) - after:]:
        return None
    return start, end


def render_turns(render: Template, messages: Sequence[Message]) -> Rendered:
    """Render all prefixes and locate every turn and its text in the whole conversation."""
    messages = list(messages)
    now = render([])
    out = Rendered(now)
    for i in range(len(messages)):
        last, prefix = now, messages[:i + 1]
        now = render(prefix)
        start = _shared(last, now)
        rest = len(last) - start
        if rest and _shared_end(last, now, min(rest, len(now) - start)) < rest:
            out.rewritten.append(i)
        # What followed the earlier turns and now follows this one belongs to no turn.
        out.turns.append((start, len(now) - rest if i not in out.rewritten else len(now)))
        out.contents.append(_content(render, prefix, i, now))
    out.text = now
    if out.rewritten:
        # The earlier outputs no longer hold: only the last one counts.
        out.contents = [_content(render, messages, i, now) for i in range(len(messages))]
        out.turns = list(out.contents)
    return out


_SCHEMA = ("n_turns long, formatted string, rewritten array<int>, "
           "turns array<struct<start: long, end: long>>, "
           "loss array<struct<start: long, end: long>>")


def format_chats(chats: DataFrame, render: Template = markup, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per conversation: the formatted string, the span of each turn, the spans under
    the loss mask (the texts of role `learn`) and the turns at which the template rewrote history.

    Turns go by number, equal numbers by role, then text, nulls first. A null role or text is
    empty, all rows without a conversation id are one conversation, repeated rows are repeated
    turns, other columns are ignored, and an empty table gives none. A formatted conversation is
    one value, so its turns meet in one task; nothing but its own length adds to that."""
    kind = chats.schema[conv].dataType.simpleString()
    gathered = chats.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows: list[tuple] = []
            for turns in batch.column(1).to_pylist():
                messages = [(t["role"], t["text"]) for t in turns]
                found = render_turns(render, messages)
                asked = [s for (r, _), s in zip(messages, found.contents) if r == learn]
                rows.append((len(messages), found.text, found.rewritten,
                             [s and {"start": s[0], "end": s[1]} for s in found.turns],
                             [{"start": s[0], "end": s[1]} for s in asked if s]))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), spans, spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["conv", "n_turns", "formatted", "rewritten", "turns", "loss"])

    return for_python(gathered).mapInArrow(run, f"conv {kind}, {_SCHEMA}").withColumnRenamed("conv", conv)


def chat_report(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests read back from what `format_chats` wrote with `markup`."""
    kind = chats.schema[conv].dataType.simpleString()
    made = format_chats(chats, conv=conv).select(F.col(conv).alias("conv"), "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                learnt = "".join(unescape(formatted[s["start"]:s["end"]]) for s in loss)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
                             hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows)) if rows else [()] * 5
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["conv", *names])

    return made.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, "
                           "loss_chars long, loss_sha256 string, formatted_chars long"
                           ).withColumnRenamed("conv", conv)
