"""Chat formatting: event-sourced reconstruction of messages, and their rendering with a loss mask.

Logs hold events (conv_id, turn, branch, seq, kind, role, text) of messages, which (conv_id, turn, branch) name:
`open` gives the role, `delta` appends its text, `edit` puts its text in place of all before, `regenerate` drops all
before. Logs are partitioned by conversation, in ranges of conversation, turn and branch, so that a conversation's
messages stand together in their order and only one beyond a task's share is cut, between messages. There they are
sorted by `seq` and folded as a stream, one message in memory at a time; an event delivered again (same seq) counts
once, the least by kind, role and text.

A rendered message is `### role: text</turn>` and a line end. A backslash stands before each backslash, `### ` and
`</turn>` of a text, and before each of these and each colon of a role; reading back removes it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import text_batches

HEAD, TAIL = "### ", "</turn>"
LEARNT = "assistant"

_MESSAGE = ["conv_id", "turn", "branch"]
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_CHUNK = 1 << 20  # characters unescaped at once


def _folded(batches):
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("branch", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    key, role, parts, last = None, "", [], object()
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for *own, seq, kind, who, text in zip(*[batch.column(c).to_pylist() for c in (*_MESSAGE, "seq", "kind", "role", "text")]):
            if own != key:
                if key is not None:
                    out.append((*key, role, "".join(parts)))
                    size += len(out[-1][-1])
                key, role, parts, last = own, "", [], object()
            if seq == last:
                continue
            last = seq
            if kind == "open":
                role = who or ""
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
            if size > 4 << 20 or len(out) >= 2000:
                yield _rows(out, kinds)
                out, size = [], 0
    if key is not None:
        out.append((*key, role, "".join(parts)))
    yield _rows(out, kinds)


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, branch, role, text) of event logs; other kinds of events change nothing.

    A null text is empty, a null or missing role the empty role. Null ids and turns name messages like any other;
    other columns are not looked at.
    """
    own = events.select(*[F.col(c).cast("long").alias(c) for c in (*_MESSAGE, "seq")], "kind", "role", "text")
    text_batches(events.sparkSession)
    return (own.repartitionByRange(*_MESSAGE).sortWithinPartitions(*_MESSAGE, "seq", "kind", "role", "text")
            .mapInArrow(_folded, "conv_id long, turn long, branch long, role string, text string"))


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"(\\|### |</turn>|:)" if role else r"(\\|### |</turn>)", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """`messages` with `segment`, the rendered message, and `loss_start` and `loss_chars`, the code points of it that
    are learnt: the escaped text of assistant messages, nothing of others."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(": "))
    text = escape(F.col("text"))
    learnt = F.col("role") == LEARNT
    return messages.withColumns({"segment": F.concat(head, text, F.lit(TAIL + "\n")), "loss_start": F.length(head),
                                 "loss_chars": F.when(learnt, F.length(text)).otherwise(0)})


def _escaped(text: str, at: int, start: int) -> bool:
    """Whether an odd number of backslashes, counted back to `start`, stands before `at`."""
    back = at
    while back > start and text[back - 1] == "\\":
        back -= 1
    return bool((at - back) % 2)


def _find(text: str, mark: str, start: int) -> int:
    """The first place of `mark` from `start` on that no backslash escapes."""
    at = text.find(mark, start)
    while at >= 0 and _escaped(text, at, start):
        at = text.find(mark, at + 1)
    if at < 0:
        raise ValueError(f"a rendered turn without {mark!r}")
    return at


def unescape(text: str) -> str:
    parts, at = [], 0
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        end += _escaped(text, end, at)
        parts.append(_ESCAPED.sub(r"\1", text[at:end]))
        at = end
    return "".join(parts)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation. Texts are searched for their end, once, and copied."""
    out, at = [], 0
    while at < len(rendered):
        start = at + len(HEAD)
        colon = _find(rendered, ": ", start)
        end = _find(rendered, TAIL, colon + 2)
        out.append((unescape(rendered[start:colon]), unescape(rendered[colon + 2 : end])))
        at = end + len(TAIL) + 1
    return out


def _digested(batches):
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                       ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    key: object = None
    state: list | None = None
    out: list[tuple] = []

    def done() -> tuple:
        n, turns, chars, loss, formatted = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_chars")]
        for conv, segment, start, chars in zip(*columns):
            if state is None or conv != key:
                if state is not None:
                    out.append(done())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            learnt = unescape(segment[start : start + chars])
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(segment)
        if out:
            yield _rows(out, kinds)
            out = []
    if state is not None:
        out.append(done())
    yield _rows(out, kinds)


def digests(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of rendered messages, read back.

    A conversation is the stream of its segments by turn and branch: it is hashed as it passes, never held.
    """
    text_batches(rendered.sparkSession)
    return (rendered.select(*_MESSAGE, "segment", "loss_start", "loss_chars").repartition("conv_id").sortWithinPartitions(*_MESSAGE)
            .mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def transcripts(rendered: DataFrame) -> DataFrame:
    """(conv_id, transcript): whole rendered conversations, for those that fit in one row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "branch", "segment")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), "").alias("transcript"))
