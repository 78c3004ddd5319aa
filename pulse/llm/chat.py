"""Operator 9, chat formatting: event-sourced reconstruction of conversations.

The input is a log: ``conv_id, seq, event, turn, role, text``.  Logs are partitioned by
conversation and sorted; the events of a message are folded into its final text:

* ``start``: a new message with a role and a first text;
* ``delta``: more text at its end (a message that was never started is the assistant's);
* ``edit``: another text in place of what there is;
* ``regenerate``: the message begins anew, and what came before in later turns is gone;
* ``delete``: the message goes.

Which events a later ``regenerate`` voids is a running minimum over the
conversation (a window that spills), so the fold itself streams and holds one message
at a time, also in a conversation with a third of all rows.

Every message is rendered as a segment ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``; a
conversation's format is the concatenation of its segments.  Control strings within
roles and texts get a backslash after their first character (one more, if some are
there), which ``unescape`` takes back.  ``loss_start`` and ``loss_end`` bound the text that is
trained on (the assistant's) within the segment, in code points.

Null texts and roles are empty; null turns and sequence numbers come first; messages
of one turn and number (repeated rows too) are ordered by role and text and all kept;
a null ``conv_id`` is a conversation of its own; an empty log gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.common import read_table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ASSISTANT = "assistant"
DELTA_CHARS = 64               # text of one streamed event in the log of a finished turn, at most
# Strings that chat templates use as control marks; every "<|" counts as one.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARKS = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPED = "|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE, _UNESCAPE = re.compile(_MARKS), re.compile(_ESCAPED)
_SEGMENT = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*)" + re.escape(END) + r"\Z", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The segment of a message and the bounds of its loss mask."""
    head, body = START + escape(role) + SEP, escape(text)
    trained = role == ASSISTANT
    return head + body + END, len(head) if trained else None, len(head) + len(body) if trained else None


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.match(segment)
    return unescape(m[1]), unescape(m[2])


class Fold:
    """The fold over one conversation's events: one message at a time."""

    def __init__(self):
        self.turn, self.role, self.parts = None, "", None

    def _done(self):
        out = None if self.parts is None else (self.role, "".join(self.parts))
        self.parts = None
        return out

    def event(self, event: str, turn, role: str, text: str, stale: bool):
        """Apply an event; the message that it ends, if it ends one."""
        ended = None
        if event == "start" or turn != self.turn:
            ended = self._done()
            self.turn = turn
            if event == "start":
                self.role, self.parts = role, ["" if stale else text]
                return ended
        if event == "delete":
            self.parts = None
        elif event in ("delta", "edit", "regenerate"):
            if self.parts is None:
                self.role, self.parts = role or ASSISTANT, []
            if not stale:
                if event != "delta":
                    self.parts.clear()
                self.parts.append(text)
        return ended

    def end(self):
        return self._done()


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
                       ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, conv, begun, position, rows = Fold(), None, False, 0, []

    def put(message):
        nonlocal position
        if message is not None:
            rows.append((conv, position, message[0], *render(*message)))
            position += 1

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)],
                                          schema=_SEGMENTS)

    for batch in batches:
        for c, event, turn, role, text, stale in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not begun or c != conv:
                put(fold.end())
                fold, conv, begun, position = Fold(), c, True, 0
            put(fold.event(event, turn, role, text, stale))
        if rows:
            yield batch_of(rows)
            rows.clear()
    put(fold.end())
    if rows:
        yield batch_of(rows)


def segments(log: DataFrame) -> DataFrame:
    """conv_id, position, role, segment, loss_start, loss_end: a conversation's rows are in one partition, in order."""
    events = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "event",
                        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    later = Window.partitionBy("conv_id").orderBy(F.desc("_n")).rangeBetween(Window.unboundedPreceding, -1)
    marked = (events.withColumn("_n", F.coalesce("seq", F.lit(-(1 << 62))))
              .withColumn("_again", F.min(F.when(F.col("event") == "regenerate", F.coalesce("turn", F.lit(-(1 << 62))))).over(later)))
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    live = marked.filter(F.col("_again").isNull() | (F.col("_again") >= at))
    stale = (F.col("_again").isNotNull() & (F.col("_again") == at)).alias("stale")
    ordered = live.sortWithinPartitions("conv_id", "turn", "_n", F.col("event") != "start", "role", "text")
    return ordered.select("conv_id", "event", "turn", "role", "text", stale).mapInArrow(
        _segments, "conv_id long, position long, role string, segment string, loss_start long, loss_end long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the segments back: roles and texts, and what lies under the loss mask."""
    conv, turns, rows = None, None, []

    def put():
        if turns is not None:
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        names = ("conv_id", "segment", "loss_start", "loss_end")
        for c, segment, a, b in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if turns is None or c != conv:
                put()
                conv, n, turns, loss_chars, loss, chars = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            role, text = read_segment(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
            chars += len(segment)
            if a is not None:
                trained = unescape(segment[a:b])
                loss.update(trained.encode())
                loss_chars += len(trained)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in rows], schema=_DIGESTS)
            rows = []
    put()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in rows], schema=_DIGESTS)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                          "formatted_chars long")


def log_of(turns: DataFrame) -> DataFrame:
    """A log of a table of finished turns: each row's ``start``, then its text as streamed ``delta`` events; ``seq`` counts a conversation's events.

    Rows of one turn follow each other by role and text, so that each one's deltas come before the next one's start.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "*", F.ceil(F.char_length("text") / DELTA_CHARS).alias("_deltas"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_first", F.coalesce(F.sum(F.col("_deltas") + 1).over(before), F.lit(0)))
    events = numbered.select("conv_id", "turn", "role", "_first", F.posexplode(F.concat(F.array(F.lit("")), pieces)).alias("_place", "text"))
    return events.select("conv_id", (F.col("_first") + F.col("_place")).cast("long").alias("seq"),
                         F.when(F.col("_place") == 0, "start").otherwise("delta").alias("event"), "turn", "role", "text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(segments(log_of(turns)))
