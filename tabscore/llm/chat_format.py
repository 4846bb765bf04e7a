"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask.

The log has one row an event: conv_id, seq, message, kind, role, text. `delta` appends text to a message (and begins
it), `edit` replaces what it has, `regenerate` throws it away, to be streamed anew, `delete` takes the message out.
Rows are dealt by conversation and sorted by (conv_id, seq) with a tie-break by all other columns; a task streams
them and folds one conversation at a time. A message stands where its first event did.

Template: each turn is `<|im_start|>` role, a newline, the text, `<|im_end|>`, a newline. In texts a backslash is
doubled and every control string (of this template and of other common ones) gets a backslash after its first
character, so no text holds one; a role is percent-encoded where it has to be. Both are undone when read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates. Fixed values.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>"]
_FIRST = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNDO = re.compile(r"\\(\\?)")
LOG = "conv_id, seq, message, kind, role, text"
FORMATTED = "formatted string, n_messages bigint, loss array<struct<start:bigint,stop:bigint>>"


def escape(text: str) -> str:
    return _FIRST.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[%\n<\[\\]", lambda m: f"%{ord(m[0]):02X}", role)


def unescape_role(role: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where the texts of the role to learn stand in it, in code points."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return turns


class Fold:
    """The messages of one conversation, in the order of their first events."""

    def __init__(self):
        self.role: dict = {}
        self.parts: dict = {}

    def add(self, message, kind: str, role: str, text: str) -> None:
        parts = self.parts.setdefault(message, [])
        if role is not None or message not in self.role:
            self.role[message] = role or ""
        if kind == "edit":
            parts[:] = [text or ""]
        elif kind == "regenerate":
            parts.clear()
        elif kind == "delete":
            self.parts.pop(message), self.role.pop(message)
        elif text:
            parts.append(text)

    def messages(self) -> list[tuple[str, str]]:
        return [(self.role[m], "".join(p)) for m, p in self.parts.items()]


def _format_kernel(kind: pa.DataType):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, done, held = None, None, [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            ids, texts, counts, spans = zip(*rows, strict=True)
            loss = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), loss], ["conv_id", "formatted", "n_messages", "loss"])

        def close() -> tuple:
            messages = fold.messages()
            text, spans = render(messages)
            return now, text, len(messages), spans

        for batch in batches:
            for conv, message, what, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or conv != now:
                    if fold is not None:
                        done.append(close())
                        held += len(done[-1][1])
                        if held > 4 << 20:
                            yield batch_of(done)
                            done, held = [], 0
                    now, fold = conv, Fold()
                fold.add(message, what, role, text)
        if fold is not None:
            done.append(close())
        if done:
            yield batch_of(done)

    return kernel


def format_log(log: DataFrame) -> DataFrame:
    """conv_id, formatted, n_messages, loss of each conversation in the log.

    Null texts add nothing, a null role keeps the message's (at first: ''), a null conv_id is a conversation of its
    own, a kind that isn't known counts as delta. Ties in seq go by message, kind, role and text. Events after a
    delete begin the message anew.
    """
    own = log.select("conv_id", "seq", "message", "kind", "role", "text")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text")
    kind = log.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.select("conv_id", "message", "kind", "role", "text").mapInArrow(_format_kernel(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {FORMATTED}")


def read_back(formatted: str, loss: list[tuple[int, int]]) -> tuple[int, str, int, str]:
    """Turns, digest of the turns, code points and digest of what the loss mask shows: all from the formatted text."""
    turns = parse(formatted)
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(unescape(formatted[a:b]) for a, b in loss)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*read_back(f, [(s["start"], s["stop"]) for s in loss]), len(f)) for f, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: A conversation whose texts are control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def turns_as_log(conversations: DataFrame) -> DataFrame:
    """Each row of a table of turns as one message of the log: streamed, so a single delta."""
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    return numbered.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The registered query."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    probe = spark.range(2).select(F.lit(-7).cast(kind).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    formatted = format_log(turns_as_log(rows))
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest_rows, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
