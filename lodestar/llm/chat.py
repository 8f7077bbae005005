"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that
reply trainable. Turns are marked by control strings; control strings inside texts are escaped, so
the formatted text reads back exactly. Turns behind the last reply, or of a conversation without
one, are kept in a final example in which nothing is trainable.

Conversations are dealt out by their id, sorted within partitions and streamed: a task holds the
formatted context of one conversation, which is also the longest value it writes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import ARROW, small_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What a text must not hold as it is: our marks and control strings of public chat templates.
CONTROL = re.compile(r"\\|<(?=\|)|\|(?=>)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)")
_MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)
_ESCAPE = re.compile(r"\\(\\?)")
FLUSH_BYTES = 4 << 20
TRAINED = "assistant"

EXAMPLES = "example bigint, n_turns bigint, formatted string, loss_start bigint, loss_end bigint, last boolean"


def escape(text: str) -> str:
    """A backslash before every backslash and behind the first character of a control string."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def marked(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{SAYS}{escape(text)}{END}"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    return [(unescape(m[1]), unescape(m[2])) for m in _MARKED.finditer(formatted)]


def _streamed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Examples from (conv_id, turn, role, text) rows sorted by conversation and turn.

    The last example of a conversation is known when the next one begins, so one is held back.
    """
    conv, n, example, context, held, used = object(), 0, 0, [], None, 0

    def ended():
        nonlocal held
        if held is not None and used == n:
            yield (*held, True)
        else:
            if held is not None:
                yield (*held, False)
            if n:
                yield (conv, example, n, "".join(context), None, None, True)
        held = None

    for conv_id, _, role, text in rows:
        if conv_id != conv or type(conv_id) is not type(conv):
            yield from ended()
            conv, n, example, context, used = conv_id, 0, 0, [], 0
        role, text = role or "", text or ""
        context.append(marked(role, text))
        n += 1
        if role == TRAINED:
            if held is not None:
                yield (*held, False)
            context = ["".join(context)]
            stop = len(context[0]) - len(END)
            held, used = (conv_id, example, n, context[0], stop - len(escape(text)), stop), n
            example += 1
    yield from ended()


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[text_at] or "")
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example: conv_id, its number, n_turns, formatted text, and the loss mask as code points.

    loss_start and loss_end are null where nothing is trainable; ``last`` marks the example with all
    turns. Null roles and texts are empty. Rows of equal turn are ordered by role and text, so
    repeated rows stand beside each other and all count. A null conversation id is one conversation.
    An empty table gives no examples. Ids are whole numbers or, of any other type, strings. Texts of any
    length are one value. Other columns are not read, whatever their names.
    """
    small_batches(conversations.sparkSession)
    kind = "bigint" if isinstance(conversations.schema[conv].dataType, T.IntegralType) else "string"
    schema = _EXAMPLES.set(0, pa.field("conv_id", ARROW[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(_streamed(rows), schema, 3)

    rows = conversations.select(F.col(conv).cast(kind).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, {EXAMPLES}")


def digests(formatted: DataFrame) -> DataFrame:
    """Reads examples back, in the order they were written: per conversation its turns and what its loss masks cover.

    Examples that come in another order are an error; after a shuffle, or read from files that were
    split, sort them within partitions by conversation and number first.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = _DIGESTS.set(0, pa.field("conv_id", ARROW[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            loss, chars, total, due = hashlib.sha256(), 0, 0, (None, 0)
            for batch in batches:
                for conv, example, n, text, start, stop, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if example == 0 and due[1] == 0:
                        loss, chars, total = hashlib.sha256(), 0, 0
                    elif due != (conv, example):
                        raise ValueError(f"example {example} of conversation {conv} is out of order")
                    due = (None, 0) if last else (conv, example + 1)
                    total += len(text)
                    if start is not None:
                        said = unescape(text[start:stop])
                        loss.update(said.encode())
                        chars += len(said)
                    if last:
                        turns = turns_of(text)
                        if len(turns) != n:
                            raise ValueError(f"conversation {conv} reads back {len(turns)} turns of {n}")
                        whole = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode())
                        yield conv, n, whole.hexdigest(), chars, loss.hexdigest(), total, example + 1

        yield from _batches(conversations(), schema, 2)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")
