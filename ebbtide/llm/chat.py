"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and only its reply trainable. Turns
after the last reply (or a conversation without one) become a last example without a trainable part, so that
no turn is lost. An example is one text, ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn, with the offsets of
the reply.

Escaping: every control string starts with ``<|``. Inside texts a run ``<``, any backslashes, ``|`` gets one
backslash more, so no text can hold ``<|``, and taking one away restores it. Roles also escape backslashes
and line feeds.

Conversations are gathered by a shuffle on the conversation and sorted inside the partitions, spilling to
disk; a task then streams over them and holds one growing prefix. The prefixes of one conversation add up to
the square of its length, which the method itself asks for; ``parts`` gives the same without repeating text.

Defined results: a null text or role is empty; rows of equal turn are ordered by role and text; a null
conversation id is one conversation; null turns come first; an empty table gives no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import partitions

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
BATCH_CHARS = 4 << 20
EXAMPLES = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_EXAMPLES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("example", pa.int32()),
        ("n_turns", pa.int32()),
        ("text", pa.string()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
    ]
)
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def parts(conversations: DataFrame) -> DataFrame:
    """One formatted part per turn: ``conv_id, turn, role, head, body, trainable``; nothing is shuffled."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.coalesce("role", F.lit("")) == ASSISTANT).alias("trainable"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row) + 64
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conversation, turns in groupby(_rows(batches), key=lambda r: r[0]):
            prefix, examples, pending, count = "", 0, 0, 0
            for _, head, body, trainable in turns:
                start = len(prefix) + len(head)
                prefix += head + body + END
                count, pending = count + 1, pending + 1
                if trainable:
                    yield conversation, examples, count, prefix, start, start + len(body)
                    examples, pending = examples + 1, 0
            if pending:
                yield conversation, examples, count, prefix, len(prefix), len(prefix)

    yield from _batched(rows(), _EXAMPLES, lambda r: len(r[3]))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, text, loss_start, loss_end`` (code points).

    The examples of a conversation stand together, in order, in one partition.
    """
    order = ("conv_id", "turn", "role", "body")
    gathered = parts(conversations).repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions(*order)
    return gathered.select("conv_id", "head", "body", "trainable").mapInArrow(_expand, EXAMPLES)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    for part in text.split(START)[1:]:
        head, _, body = part.partition("\n")
        yield unescape_role(head), unescape(body.removesuffix(END))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conversation, examples in groupby(_rows(batches), key=lambda r: r[0]):
            loss, loss_chars, chars, last = hashlib.sha256(), 0, 0, ""
            for _, _, _, text, start, end in examples:
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                loss_chars, chars, last = loss_chars + len(reply), chars + len(text), text
            turns, n = hashlib.sha256(), 0
            for role, text in parse(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            yield conversation, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    yield from _batched(rows(), _DIGESTS, lambda r: 256)


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from their texts alone: one row per conversation."""
    return examples.mapInArrow(_read_back, DIGESTS)
