"""Chat formatting: token-level assembly of conversations.

Template, as text::

    ### System: ...</turn>
    ### User: ...</turn>
    ### Assistant: ...</turn>

(a line feed after each ``</turn>``). Each turn is three runs of text that are encoded
by themselves (the role, the content, nothing else); the marks around them are spliced
in as reserved ids past the tokenizer's vocabulary: OPEN for ``### ``, COLON for ``: ``
and CLOSE for ``</turn>`` with its line feed. Control strings that occur in a role or a
content are escaped by a backslash before them, and backslashes by another, so that
the text form can be read back too: ``unescape`` undoes ``escape`` for every text.

Encoding is done row by row, before conversations come together; the token offsets and
loss masks of a conversation are prefix sums over its turns' lengths. Reading a
conversation back is a stream over its turns, so the longest conversation needs no
more memory than its longest turn.

Cases: null text or role is empty; rows go by (turn, role, text), nulls first, and repeated
rows are turns of their own; a null conv_id is a conversation; long texts are encoded whole; extra columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .common import table

OPEN_TEXT, COLON_TEXT, CLOSE_TEXT = "### ", ": ", "</turn>\n"
#: What must not occur unescaped inside a segment.
CONTROL = ("###", "</turn>")
LEARNED = "assistant"
#: How the template writes roles; the pairs swap, so that a role which is written "User" itself can be read back.
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant", "System": "system", "User": "user", "Assistant": "assistant"}
MEANT = {v: k for k, v in SHOWN.items()}

_escape = re.compile(r"\\|###|</turn>")
_unescape = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: m[1], text)


def shown(role: str) -> str:
    """The role as the template writes it: the common ones with a capital, others as they are."""
    return SHOWN.get(role, role)


def meant(role: str) -> str:
    return MEANT.get(role, role)


class Codec:
    """Byte-level ids for segments, with the template's reserved ids behind the vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from .wordbpe import byte_chars

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.open, self.colon, self.close = first, first + 1, first + 2
        self.marks = {self.open: OPEN_TEXT, self.colon: COLON_TEXT, self.close: CLOSE_TEXT}
        back = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        """The text of ids, marks included."""
        parts, run = [], []
        for i in ids:
            if i in self.marks:
                parts += [b"".join(run).decode(), self.marks[i]]
                run = []
            else:
                run.append(self.bytes_of[i])
        return "".join([*parts, b"".join(run).decode()])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_turns(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """rows (conv_id, turn, role, text) with ids array<int>, role_tokens, content_tokens and loss boolean."""
    path = tokenizer or tokenizer_path()
    kept = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("role_tokens", pa.int32()), ("content_tokens", pa.int32()), ("loss", pa.bool_())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            names = {r: codec.encode([escape(shown(r))])[0] for r in set(roles)}
            bodies = codec.encode([escape(t) for t in texts])
            ids = [[codec.open, *names[r], codec.colon, *b, codec.close] for r, b in zip(roles, bodies)]
            cols = [pa.array(ids, schema.field("ids").type), pa.array([len(names[r]) for r in roles], pa.int32()), pa.array([len(b) for b in bodies], pa.int32()), pa.array([r == LEARNED for r in roles])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], schema=schema)

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, role_tokens int, content_tokens int, loss boolean")


def assemble(turns: DataFrame) -> DataFrame:
    """turns with token_start and, where content is learned, loss_start and loss_end: token offsets in the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = (F.col("role_tokens") + F.col("content_tokens") + 3).cast("long")
    out = turns.withColumn("token_start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    at = F.when(F.col("loss"), F.col("token_start") + F.col("role_tokens") + 2)
    return out.withColumn("loss_start", at).withColumn("loss_end", at + F.col("content_tokens"))


def format_conversations(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each turn: conv_id, turn, ids, token_start, loss_start, loss_end (masks are the spans [loss_start, loss_end))."""
    return assemble(encode_turns(rows, tokenizer)).select("conv_id", "turn", "ids", "token_start", "loss_start", "loss_end")


def read_back(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """From format_conversations' output alone: what each conversation says, under its mask and in all."""
    path = tokenizer or tokenizer_path()
    mid = pa.schema([("conv_id", pa.int64()), ("token_start", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("loss_text", pa.string()), ("formatted", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            out: list[list] = [[] for _ in mid]
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            starts, first, last = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for k, conv in enumerate(batch.column(0).to_pylist()):
                ids = flat[ends[k] : ends[k + 1]]
                mask = np.zeros(len(ids) + 1, np.int32)  # its prefix sums are 1 under the loss
                if first[k] is not None:
                    mask[first[k] - starts[k]] += 1
                    mask[last[k] - starts[k]] -= 1
                mask = np.cumsum(mask)[:-1].astype(bool)
                ids, colon = ids.tolist(), int(np.flatnonzero(ids == codec.colon)[0])
                role, content = codec.decode(ids[1:colon]), codec.decode(ids[colon + 1 : -1])
                loss = unescape(codec.decode([i for i, m in zip(ids, mask) if m])) if first[k] is not None else ""
                row = (conv, starts[k], unescape(role), unescape(content), loss, len(role) + len(content) + len(OPEN_TEXT) + len(COLON_TEXT) + len(CLOSE_TEXT))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, mid)], schema=mid)

    return turns.select("conv_id", "ids", "token_start", "loss_start", "loss_end").mapInArrow(decode, "conv_id long, token_start long, role string, content string, loss_text string, formatted long")


def digest(read: DataFrame) -> DataFrame:
    """read_back's rows by conversation, as a stream over its turns in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: list | None = None

        def close() -> None:
            conv, turns, all_text, chars, loss, formatted = state
            out.append((conv, turns, all_text.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for conv, _, role, content, loss, formatted in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{meant(role)}\n{content}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += formatted
            yield flush()
        if state is not None:
            close()
        yield flush()

    sorted_turns = read.repartition("conv_id").sortWithinPartitions("conv_id", "token_start")
    return sorted_turns.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(read_back(durable(format_conversations(rows.unionByName(probe)), "turns")))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
