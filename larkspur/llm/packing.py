"""Packing: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most LENGTH tokens. Only the histogram of piece
lengths (LENGTH entries at most, whatever the corpus) comes to the driver. There,
lengths are placed longest first, each into the packs with most room, and what is kept
is patterns with counts, not packs. A piece then finds its place by its rank among the
pieces of its length: ranks map to (pattern, copy, slot) by a binary search in a table
of the patterns' runs.

Ranks are made without a task that holds a whole length: pieces get a salt from their
document, place and ids, ranks run inside (length, salt), and each salt's offset is a prefix sum over
at most SALTS counts.

Cases: null text is empty, so its document is the end mark alone; repeated rows are
packed each (one id, place and text has one salt); a null doc_id is packed like others; long texts are cut into as many pieces as they need;
ties between pieces of one length are broken by id, place and ids; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .bytesops import chunks, give_back
from .common import table, text_of
from .wordbpe import BLOCK, WordIds

LENGTH, END_ID, SALTS = 4096, 2, 4096
#: Ids that a worker holds before it hands them on.
SENT = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and end mark, with the ids themselves if asked for."""
    fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    fields += [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = WordIds(tokenizer)
        out: list[list] = [[] for _ in fields]

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields)], schema=pa.schema(fields))
            for column in out:
                column.clear()
            return done

        for batch in batches:
            held = 0
            for lo, hi, *_ in chunks(batch.column(1), BLOCK // 4 if with_ids else BLOCK):  # ids are held beside the text
                for doc, ids in zip(batch.column(0)[lo:hi].to_pylist(), words.encode_block(batch.column(1)[lo:hi].to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), length):
                        part = ids[start : start + length]
                        row = (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32))
                        for column, value in zip(out, row):
                            column.append(value)
                    held += len(ids)
                    if held > SENT:
                        yield flush()
                        held = 0
            yield flush()
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


@dataclass
class Plan:
    """Where ranks go: run k holds ranks first[k].. of lengths[k]; copies of its pattern start at base[k]."""

    lengths: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces by length and rank (0-based among the pieces of that length)."""
        shift = np.int64(1) << np.int64(48)
        k = np.searchsorted(self.lengths * shift + self.first, length * shift + rank, side="right") - 1
        i = rank - self.first[k]
        return self.base[k] + i // self.each[k], self.offset[k] + i % self.each[k] * length


def plan_packs(histogram: dict[int, int], length: int = LENGTH) -> Plan:
    """Shortest-pack-first: longest pieces first, each to the packs with most room that it fits."""
    room: list[tuple[int, int, int, tuple]] = []  # (-room, tie, packs, ((length, each), ...))
    done: list[tuple[int, tuple]] = []
    tie = 0

    def put(left: int, packs: int, pattern: tuple) -> None:
        nonlocal tie
        tie += 1
        if left:
            heapq.heappush(room, (-left, tie, packs, pattern))
        else:
            done.append((packs, pattern))

    for size in sorted((k for k, n in histogram.items() if n), reverse=True):
        n = histogram[size]
        while n and room and -room[0][0] >= size:
            left, _, packs, pattern = heapq.heappop(room)
            take = min(n, packs)
            each = pattern[-1][1] if pattern[-1][0] == size else 0
            grown = (*pattern[:-1], (size, each + 1)) if each else (*pattern, (size, 1))
            if take < packs:
                put(-left, packs - take, pattern)
            put(-left - size, take, grown)
            n -= take
        per = length // size
        if n >= per:
            put(length - per * size, n // per, ((size, per),))
        if n % per:
            put(length - n % per * size, 1, ((size, n % per),))
    done += [(packs, pattern) for _, _, packs, pattern in room]
    runs, used, base = [], dict.fromkeys(histogram, 0), 0
    for packs, pattern in done:
        offset = 0
        for size, each in pattern:
            runs.append((size, used[size], base, offset, each))
            used[size] += packs * each
            offset += size * each
        base += packs
    cols = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*cols, base)


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts (PIECES, other columns carried) with sequence_id and offset. parts must be read from a table: it is read twice."""
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))), "salts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    plan = spark.sparkContext.broadcast(plan_packs(histogram, length))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts.drop("_n"), ["length", "_salt"]).withColumn("_rank", (F.col("_rank") + F.col("_ahead")).cast("long"))
    ranked = ranked.select(*parts.columns, "_rank")
    kept = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs, placed; with_ids adds the token ids of the piece."""
    return pack(durable(pieces(docs, tokenizer or tokenizer_path(), length, end_id, with_ids), "pieces"), length)


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
