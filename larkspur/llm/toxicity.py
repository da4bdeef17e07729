"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed byte n-grams (sizes ORDERS, ASCII lower-cased, white
space as one kind). Over all labelled training rows the documents of either label that
hold a feature are counted; log((p+1)/(P+2)) - log((q+1)/(Q+2)) scales the feature. Logistic
regression on all scaled features is fitted (by L-BFGS) to whole texts of at most MAX_FIT of the
training rows: those with the least hash of id, text and label, whatever the partitions.

Cases: null text is empty and, like one shorter than three bytes, gets the score of no
feature. Rows with a null label don't train; a document labelled twice trains twice. Rows that are equal in all of id, text and
label are in the fitted sample together or not at all, ties at its bound included.
Without labels of both kinds every score is the smoothed share of label 1. NUL bytes
part n-grams. Long texts are read in sections. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable
from .bytesops import CHUNK, LOWER, SPACE, U, sections
from .common import bucket_of_id, table, text_of

ORDERS, HASH_BITS = (3, 4, 5), 18
#: Labelled rows that the regression is fitted to.
MAX_FIT = 2500
#: Slices in which count vectors are added up.
SLICES = 32
#: Label tables of up to so many rows are joined by broadcast.
BROADCAST_ROWS = 1_000_000
SIZE = len(ORDERS) << HASH_BITS

_fold = LOWER.copy()
_fold[SPACE] = 32
_multiplier = U(0xD6E8FEB86659FD93)


def features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, feature) of chunks of documents: each document's distinct features, of the wanted ones."""
    gap = max(ORDERS)
    parts: list[np.ndarray] = []
    for rows, base, data, offsets in sections(column, CHUNK, gap - 1):
        lo, hi = int(rows[0]), int(rows[-1]) + 1
        if base[0] == 0 and parts:  # the long text before is whole
            pairs = np.unique(np.concatenate(parts))
            yield lo - 1, lo, pairs // SIZE, pairs % SIZE
            parts = []
        pairs = _features(data, offsets, wanted)
        if len(data) < CHUNK:
            if base[0] == 0:
                yield lo, hi, pairs // SIZE, pairs % SIZE
                continue
        elif hi - lo > 1:
            yield lo, hi, pairs // SIZE, pairs % SIZE
            continue
        parts.append(pairs)
    if parts:
        pairs = np.unique(np.concatenate(parts))
        yield len(column) - 1, len(column), pairs // SIZE, pairs % SIZE


_last = np.empty(SIZE + 1, np.int32)


def _features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """row * SIZE + feature, once for each feature of a row."""
    gap, docs, size = max(ORDERS), len(offsets) - 1, np.diff(offsets)
    spread = np.zeros(len(data) + gap * docs + gap, np.uint8)
    begins = offsets[:-1] + gap * np.arange(docs)
    spread[np.arange(len(data)) + gap * np.repeat(np.arange(docs), size)] = _fold[data]
    slots = np.full((len(ORDERS), len(spread)), SIZE, np.int32)  # SIZE is no feature
    code, whole = spread.astype(np.uint64), spread != 0
    for k in range(1, gap):
        code = code[:-1] | spread[k:].astype(np.uint64) << U(8 * k)
        whole = whole[:-1] & (spread[k:] != 0)
        if k + 1 not in ORDERS:
            continue
        order = ORDERS.index(k + 1)
        slot = ((code * _multiplier) >> U(64 - HASH_BITS)).astype(np.int32) + np.int32(order << HASH_BITS)
        slots[order, : len(code)] = np.where(whole if wanted is None else whole & wanted[slot], slot, SIZE)
    place, out = np.arange(len(ORDERS) * max(size.max(initial=0), 1), dtype=np.int32), []
    for d in range(docs):
        mine = slots[:, begins[d] : begins[d] + size[d]].ravel()
        at = place[: len(mine)]
        _last[mine] = at  # of equal features the last one stays
        mine = mine[(_last[mine] == at) & (mine != SIZE)]
        out.append(mine.astype(np.int64) + d * SIZE)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents with each feature, by label, over all of rows (text, label)."""
    step = SIZE // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((2, SIZE), np.int64), [0, 0]
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, row, feature in features(batch.column(0)):
                for y in (0, 1):
                    seen[y] += np.bincount(feature[label[lo:hi][row] == y], minlength=SIZE)
            docs = [docs[y] + int((label == y).sum()) for y in (0, 1)]
        parts = [seen[:, k * step : (k + 1) * step].tobytes() for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), *(pa.array([d] + [0] * (SLICES - 1), pa.int64()) for d in docs)], names=["slice", "counts", "n0", "n1"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs = np.zeros(2, np.int64)
        for batch in batches:
            for k, part, n0, n1 in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.int64)
                docs += (n0, n1)
        keys = sorted(sums)
        n = [[int(d)] + [0] * (len(keys) - 1) if keys else [] for d in docs]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary()), *(pa.array(x, pa.int64()) for x in n)], names=["slice", "counts", "n0", "n1"])

    schema = "slice int, counts binary, n0 long, n1 long"
    parts = rows.mapInArrow(count, schema).repartition(8, "slice").mapInArrow(add, schema).collect()
    total, docs = np.zeros((2, SIZE), np.int64), [0, 0]
    for r in parts:
        total[:, r["slice"] * step : (r["slice"] + 1) * step] += np.frombuffer(r["counts"], np.int64).reshape(2, step)
        docs = [docs[0] + r["n0"], docs[1] + r["n1"]]
    return total[0], total[1], docs[0], docs[1]


def fit_logistic(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, steps: int = 40, ridge: float = 1e-2, memory: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept of ridge logistic regression over (doc, feature, value) triples, by L-BFGS on all rows."""
    n, rows = max(len(label), 1), len(label)
    used, feature = np.unique(feature, return_inverse=True)  # weights that no row tells stay 0
    whole, size, doc = size, len(used), doc.astype(np.intp)
    w = np.zeros(size + 1)
    w[size] = np.log((label.sum() + 0.5) / (rows - label.sum() + 0.5))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(np.bincount(doc, value * w[feature], minlength=rows) + w[size], -30, 30)
        gap = 1 / (1 + np.exp(-z)) - label
        g = np.append(np.bincount(feature, value * gap[doc], minlength=size) / n + ridge * w[:size], gap.sum() / n)
        return float((np.logaddexp(0, z) - label * z).sum() / n + ridge / 2 * (w[:size] @ w[:size])), g

    past: list[tuple[np.ndarray, np.ndarray]] = []
    now, g = loss(w)
    for _ in range(steps):
        step, scales = -g, []
        for s, y in reversed(past):
            scales.append((s @ step) / (s @ y))
            step = step - scales[-1] * y
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(scales)):
            step = step + (a - (y @ step) / (s @ y)) * s
        rate = 1.0 if past else 1 / max(1.0, float(np.abs(g).sum()))
        while rate > 1e-8:
            new, h = loss(w + rate * step)
            if new <= now + 1e-4 * rate * (g @ step):
                break
            rate /= 4
        else:
            break
        s, y = rate * step, h - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        done = now - new < 1e-7
        w, now, g = w + s, new, h
        if done:
            break
    out = np.zeros(whole)
    out[used] = w[:size]
    return out, float(w[size])


def least_hashed(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The rows whose hash of columns is among the least `most` of all; only hashes move. Rows that tie at the bound are all there."""
    rows = rows.withColumn("_h", F.xxhash64(*columns, F.lit(3)))
    bound = rows.select("_h").orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    return rows.filter(F.col("_h") <= (bound if bound is not None else 0)).drop("_h")


def train(rows: DataFrame, max_fit: int = MAX_FIT) -> tuple[np.ndarray, float]:
    """Weight of each hashed feature and the intercept, from rows (doc_id, text, label)."""
    rows = durable(rows, "labelled")
    q, p, q_docs, p_docs = count_features(rows.select("text", "label"))
    if not (q_docs and p_docs):
        return np.zeros(SIZE, np.float32), float(np.log((p_docs + 0.5) / (q_docs + 0.5)))
    ratio = (np.log((p + 1) / (p_docs + 2)) - np.log((q + 1) / (q_docs + 2))).astype(np.float32)

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, feature in features(batch.column(0)):
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[order].astype(np.int32)))], names=["label", "features"])

    sample = least_hashed(rows, max_fit, "doc_id", "text", "label").select("text", "label")
    got = sample.mapInArrow(spot, "label int, features array<int>").toArrow().combine_chunks()
    lists = got.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, feature = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    doc, label = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), got.column("label").to_numpy().astype(float)
    del got, lists, p, q
    weights, bias = fit_logistic(doc, feature, ratio[feature], label, SIZE)
    discard(rows.sparkSession, rows)
    return (weights * ratio).astype(np.float32), bias


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs' doc_id with score, over whole texts."""
    ship = docs.sparkSession.sparkContext.broadcast((weights, weights != 0, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, used, b = ship.value
        for batch in batches:
            z = np.full(len(batch), b)
            for lo, hi, row, feature in features(batch.column(1), used):
                z[lo:hi] += np.bincount(row, w[feature], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of docs that have a label."""
    marks = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    return docs.select("doc_id", text_of().alias("text")).join(marks, "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of_id("doc_id", 5) == 0
    weights, bias = train(labelled(docs.filter(~held_out), table(spark, sf_dir, "labels")))
    scored = score(docs, weights, bias)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
