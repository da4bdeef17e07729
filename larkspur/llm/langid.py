"""Language ID: a bidirectional gated recurrent network over bytes.

Two GRU layers, one in each direction, read a text's UTF-8 bytes (gates are hard sigmoids), label every byte with
probabilities of the learned languages, and a document's probabilities are the mean over all its bytes. Texts are read whole, in
segments of SEGMENT bytes side by side; each layer runs in on the RUN_IN bytes before (or behind) its
segment, so that its state comes from across the border. Training is
backpropagation through time in numpy, by Adam, over all windows of WINDOW bytes of the whole texts, EPOCHS times, of at
most MAX_FIT training documents, an equal share of each language: those with the least hash of id, text and language, whatever
the partitions. Weights are a few kilobytes and are broadcast.

Cases: a null text or one without a letter is ``und`` with score 0; null languages don't
train; without training rows every text is ``und``; long texts are read whole, segment
after segment; repeated rows get equal predictions, and are in the training sample together or not at all, ties at its bound
included; of extra columns ``predict`` carries those it is asked for, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import chunks
from .common import bucket_of_id, table, text_of

HIDDEN, SEGMENT, RUN_IN = 8, 448, 64
#: Training documents, and bytes of a window.
MAX_FIT, WINDOW = 600, 64
EPOCHS, BATCH, RATE = 2, 128, 0.02
#: Segments that are run side by side.
ROWS = 512
PAD = 256

Weights = dict[str, np.ndarray]


def start_weights(classes: int, hidden: int = HIDDEN, seed: int = 5) -> Weights:
    """embed and recur are (direction, part, ...) with the parts update gate, reset gate, candidate."""
    rng = np.random.default_rng(seed)
    scale = np.array([0.2, 0.2, 1.0])[None, :, None, None]
    w = {
        "embed": rng.normal(0, 0.3, (2, 3, 257, hidden)) * scale + np.array([0.5, 0.5, 0.0])[None, :, None, None],
        "recur": rng.normal(0, 1 / np.sqrt(hidden), (2, 3, hidden, hidden)) * scale,
        "out": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, classes)),
        "bias": np.zeros(classes),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def hold_padding(w: Weights) -> Weights:
    """With its update gate wide open, padding leaves the state as it is."""
    w["embed"][:, :, PAD] = 0
    w["embed"][:, 0, PAD] = 1000
    return w


def run_layer(embed: np.ndarray, recur: np.ndarray, codes: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """States (time, row, hidden) of one direction; codes is (time, row). Gates are hard sigmoids: clipped to 0..1."""
    steps, rows = codes.shape
    states = np.empty((steps, rows, recur.shape[-1]), embed.dtype)
    h = np.zeros(states.shape[1:], embed.dtype)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z, r, x = (part.take(codes[t], axis=0) for part in embed)
        z += h @ recur[0]
        np.clip(z, 0, 1, out=z)
        r += h @ recur[1]
        np.clip(r, 0, 1, out=r)
        u = h @ recur[2]
        n = r * u
        n += x
        np.tanh(n, out=n)
        if tape is not None:
            tape.append((t, h, z, r, n, u))
        h = h - n
        h *= z
        h += n
        states[t] = h
    return states


def probabilities(w: Weights, codes: np.ndarray) -> np.ndarray:
    """(class, time, row) for codes (time, row); logits are small, as states lie in -1..1."""
    hidden = w["out"].shape[1]
    p = sum(w["out"][d].T @ run_layer(w["embed"][d], w["recur"][d], codes, d == 1).reshape(-1, hidden).T for d in (0, 1))
    p += w["bias"][:, None]
    np.exp(p, out=p)
    p /= p.sum(0)
    return p.reshape(-1, *codes.shape)


def gradient(w: Weights, codes: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all bytes that aren't padding, and its gradient through time."""
    tapes: list[list] = [[], []]
    states = [run_layer(w["embed"][d], w["recur"][d], codes, d == 1, tapes[d]) for d in (0, 1)]
    logits = w["bias"] + states[0] @ w["out"][0] + states[1] @ w["out"][1]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    real = codes != PAD
    rows = np.arange(codes.shape[1])
    loss = -float(np.log(p[:, rows, label] + 1e-9)[real].mean())
    p[:, rows, label] -= 1
    p *= (real / real.sum())[..., None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] = p.sum((0, 1)).astype(np.float32)
    for d in (0, 1):
        g["out"][d] = np.einsum("trh,trc->hc", states[d], p)
        into = p @ w["out"][d].T
        dh = np.zeros_like(into[0])
        recur = w["recur"][d]
        grads = np.empty((3, *into.shape), into.dtype)
        for t, h, z, r, n, u in reversed(tapes[d]):
            dh = dh + into[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * ((z > 0) & (z < 1))
            dr = dn * u * ((r > 0) & (r < 1))
            grads[:, t] = dz, dr, dn
            du = dn * r
            g["recur"][d] += h.T @ dz, h.T @ dr, h.T @ du
            dh = dh * z + dz @ recur[0].T + dr @ recur[1].T + du @ recur[2].T
        flat = codes.ravel()
        for k in range(3):
            for j in range(into.shape[-1]):
                g["embed"][d, k, :, j] = np.bincount(flat, grads[k, ..., j].ravel(), minlength=257)
    return loss, g


def fit(windows: list[bytes], label: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 5) -> Weights:
    codes = np.full((WINDOW, len(windows)), PAD, np.int32)
    for k, x in enumerate(windows):
        codes[: len(x), k] = np.frombuffer(x, np.uint8)
    w = hold_padding(start_weights(classes, seed=seed))
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in "ms")
    picks = max(100, epochs * -(-len(windows) // BATCH)) * BATCH  # small samples are gone over more often
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-picks // len(windows)))])
    steps = picks // BATCH
    for t in range(1, steps + 1):
        pick = order[(t - 1) * BATCH : t * BATCH]
        _, g = gradient(w, codes[:, pick], label[pick])
        rate = RATE * (1 - t / (steps + 1)) + 1e-3
        for k in w:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            w[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)
        hold_padding(w)
    return {k: v.astype(np.float32) for k, v in w.items()}


def train(rows: DataFrame, max_fit: int = MAX_FIT) -> tuple[list[str], Weights | None]:
    """Languages and weights from rows (doc_id, text, lang)."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("_h", F.xxhash64("doc_id", "text", "lang", F.lit(11)))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return [], None
    share = max(1, max_fit // len(langs))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))  # only hashes move; a task sends share of a language at most
    bounds = rows.select("lang", "_h").withColumn("n", nth).filter(F.col("n") <= share).groupBy("lang").agg(F.max("_h").alias("_most"))
    chosen = rows.join(F.broadcast(bounds), "lang").filter(F.col("_h") <= F.col("_most"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                parts = [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)]
                out += parts
                names += [lang] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["window", "lang"])

    got = chosen.select("text", "lang").mapInArrow(cut, "window binary, lang string").toArrow()
    windows, names = got.column("window").to_pylist(), got.column("lang").to_pylist()
    rank = sorted(range(len(windows)), key=lambda i: (windows[i], names[i]))  # whatever order they came in
    windows, label = [windows[i] for i in rank], np.array([langs.index(names[i]) for i in rank])
    return langs, fit(windows, label, len(langs))


def add_up(w: Weights, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, total: np.ndarray) -> None:
    """Add to total (row, language) each wanted row's probabilities of all its bytes."""
    size = np.diff(offsets) * wanted
    segments = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), segments)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - (np.cumsum(segments) - segments)[doc]) * SEGMENT
    end = np.minimum(begin + SEGMENT, offsets[1:][doc])
    first, last = np.maximum(begin - RUN_IN, offsets[:-1][doc]), np.minimum(end + RUN_IN, offsets[1:][doc])
    order = np.argsort(last - first, kind="stable")  # segments of one length side by side
    for a in range(0, len(doc), ROWS):
        k = order[a : a + ROWS]
        at = first[k] + np.arange((last - first)[k].max())[:, None]
        codes = np.where(at < last[k], data[np.minimum(at, len(data) - 1)].astype(np.int32), PAD)
        p = probabilities(w, codes)
        p *= (at >= begin[k]) & (at < end[k])
        np.add.at(total, doc[k], p.sum(1).T.astype(np.float64))


def predict(docs: DataFrame, langs: list[str], weights: Weights | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns in keep with the predicted language and its probability, as names."""
    ship = docs.sparkSession.sparkContext.broadcast((langs, weights))
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_langs, w = ship.value
        for batch in batches:
            n = len(batch)
            total = np.zeros((n, max(1, len(known_langs))))
            letters = batch.column(kept + 1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(kept)) if w is not None else ():
                add_up(w, data, offsets, letters[lo:hi], total[lo:hi])
            sums = total.sum(1)
            known = sums > 0
            best = total.argmax(1)
            lang = [known_langs[k] if ok else "und" for k, ok in zip(best, known)]
            value = np.where(known, total[np.arange(n), best] / np.where(known, sums, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(lang, pa.string()), pa.array(value)], names=[*keep, *names])

    rows = docs.select(*keep, text_of().alias("_whole_text"), text_of().rlike(r"\p{L}").alias("_has_letter"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of_id("doc_id", 4) == 2
    langs, weights = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), langs, weights)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
