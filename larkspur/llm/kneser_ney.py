"""LM scoring: interpolated modified Kneser-Ney over word bigrams.

Counting. A task counts the bigrams and words of a block of text in numpy and sends
each distinct one once, to the shard of its hash; bigrams are dealt by the hash of both
words, so a frequent word or pair weighs on no single task. A block sends one row to each of a fixed number of
ranges, which are dealt on where there are more shards than that (``hashstore.dealt``), so rows grow with the input.
A shard adds up its blocks, writes its bigrams as sorted hash arrays, and passes on what its distinct bigrams say about
their words: continuation counts of the second, and totals of the first as a context.
Those meet in a second round, by word.

Scoring. Workers map the arrays into memory, at most ``hashstore.OPEN`` shards at a time, and look up whole blocks of
tokens at once, in the order of their shards. A shard that is missing fails the job.

    p(w|v) = (c(vw) - D(c(vw))) / c(v.) + g(v) p(w)
    p(w) = (N(.w) - D'(N(.w))) / N(..) + g' / (V + 1)

with the three discounts of modified Kneser-Ney at each order (from counts of counts),
g the mass they leave, V the distinct training tokens and one more for all unknown
ones; the begin of a text is a context, its end a token. Bigrams, because the trigram types of a
corpus, which are nearly as many as its tokens, would take more disk than there is.

Words are told apart by 64-bit hashes, words inside bigrams by WORD_BYTES bytes of them.

Cases: null text is empty: one token, the end. Repeated rows train and are scored each.
Without training text every p(w) is 1 and base_score is 0 (log10 of 0.5 / 0.5). A null
id counts as held in; extra columns are not read. A long text is scored in one piece. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable, fresh
from . import hashstore
from .bytesops import ODD, U, chunks, mix, words
from .common import bucket_of_id, table, text_of
from .hashstore import by_shard, cuts_of

#: Bytes of text that are counted together; bigrams in a shard, about; bytes of a word's hash in a bigram.
FLUSH, SHARD, WORD_BYTES = 10 << 20, 1 << 20, 5
BEGIN, END = U(0x5BD1E9955BD1E995), U(0xC2B2AE3D27D4EB4F)
_CUT = U(64 - 8 * WORD_BYTES)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each document's, and the n + 1 offsets."""
    h, starts = words(data, offsets)
    docs = len(starts) - 1
    out = np.full(len(h) + docs, END)
    out[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(starts))] = h
    return out, starts + np.arange(docs + 1)


def before(token: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each one."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[starts[:-1]] = BEGIN
    return out


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix((first >> _CUT) * ODD[13] + mix(second >> _CUT))


def tally(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, where each first is, and sums of counts."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(key) else np.empty(0, np.int64)
    return ranked[first], order[first], *((np.add.reduceat(c[order], first) if len(key) else c) for c in counts)


def short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h >> _CUT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel() << _CUT


def counts_out(n: np.ndarray) -> bytes:
    return n.astype("<u4" if n.max(initial=0) < 1 << 32 else "<u8").tobytes()


def counts_in(raw: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * entries else "<u8").astype(np.int64)


def joined(rows: list, keys: int, values: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Keys (of width bytes) and counts of several blocks, one after the other."""
    read = (lambda r: np.frombuffer(r, np.uint64)) if width == 8 else long
    return np.concatenate([read(r[keys]) for r in rows]), np.concatenate([counts_in(r[values], len(r[keys]) // width) for r in rows])


class Model:
    """Where the arrays are, and the numbers that belong to all of them."""

    def __init__(self, uri: str, bits: int, total: int, distinct: int, pairs: list[int], heads: list[int]) -> None:
        self.uri, self.bits, self.total, self.distinct = uri, bits, total, distinct
        self.pair_discount, self.head_discount = discounts(pairs[:4]), discounts(heads[:4])
        self.types = heads[4]
        d = self.head_discount
        left = d[1] * heads[0] + d[2] * heads[1] + d[3] * (heads[5] - heads[0] - heads[1])
        self.unseen = (left / self.types if self.types else 1.0) / (distinct + 1)


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) from the numbers of things counted once, twice, three and four times."""
    n1, n2, n3, n4 = (max(int(x), 0) for x in n)
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.clip(d, 0, [0, 1, 2, 3])


def count(docs: DataFrame, spark: SparkSession, shard: int = SHARD, fan: int = hashstore.FAN) -> Model:
    """Count docs' text into a model in the shared folder."""
    uri = fresh(spark, "ngrams")
    size = docs.select(F.coalesce(F.sum(F.octet_length("text") / 6.0), F.lit(0.0))).first()[0]
    bits = hashstore.shard_bits(size, shard, fan)
    blocks, links = ["words", "word_counts", "firsts", "seconds", "counts"], ["contexts", "totals", "heads", "lefts"]

    def block(word: np.ndarray, many: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray, key: np.ndarray, done: int, to: int) -> list[list[bytes]]:
        """Columns with a part for each of 2 ** to ranges below the first done bits; words and keys are sorted."""
        w, p = cuts_of(word << U(done), to), cuts_of(key << U(done), to)
        return [[word[a:b].tobytes() for a, b in w], [counts_out(many[a:b]) for a, b in w], [short(first[a:b]) for a, b in p], [short(second[a:b]) for a, b in p], [counts_out(n[a:b]) for a, b in p]]

    def merge_pairs(columns: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        rows = list(zip(*columns))
        word, _, many = tally(*joined(rows, 0, 1))
        (first, n), second = joined(rows, 2, 4, WORD_BYTES), np.concatenate([long(r[3]) for r in rows])
        key, at, n = tally(pair_key(first, second), n)
        return word, many, first[at], second[at], n, key

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([p[0] for p in pending])
            first = np.concatenate([p[1] for p in pending])
            word, _, many = tally(token, np.ones(len(token), np.int64))
            key, at, n = tally(pair_key(first, token), np.ones(len(token), np.int64))
            columns = block(word, many, first[at], token[at], n, key, 0, fan)
            return pa.RecordBatch.from_arrays([pa.array(range(1 << fan), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", *blocks])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                token, starts = tokens(data, offsets)
                pending.append((token, before(token, starts)))
                held += len(data) + 1
                if held > FLUSH:
                    yield flush()
                    pending, held = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches, len(blocks)):
            word, many, first, second, n, key = merge_pairs(list(zip(*rows)))
            hashstore.write(f"{uri}/pairs", f"{shard}", word_key=word, word_n=many, once_key=key[n == 1], more_key=key[n > 1], more_n=n[n > 1])
            context, _, *sums = tally(first, n, *((n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64)))
            head, _, lefts = tally(second, np.ones(len(n), np.int64))
            stats = [int(many.sum()), len(word), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
            columns = link(context, np.stack(sums), head, lefts, 0, fan)
            kinds = [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(range(1 << fan), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array([stats] + [[0] * 6] * ((1 << fan) - 1), pa.list_(pa.int64()))], names=["shard", *links, "stats"])

    def link(context: np.ndarray, sums: np.ndarray, head: np.ndarray, lefts: np.ndarray, done: int, to: int) -> list[list[bytes]]:
        c, h = cuts_of(context << U(done), to), cuts_of(head << U(done), to)
        return [[short(context[a:b]) for a, b in c], [counts_out(sums[:, a:b].ravel()) for a, b in c], [short(head[a:b]) for a, b in h], [counts_out(lefts[a:b]) for a, b in h]]

    def merge_links(columns: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        rows = list(zip(*columns))
        sums = []
        for r in rows:
            n = len(r[0]) // WORD_BYTES
            sums.append(counts_in(r[1], 4 * n).reshape(4, n))
        context, _, *sums = tally(np.concatenate([long(r[0]) for r in rows]), *np.concatenate(sums, 1))
        head, _, lefts = tally(*joined(rows, 2, 3, WORD_BYTES))
        return context, np.stack(sums), head, lefts

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for shard, rows in by_shard(batches, len(links)):
            context, (total, n1, n2, n3), head, lefts = merge_links(list(zip(*rows)))
            hashstore.write(f"{uri}/words", f"{shard}", context_key=context, context_total=total, context_n1=n1, context_n2=n2, context_n3=n3, head_key=head, head_lefts=lefts)
            out.append([*(int((lefts == k).sum()) for k in (1, 2, 3, 4)), int(lefts.sum()), len(head)])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["stats"])

    def add_up(df: DataFrame) -> list[int]:
        return [int(x or 0) for x in df.select(*[F.sum(F.get("stats", F.lit(i))) for i in range(6)]).first()]

    schema = lambda names: ", ".join(["shard int", *(f"{f} binary" for f in names)])
    sent = hashstore.dealt(docs.select("text").mapInArrow(send, schema(blocks)), bits, blocks, lambda c, done, more: block(*merge_pairs(c), done, more), FLUSH, fan)
    passed = durable(sent.mapInArrow(gather, schema(links) + ", stats array<long>"), "passed")
    total, distinct, *pairs = add_up(passed)
    again = hashstore.dealt(passed.drop("stats"), bits, links, lambda c, done, more: link(*merge_links(c), done, more), FLUSH, fan)
    counted = durable(again.mapInArrow(finish, "stats array<long>"), "heads")
    heads = add_up(counted)
    discard(spark, passed, counted)
    return Model(uri, bits, total, distinct, pairs, heads)


class Reader:
    """A worker's view of a model."""

    def __init__(self, m: Model) -> None:
        self.m = m
        pairs, words = (lambda part, *values, store=store: hashstore.Shards(f"{m.uri}/{store}", m.bits, values, part) for store in ("pairs", "words"))
        self.word, self.once, self.more = pairs("word_", "n"), pairs("once_"), pairs("more_", "n")
        self.context, self.head = words("context_", "total", "n1", "n2", "n3"), words("head_", "lefts")

    def score(self, token: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability of each token."""
        m = self.m
        distinct, where = np.unique(token, return_inverse=True)
        n = self.word.look_up(distinct)[1]
        lefts = self.head.look_up(distinct >> _CUT << _CUT)[1]
        d = m.head_discount[np.minimum(lefts, 3)]
        p = ((lefts - d) / m.types if m.types else 0.0) + m.unseen
        heads, came = np.unique(previous, return_inverse=True)
        _, total, n1, n2, n3 = self.context.look_up(heads >> _CUT << _CUT)
        d = m.pair_discount
        left = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        key = pair_key(previous, token)
        there, c = self.more.look_up(key)
        rest = np.flatnonzero(~there)
        c[rest] = self.once.look_up(key[rest])[0]
        p = (c - d[np.minimum(c, 3)]) / np.maximum(total[came], 1) + left[came] * p[where]
        return n[where], np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each of docs (doc_id, text)."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ship.value
        reader = Reader(m)
        for batch in batches:
            out = np.zeros((4, len(batch)))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                token, starts = tokens(data, offsets)
                n, logp = reader.score(token, before(token, starts))
                base = np.log10((n + 0.5) / (m.total + 0.5 * (m.distinct + 1)))
                out[0, lo:hi] = np.diff(starts)
                for k, x in enumerate(((n > 0).astype(float), base, logp)):
                    out[k + 1, lo:hi] = np.add.reduceat(x, starts[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in out[:2]), *(pa.array(x) for x in out[2:])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    held_out = F.coalesce(bucket_of_id("doc_id", 5) == 1, F.lit(False))
    model = count(docs.filter(~held_out), spark)
    scored = durable(score(docs, model), "scored")
    discard(spark, model.uri)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
