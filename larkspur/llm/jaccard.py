"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct five-word shingles, and two documents link when
100 * |intersection| >= PERCENT * |union|. Equal sets are one, told by a 128-bit digest of the set, whatever
ids and texts bear it. Shingles are ranked by how many distinct sets
hold them (counted over the whole corpus), rarest first, and only a set's prefix of
n - ceil(t n) + 1 shingles can start a link: a set whose prefix no other set shares has
none, and most sets end there.

The others meet in index lists, one for each prefix shingle:

* First, every set is compared with one pivot, the central set of most of its lists, so n sets cost n pairs. The
  answer is kept as the overlap and the two differences, x - p and p - x.
* Then only sets of one list that those links leave in different components are looked
  at. A list is cut into parts and blocks by set size, each block with its least position and size;
  pairs of blocks which by position and size can't reach the threshold, or that lie in
  one component, are skipped as a whole. For the pairs left, two bounds follow without reading a set: from the
  answers of a pivot that both know, |x∩y| lies between o(x)+o(y)-|p| and min(o(x),o(y)) + min(|x|-o(x),|y|-o(y)); and from
  BITMAP parity bits of each set, 2|x∩y| <= |x|+|y|-hamming.
* What the bounds leave open is derived incrementally from the pivot's answers where both know the same one,
  |x∩y| = |p| - |p-x| - |p-y| + |(p-x)∩(p-y)| + |(x-p)∩(y-p)|, and compared as whole sets otherwise.
* That is done in rounds: in the first, a list gives at most LIMIT pairs for each two components, those with
  the highest bounds, as one link makes the others needless; the last round takes all that are still in different ones.

Every link between sets is either found or joins sets that are connected already, so
components are exact. Nothing grows with the square of a list but the pairs that pass all bounds and link nothing.

Cases: null text is empty; a document without words has an empty set and links with
nothing; fewer words than five are one shingle; rows that share an id, with one text or several, each get the component of their own text; a
null id gets a null component and links with nothing; long texts are hashed in sections; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable, fresh
from . import hashstore
from .bytesops import ODD, U, chunks, distinct_runs, mix, words
from .common import table, text_of
from .components import components
from .hashstore import by_shard, cuts_of

PERCENT, SHINGLE = 80, 5
#: Shingles in a shard of the frequency table, about.
SHARD = 1 << 20
#: Bytes of text whose shingles a task counts together before it sends them.
FLUSH = 24 << 20
#: Rows of an index list that are handled together, and in a block of it; pairs of two components in a first round.
LIST, BLOCK, LIMIT = 500, 50, 16
#: Groups of equal sets, and lists, with more than 1/HEAVY of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 2000
#: Bytes of a shingle hash that are sent besides the first bits, which its range gives; parity bits of a set.
SENT, BITMAP = 6, 256


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of n and m link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in chunks(column):
        yield lo, hi, *distinct_runs(*words(data, offsets), size)


def set_hashes(key: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    def total(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return sums[cut[1:]] - sums[cut[:-1]]

    return total(mix(key ^ ODD[10])), total(mix(key * ODD[11] + ODD[12]))


def read_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, h1, h2) of each row of docs (doc_id, text, more columns, which are carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for lo, hi, key, cut in shingle_sets(batch.column(1), size):
                n[lo:hi] = np.diff(cut)
                a[lo:hi], b[lo:hi] = set_hashes(key, cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *batch.columns[2:]], names=["doc_id", "n", "h1", "h2", *more])

    more = docs.columns[2:]
    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more))


def short_key(key: np.ndarray, fan: int) -> np.ndarray:
    """The first fan bits and SENT bytes after them, in place; the rest of the hash is cleared."""
    clear = U(64 - fan - 8 * SENT)
    return key >> clear << clear


def _pack(key: np.ndarray, fan: int) -> bytes:
    low = (key >> U(64 - fan - 8 * SENT)).astype("<u8")
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def _unpack(raw: bytes, fan: int) -> np.ndarray:
    """Keys without their first fan bits."""
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(raw, np.uint8).reshape(-1, SENT)
    return out.view("<u8").ravel() << U(64 - fan - 8 * SENT)


def unseen(seen: set, names: list, most: int = 1 << 18) -> np.ndarray:
    """Which names a task meets for the first time; what it remembers is bounded, so some may come again."""
    out = np.zeros(len(names), bool)
    for i, h in enumerate(names):
        if h not in seen:
            out[i] = True
            seen.add(h)
    if len(seen) > most:
        seen.clear()
    return out


def count_shared(docs: DataFrame, uri: str, bits: int, size: int, fan: int = hashstore.FAN) -> None:
    """Write the shingles that at least two distinct sets hold, with about how many, as shards to uri.

    A shingle is told by its short key here: one taken for another only makes a set a
    candidate that is compared and found unlike.
    """
    names = ["one", "owners", "runs", "many", "counts"]

    def block(done: int, to: int, key: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[list[bytes]]:
        """Shingles of one set (sorted by it) and of several, by ranges; own is of those with n = 1."""
        columns: list[list[bytes]] = [[] for _ in names]
        for a, b in cuts_of(key << U(done), to):
            one = n[a:b] == 1
            by = np.argsort(own[a:b][one], kind="stable")
            owners, runs = np.unique(own[a:b][one], return_counts=True)
            for column, value in zip(columns, (_pack(key[a:b][one][by], fan), owners.tobytes(), runs.astype("<u4").tobytes(), _pack(key[a:b][~one], fan), n[a:b][~one].astype("<u8").tobytes())):
                column.append(value)
        return columns

    def merged(columns: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Keys, owners and counts (1: one owner) of several blocks."""
        key, own, n = [], [], []
        for one, owners, runs, many, counts in zip(*columns):
            own.append(np.repeat(np.frombuffer(owners, np.uint64), np.frombuffer(runs, "<u4")))
            n += [np.ones(len(own[-1]), np.int64), np.frombuffer(counts, "<i8")]
            own.append(np.zeros(len(n[-1]), np.uint64))
            key += [_unpack(one, fan), _unpack(many, fan)]
        key, own, n = np.concatenate(key), np.concatenate(own), np.concatenate(n)
        order = np.argsort(key, kind="stable")
        key, own, n = key[order], own[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        if not len(key):
            return key, own, n
        low, high, most, total = (f.reduceat(x, first) for f, x in ((np.minimum, own), (np.maximum, own), (np.maximum, n), (np.add, n)))
        return key[first], low, np.where((low == high) & (most == 1), 1, total)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, own = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            columns = block(0, fan, key[first], own[first], np.diff(np.append(first, len(key))))
            return pa.RecordBatch.from_arrays([pa.array(range(1 << fan), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", *names])

        for batch in batches:
            for _, _, key, cut in shingle_sets(batch.column(0), size):
                h1 = set_hashes(key, cut)[0]
                rows = np.repeat(np.arange(len(h1)), np.diff(cut))
                take = unseen(seen, h1.tolist())[rows]
                keys.append(short_key(key[take], fan))
                owners.append(h1[rows[take]])
                held += 20 * len(keys[-1])
                if held > FLUSH:
                    yield flush()
                    keys, owners, held = [], [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for shard, rows in by_shard(batches, len(names)):
            key, _, n = merged(list(zip(*rows)))
            hashstore.write(uri, f"{shard}", key=key[n > 1] | (U(shard >> (bits - fan)) << U(64 - fan)), df=np.minimum(n[n > 1], 2**32 - 1).astype(np.uint32))
            done.append(shard)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    sent = docs.select("text").mapInArrow(send, "shard int, " + ", ".join(f"{n} binary" for n in names))
    dealt = hashstore.dealt(sent, bits, names, lambda c, done, more: block(done, more, *merged(c)), FLUSH, fan)
    dealt.mapInArrow(gather, "shard int").write.format("noop").mode("overwrite").save()


def parity(key: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """BITMAP bits of each set, each the parity of the shingles that fall on it."""
    sets = len(cut) - 1
    slot = np.repeat(np.arange(sets), np.diff(cut)) * BITMAP + (mix(key ^ ODD[14]) & U(BITMAP - 1)).astype(np.int64)
    odd = np.bincount(slot, minlength=sets * BITMAP).reshape(sets, BITMAP) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]


def candidates(docs: DataFrame, shared: str, bits: int, size: int, percent: int, fan: int = hashstore.FAN) -> DataFrame:
    """(id, h1, h2, n, rare, bitmap, shingles) of distinct sets whose prefix another set may share; shingles rarest first, rare of them in no other set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = hashstore.Shards(shared, bits, ("df",))
        seen: set[tuple] = set()
        for batch in batches:
            for lo, hi, key, cut in shingle_sets(batch.column(0), size):
                h1, h2 = set_hashes(key, cut)
                rows = np.repeat(np.arange(hi - lo), np.diff(cut))
                there, df = table_.look_up(short_key(key, fan))
                df = np.where(there, df, 1)
                n = np.diff(cut)
                rare = np.bincount(rows, df == 1, minlength=hi - lo).astype(np.int64)
                prefix = n - -(-percent * n // 100) + 1
                out = np.flatnonzero((n > 0) & (rare < prefix))
                out = out[unseen(seen, list(zip(h1[out].tolist(), h2[out].tolist())))]
                order = np.lexsort((key, df, rows))
                sets = [key[order[cut[i] : cut[i + 1]]] for i in out]
                bits_of = parity(np.concatenate(sets), np.append(0, np.cumsum(n[out]))) if len(out) else []
                cols = [pa.array(h1[out].view(np.int64)), pa.array(h2[out].view(np.int64)), pa.array(n[out], pa.int64()), pa.array(rare[out], pa.int64()), pa.array(bits_of, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "n", "rare", "bitmap", "shingles"])

    found = docs.select("text").mapInArrow(run, "h1 long, h2 long, n long, rare long, bitmap binary, shingles binary")
    return found.dropDuplicates(["h1", "h2"]).withColumn("id", F.monotonically_increasing_id())


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def compared(pairs: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, linked, more, less) of pairs (a, b) of whole sets; more is a - b and less is b - a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap, linked, more, less = [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.sort(_longs(x.as_py())), np.sort(_longs(y.as_py()))
                more.append(np.setdiff1d(x, y, True))
                less.append(np.setdiff1d(y, x, True))
                overlap.append(len(x) - len(more[-1]))
                linked.append(100 * overlap[-1] >= percent * (len(x) + len(less[-1])))
            cols = [pa.array(overlap, pa.int64()), pa.array(linked, pa.bool_()), *(pa.array([d.tobytes() for d in c], pa.binary()) for c in (more, less))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *cols], names=["a", "b", "overlap", "linked", "more", "less"])

    x, y = (cands.select(F.col("id").alias(k), F.col("shingles").alias(v)).hint("merge") for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long, overlap long, linked boolean, more binary, less binary")


def derived(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link, from what both know of one pivot (known: id, pivot, pivot_n, more, less)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, *sides in zip(*(batch.column(c).to_pylist() for c in ("pivot_n", "more_a", "less_a", "more_b", "less_b"))):
                more_x, less_x, more_y, less_y = map(_longs, sides)
                x, y = p - len(less_x) + len(more_x), p - len(less_y) + len(more_y)
                both = p - len(less_x) - len(less_y) + len(np.intersect1d(less_x, less_y, True)) + len(np.intersect1d(more_x, more_y, True))
                linked.append(100 * both >= percent * (x + y - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    x, y = (known.select(F.col("id").alias(k), F.col("more").alias(f"more_{k}"), F.col("less").alias(f"less_{k}"), *(["pivot_n"] if k == "a" else [])).hint("merge") for k in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def open_pairs(n, pos, label, pivot, overlap, pivot_n, side, bitmap, percent: int, limit: int | None) -> tuple[np.ndarray, ...]:
    """Pairs (i, j) of rows of one index list (in size order) that may link and aren't connected, and whether they surely link; and whether limit left some out."""
    out: list[tuple] = []
    block = [(s, min(s + BLOCK, len(n))) for s in range(0, len(n), BLOCK)]
    big = [n[b - 1] for _, b in block]
    room = [(n[a:b] - pos[a:b]).max() for a, b in block]
    one = [label[a] if (label[a:b] == label[a]).all() else None for a, b in block]
    for p, (a, b) in enumerate(block):
        for q in range(p, len(block)):
            c, d = block[q]
            if 100 * big[p] < percent * n[c]:
                break  # all later blocks hold larger sets still
            if one[p] is not None and one[p] == one[q]:
                continue
            if min(room[p], room[q]) < need(n[a], n[c], percent):
                continue
            x, y = np.arange(a, b)[:, None], np.arange(c, d)[None, :]
            least = need(n[x], n[y], percent)
            ok = (x < y) & (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 1)) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)
            both = (pivot[x] == pivot[y]) & (pivot[x] >= 0)
            high = np.where(both, np.minimum(overlap[x], overlap[y]) + np.minimum(n[x] - overlap[x], n[y] - overlap[y]), np.minimum(n[x], n[y]))
            ok &= high >= least
            i, j = np.nonzero(ok)
            i, j = a + i, c + j
            high = np.minimum(high[i - a, j - c], (n[i] + n[j] - np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(1, dtype=np.int64)) // 2)
            fine = high >= least[i - a, j - c]
            i, j, high = i[fine], j[fine], high[fine]
            both = (pivot[i] == pivot[j]) & (pivot[i] >= 0)
            sure = both & (overlap[i] + overlap[j] - pivot_n[i] >= least[i - a, j - c])
            out.append((i, j, sure, both, high - least[i - a, j - c] + (sure << 40)))
    if not out:
        return *(np.empty(0, np.int64),) * 2, *(np.empty(0, bool),) * 2, False
    i, j, sure, both, worth = (np.concatenate(c) for c in zip(*out))
    if limit is None or not len(i):
        return i, j, sure, both, False
    low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    order = np.lexsort((-worth, high, low))
    new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    kept = order[np.arange(len(order)) - start < limit]
    return i[kept], j[kept], sure[kept], both[kept], len(kept) < len(i)


ROWS = ["token", "part", "id", "n", "pos", "label", "pivot", "overlap", "pivot_n", "side", "bitmap"]


def pairs_left(rows: DataFrame, percent: int, limit: int | None) -> DataFrame:
    """(a, b, sure, same, cut) from ROWS, one (token, part) at a time; same: both know one pivot; cut: limit left pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            ids, *cols = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, cols[0]))
            i, j, sure, same, cut = open_pairs(*(c[order] for c in cols), percent, limit)
            ids = ids[order]
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure, pa.bool_()), pa.array(same, pa.bool_()), pa.array(np.full(len(a), cut), pa.bool_())], names=["a", "b", "sure", "same", "cut"])

        now, parts = None, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            cols.append(np.frombuffer(b"".join(batch.column(len(ROWS) - 1).to_pylist()), np.uint64).reshape(len(batch), BITMAP // 64))
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if lo == hi:
                    continue
                if now != (cols[0][lo], cols[1][lo]):
                    if parts:
                        yield close(parts)
                    now, parts = (cols[0][lo], cols[1][lo]), []
                parts.append([c[lo:hi] for c in cols[2:]])
        if parts:
            yield close(parts)

    return rows.select(*ROWS).repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(run, "a long, b long, sure boolean, same boolean, cut boolean")


def in_parts(rows: DataFrame, total: int) -> DataFrame:
    """rows of lists that hold several components, with side (0: the list's largest component, whose sets don't meet each other again) and part.

    Parts hold LIST rows, about; an (other, main) pair of parts meets once, and so does each pair of other parts.
    """
    shares = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    shares = shares.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    shares = durable(shares.select("token", "all", F.col("top.label").alias("main"), F.ceil(F.col("top.c") / LIST).alias("main_parts"), F.ceil((F.col("all") - F.col("top.c")) / LIST).alias("other_parts")), "shares")
    hot, cold = shares.filter(F.col("all") * HEAVY > total).drop("all"), shares.filter(F.col("all") * HEAVY <= total).drop("all")
    rows = rows.join(F.broadcast(hot), "token").unionByName(rows.join(F.broadcast(hot.select("token")), "token", "left_anti").join(cold.hint("merge"), "token"))
    rows = rows.withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 1, F.col("other_parts")).otherwise(F.col("main_parts"))))
    o, m = F.col("other_parts"), F.col("main_parts")
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda k: F.col("own") * m + k)
    with_other = F.transform(F.sequence(F.lit(0).cast("long"), o - 1), lambda k: o * m + F.least(k, F.col("own")) * o + F.greatest(k, F.col("own")))
    for_main = F.transform(F.sequence(F.lit(0).cast("long"), o - 1), lambda k: k * m + F.col("own"))
    meets = F.when(F.col("side") == 0, for_main).otherwise(F.when(o == 1, with_main).otherwise(F.concat(with_main, with_other)))
    return rows.withColumn("part", F.explode(meets))


def link_sets(cands: DataFrame, spark: SparkSession, percent: int) -> DataFrame:
    """(id, component) of the candidates that link with another one."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, pos = [], [], []
            n, rare = batch.column("n").to_numpy(), batch.column("rare").to_numpy()
            for i, raw in enumerate(batch.column("shingles").to_pylist()):
                end = n[i] - -(-percent * n[i] // 100) + 1
                tokens.append(_longs(raw)[rare[i] : end])
                row.append(np.full(end - rare[i], i))
                pos.append(np.arange(rare[i], end))
            row = pa.array(np.concatenate(row) if row else np.empty(0, np.int64), pa.int64())
            token = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), *(batch.column(c).take(row) for c in ("id", "n", "rare")), pa.array(np.concatenate(pos) if pos else np.empty(0, np.int64), pa.int64())], names=["token", "id", "n", "rare", "pos"])

    lists = durable(cands.select("id", "n", "rare", "shingles").mapInArrow(index, "token long, id long, n long, rare long, pos long"), "lists")
    # the list's most central set: the least share of shingles that are its own
    pivots = lists.groupBy("token").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("own"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p"), F.count("*").alias("long"))
    pivots = durable(pivots.filter("long > 1").select("token", "p.pivot", "p.pivot_n", "long"), "pivots")
    total = lists.count()
    hot = F.broadcast(pivots.filter(F.col("long") * HEAVY > total))
    cold = lists.join(hot.select("token"), "token", "left_anti").join(pivots.hint("merge"), "token")
    several = durable(lists.join(hot, "token").unionByName(cold), "several")
    near = several.filter((F.col("id") != F.col("pivot")) & (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")))
    near = near.groupBy("id", "pivot").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", F.col("pivot").alias("b"))).alias("m"))
    first = durable(compared(near.select(F.col("id").alias("a"), "m.b"), cands, percent), "compared")
    sizes = cands.select(F.col("id").alias("b"), F.col("n").alias("pivot_n"))
    known = durable(first.join(sizes, "b").select(F.col("a").alias("id"), F.col("b").alias("pivot"), "pivot_n", "overlap", "more", "less"), "known")
    links = first.filter("linked").select("a", "b")
    joined = components(links)
    used = [lists, pivots, several, first, known]
    facts = several.select("token", "id", "n", "pos").join(cands.select("id", "bitmap").hint("merge"), "id").join(known.select("id", "pivot", "pivot_n", "overlap").hint("merge"), "id", "left")
    for limit in (LIMIT, None):
        rows = facts.join(joined, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("label"), F.coalesce("pivot", F.lit(-1)).alias("pivot"), F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("pivot_n", F.lit(0)).alias("pivot_n"), "bitmap")
        rows = durable(rows, "rows")
        left = durable(pairs_left(in_parts(rows, total), percent, limit).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("sure", "same", "cut")]), "left")
        open_ = left.filter("not sure")
        found = compared(open_.filter("not same"), cands, percent).filter("linked").select("a", "b").unionByName(derived(open_.filter("same"), known, percent)).unionByName(left.filter("sure").select("a", "b"))
        found = durable(found, "found")
        used += [rows, left, found]
        links = links.unionByName(found)
        joined = joined if found.isEmpty() else components(links)
        if left.filter("cut").isEmpty():
            break
    discard(spark, *used)
    return joined  # components() wrote it


def text_digest(text: Column) -> Column:
    """What tells the texts of rows with one id apart."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, shard: int = SHARD, fan: int = hashstore.FAN, with_digest: bool = False) -> DataFrame:
    """id_col, n_shingles and component_id for each row of docs; with text_digest if asked for."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"))
    more = ["text_digest"] if with_digest else []
    told = plain.withColumn("text_digest", text_digest(F.col("text"))) if with_digest else plain
    sets = durable(read_sets(told, size), "sets")
    real = sets.filter("n > 0 and doc_id is not null")
    total, shingles = real.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count("*").alias("copies"))
    groups = durable(groups, "equal")
    bits, shared = hashstore.shard_bits(shingles, shard, fan), fresh(spark, "shared")
    texts = plain.filter("doc_id is not null")
    count_shared(texts, shared, bits, size, fan)
    cands = durable(candidates(texts, shared, bits, size, percent, fan), "candidates")
    discard(spark, shared)
    joined = link_sets(cands, spark, percent)
    linked = cands.select("id", "h1", "h2").join(joined, "id").join(groups.hint("merge"), ["h1", "h2"]).select("h1", "h2", "component", "keep")
    linked = durable(linked, "linked")
    least = linked.groupBy("component").agg(F.min("keep").alias("component_id"))
    of_component = linked.join(least, "component").select("h1", "h2", "component_id")
    # equal or linked sets; all others are their own class
    classes = groups.join(of_component.hint("merge"), ["h1", "h2"], "left").filter("copies > 1 or component_id is not null").select("h1", "h2", "copies", F.coalesce("component_id", "keep").alias("component_id"))
    classes = durable(classes, "classes")
    heavy = F.broadcast(classes.filter(F.col("copies") * HEAVY > total).select("h1", "h2", F.col("component_id").alias("hot")))
    rows = sets.join(heavy, ["h1", "h2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    cold = rows.filter(~alone & F.col("hot").isNull()).drop("hot").join(classes.select("h1", "h2", "component_id").hint("merge"), ["h1", "h2"], "left")
    cold = cold.select("doc_id", "n", *more, F.coalesce("component_id", "doc_id").alias("component_id"))
    hot = rows.filter(alone | F.col("hot").isNotNull()).select("doc_id", "n", *more, F.when(alone, F.col("doc_id")).otherwise(F.col("hot")).alias("component_id"))
    out = durable(cold.unionByName(hot), "components")
    discard(spark, sets, groups, cands, linked, classes)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *more)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
