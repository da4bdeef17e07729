"""Suffix-array dedup by prefix-free parsing: every byte of a LENGTH-byte string that starts earlier goes.

Parse. A rolling hash of GRAM bytes runs over each text; the least hash in each window of
LENGTH bytes is a trigger, so every such window holds one, at a place that only its own
bytes decide. The window starts that share a trigger, with the bytes up to the last one's end, are a
phrase. Equal windows have equal triggers, thus lie in phrases with the same trigger.

Dictionary and parse. All occurrences of phrases, by a 128-bit digest that keeps the trigger's
shard, meet once; a phrase keeps its first place in the corpus and how many distinct
phrases share its trigger. All windows of a phrase's later occurrences are repeats; its
first occurrence has repeats only if other phrases share its trigger. Those
distinct phrases are the dictionary that is left: their suffixes are sorted by suffix
array (prefix doubling up to LENGTH bytes). Phrases overlap by LENGTH - 1 bytes, so a window never runs into the
next phrase, and the parse is sorted by one phrase and its places. Both orders together give the windows of each run of equal
suffixes in the order of the corpus; the first of them stays. A trigger that more than HOT phrases share
(a passage in very many documents) is not gathered: each block of text sorts its own
suffixes of such phrases and sends each distinct one, as a 128-bit hash, to that hash's shard.

A block sends one row to each of a fixed number of ranges (``hashstore.dealt``). The results are
sorted arrays in the shared folder, which workers map into memory for
the last pass over the texts. Nothing but the size of the input comes to the driver.

Cases: null text is empty; texts shorter than LENGTH bytes have no repeats; periodic
texts repeat themselves; long texts are parsed in sections of PARSED bytes that share LENGTH - 1; a null id comes before all
others; rows with the same id count as one place, so a repeated row is no earlier than itself; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, durable, fresh
from . import hashstore
from .bytesops import BYTE_2, ODD, U, mix, powers, prefix_hash, sections, string_views, window_hash
from .common import table, text_of
from .hashstore import by_shard, cuts_of
from .kneser_ney import long, short

LENGTH, GRAM = 100, 32
#: Bytes of text a task works on before it sends; phrases in a shard, about; bytes that are parsed at once.
FLUSH, SHARD, PARSED = 10 << 20, 1 << 19, 1 << 20
#: Phrases of one trigger that are gathered; bytes of dictionary whose suffixes are sorted together.
HOT, SORTED = 4096, 1 << 21
#: Low bits of a trigger's rank that hold its place, so that the leftmost of equals wins.
PLACE = 26
FIRST = np.iinfo(np.int64).min


class Parse:
    """The phrases of a chunk of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int, length: int = LENGTH) -> None:
        self.offsets, self.length = offsets, length
        n = len(data)
        self.prefix, self.second = prefix_hash(data), prefix_hash(data, BYTE_2)
        starts = max(n - length + 1, 0)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if starts:
            rank = mix(window_hash(self.prefix, GRAM))
            low = (rank >> U(PLACE) << U(PLACE)) | (np.arange(len(rank), dtype=np.uint64) & U((1 << PLACE) - 1))
            reach, span = length - GRAM + 1, 1
            while span * 2 <= reach:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < reach:
                low = np.minimum(low[: len(low) - reach + span], low[reach - span :])
            place = (low & U((1 << PLACE) - 1)).astype(np.int64)
            whole = doc[:starts] == doc[length - 1 :]
            new = np.ones(starts, bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:starts] != doc[: starts - 1]) | ~whole[:-1]
            self.first = np.flatnonzero(new & whole)
            stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole)
            self.last = stop
            at = self.first + ((place[self.first] - self.first) & ((1 << PLACE) - 1))
            self.doc = doc[self.first]
            self.trigger = mix(rank[at] + ODD[7])  # least hashes are small; shards go by evenly spread bits
            back = powers(n + 1)[1][self.first]
            text, other = ((h[self.last + length] - h[self.first]) * back for h in (self.prefix, self.second))
            shape = mix((at - self.first).astype(np.uint64) * ODD[5] + (self.last - self.first).astype(np.uint64) * ODD[6])
            self.phrase, self.check = in_shard(mix(text + shape), self.trigger, bits), mix(other ^ shape)
        else:
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.trigger = self.phrase = self.check = np.empty(0, np.uint64)
        self.at = self.first - offsets[self.doc]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen phrases: the place in the chunk of each window, and which of them it is in."""
        size = self.last[chosen] - self.first[chosen] + 1
        of = np.repeat(np.arange(len(chosen)), size)
        return self.first[chosen][of] + np.arange(len(of)) - (np.cumsum(size) - size)[of], of

    def window_keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_keys(self.prefix, self.second, start, self.length)


def window_keys(prefix: np.ndarray, second: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows."""
    back = powers(len(prefix))[1][start]
    return tuple(mix((h[start + length] - h[start]) * back) for h in (prefix, second))


def in_shard(h: np.ndarray, trigger: np.ndarray, bits: int) -> np.ndarray:
    """h with the top bits of trigger."""
    low = U((1 << (64 - bits)) - 1)
    return (h & low) | (trigger & ~low)


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of text at starts, by the first length bytes, and where runs of equal ones begin in it."""
    ranks, size = {1: np.concatenate([text, np.zeros(length, np.uint8)]).astype(np.uint64)}, 1
    while size * 2 <= length:
        half = ranks[size]
        joined = half[:-size] << U(min(8 * size, 32)) | half[size:]
        size *= 2
        # from 8 bytes on, ranks among the text's own substrings stand for them
        ranks[size] = np.unique(joined, return_inverse=True)[1].astype(np.uint64) if size >= 8 else joined
    done, key = 0, np.zeros(len(starts), np.uint64)
    for size in sorted(ranks, reverse=True):
        if length - done >= size:
            key = np.unique(key << U(32) | ranks[size][starts + done], return_inverse=True)[1].astype(np.uint64)
            done += size
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(order) else np.empty(0, np.int64)


def first_places(key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each distinct (key, check), sorted by key: the row of its first place, and its total count."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    several = (np.append(same, False) | np.append(False, same))[: len(key)]  # few keys are there twice; only those are sorted by place
    rows = order[several]
    order[several] = rows[np.lexsort((at[rows], doc[rows], check[rows], key[rows]))]
    ranked, second = key[order], check[order]
    new = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]) | (second[1:] != second[:-1]))) if len(key) else np.empty(0, np.int64)
    return ranked[new], order[new], np.add.reduceat(count[order], new) if len(key) else count


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(FIRST).to_numpy(zero_copy_only=False)


def parts_of(key: np.ndarray, done: int, to: int, *columns: np.ndarray) -> list[list[bytes]]:
    """The bytes of each column's parts, by the ranges of sorted keys below their first done bits."""
    cuts = cuts_of(key << U(done), to)
    return [[c[a:b].tobytes() for a, b in cuts] for c in columns]


def row_batch(names: list[str], columns: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(columns[0])), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", *names])


def schema_of(names: list[str]) -> str:
    return "shard int, " + ", ".join(f"{n} binary" for n in names)


def unpacked(columns: list[list[bytes]], kinds: tuple) -> list[np.ndarray]:
    """Blocks' columns, one after the other; a kind is a type, or a function."""
    return [np.concatenate([k(r) if callable(k) and not isinstance(k, type) else np.frombuffer(r, k) for r in c]) for c, k in zip(columns, kinds)]


def find_phrases(docs: DataFrame, uri: str, bits: int, fan: int = hashstore.FAN) -> None:
    """First places of phrases that occur again, and triggers that several distinct phrases share, in uri/phrases."""
    names, kinds = ["phrases", "checks", "triggers", "docs", "places", "again"], (np.uint64, np.uint64, long, np.int64, "<u4", np.uint8)

    def block(done: int, to: int, phrase, check, trigger, doc, at, n) -> list[list[bytes]]:
        key, row, n = first_places(phrase, check, doc, at, n)
        cuts = cuts_of(key << U(done), to)
        return [*parts_of(key, done, to, key, check[row]), [short(trigger[row][a:b]) for a, b in cuts], *parts_of(key, done, to, doc[row], at[row].astype("<u4"), (n > 1).astype(np.uint8))]

    def merged(columns: list[list[bytes]]) -> list[np.ndarray]:
        *cols, again = unpacked(columns, kinds)
        return [*cols, 1 + again.astype(np.int64)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            phrase, check, trigger, doc, at = (np.concatenate(c) for c in zip(*parts))
            return row_batch(names, block(0, fan, phrase, check, trigger, doc, at, np.ones(len(phrase), np.int64)))

        for batch in batches:
            ids = ids_of(batch.column(0))
            for rows, base, data, offsets in sections(batch.column(1), PARSED, LENGTH - 1):
                p = Parse(data, offsets, bits)
                parts.append((p.phrase, p.check, p.trigger, ids[rows][p.doc], p.at + base[p.doc]))
                held += len(data)
                if held > FLUSH:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for shard, rows in by_shard(batches, len(names)):
            phrase, check, trigger, doc, at, n = merged(list(zip(*rows)))
            key, row, n = first_places(phrase, check, doc, at, n)
            many = n > 1
            names_, of = np.unique(trigger[row], return_counts=True)
            hashstore.write(f"{uri}/phrases", f"{shard}", key=key[many], check=check[row][many], doc=doc[row][many], at=at[row][many].astype(np.int64), trigger_key=names_[of > 1], trigger_kinds=of[of > 1].astype(np.int64))
            done.append(shard)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    sent = hashstore.dealt(docs.mapInArrow(send, schema_of(names)), bits, names, lambda c, done, more: block(done, more, *merged(c)), FLUSH, fan)
    sent.mapInArrow(gather, "shard int").write.format("noop").mode("overwrite").save()


class Found:
    """A worker's view of what find_phrases wrote."""

    def __init__(self, uri: str, bits: int, hot: int) -> None:
        self.hot = hot
        self.phrases = hashstore.Shards(f"{uri}/phrases", bits, ("doc", "at"), checked=True)
        self.triggers = hashstore.Shards(f"{uri}/phrases", bits, ("kinds",), "trigger_")

    def classify(self, p: Parse, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each phrase (its document's id and its place there): whether it was there before, and whether its windows must be looked at, warm or hot."""
        again, doc, first = self.phrases.look_up(p.phrase, p.check)
        later = again & ((doc < ids) | ((doc == ids) & (first < at)))
        _, kinds = self.triggers.look_up(long(short(p.trigger)))
        return later, ~later & (kinds > 1) & (kinds <= self.hot), ~later & (kinds > self.hot)


def find_windows(docs: DataFrame, uri: str, bits: int, hot_limit: int = HOT, fan: int = hashstore.FAN) -> None:
    """First places of windows that several of the phrases left have, in uri/windows, from suffix arrays."""
    names = ["triggers", "docs", "places", "sizes", "texts", "hot_keys", "hot_checks", "hot_docs", "hot_places", "hot_counts"]
    kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint64, np.uint64, np.int64, np.int64, "<u4")

    def block(done: int, to: int, trigger, doc, at, size, text, key, check, hot_doc, hot_at, n) -> list[list[bytes]]:
        order = np.argsort(trigger, kind="stable")
        begin, ends = (np.cumsum(size) - size)[order], np.append(0, np.cumsum(size[order]))
        text = text[np.repeat(begin - ends[:-1], size[order]) + np.arange(ends[-1])]
        cuts = cuts_of(trigger[order] << U(done), to)
        columns = parts_of(trigger[order], done, to, *(c[order] for c in (trigger, doc, at, size)))
        key, row, n = first_places(key, check, hot_doc, hot_at, n.astype(np.int64))
        return [*columns, [text[ends[a] : ends[b]].tobytes() for a, b in cuts], *parts_of(key, done, to, key, check[row], hot_doc[row], hot_at[row], n.astype("<u4"))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(uri, bits, hot_limit)
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            return row_batch(names, block(0, fan, *(np.concatenate(c) for c in zip(*parts))))

        for batch in batches:
            ids = ids_of(batch.column(0))
            for rows, base, data, offsets in sections(batch.column(1), PARSED, LENGTH - 1):
                p = Parse(data, offsets, bits)
                mine, at = ids[rows][p.doc], p.at + base[p.doc]
                _, warm, hot = found.classify(p, mine, at)
                w, (start, of) = np.flatnonzero(warm), p.windows(h := np.flatnonzero(hot))
                size = p.last[w] - p.first[w] + p.length
                take = np.repeat(p.first[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                key, check = p.window_keys(start)
                parts.append((p.trigger[w], mine[w], at[w], size, data[take], key, check, mine[h][of], at[h][of] + start - p.first[h][of], np.ones(len(of), "<u4")))
                held += len(data)
                if held > FLUSH:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for shard, rows in by_shard(batches, len(names)):
            warm, (key, check, doc, at, n) = (x := unpacked(list(zip(*rows)), kinds))[:5], x[5:]
            key, row, n = first_places(key, check, doc, at, n.astype(np.int64))
            hot = key[n > 1], check[row][n > 1], doc[row][n > 1], at[row][n > 1]
            key, check, doc, at = (np.concatenate(c) for c in zip(hot, *sorted_suffixes(*warm, bits)))
            order = np.argsort(key, kind="stable")
            hashstore.write(f"{uri}/windows", f"{shard}", key=key[order], check=check[order], doc=doc[order], at=at[order])
            done.append(shard)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    sent = hashstore.dealt(docs.mapInArrow(send, schema_of(names)), bits, names, lambda c, done, more: block(done, more, *unpacked(c, kinds)), FLUSH, fan)
    sent.mapInArrow(gather, "shard int").write.format("noop").mode("overwrite").save()


def sorted_suffixes(trigger: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, text: np.ndarray, bits: int, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, check, doc, at) of the first place of every window that several phrases share; phrases of one trigger stay together."""
    if not len(trigger):
        return
    begin = np.cumsum(size) - size
    order = np.argsort(trigger, kind="stable")
    trigger = trigger[order]
    groups = np.append(np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1])), len(order))
    ends = np.append(0, np.cumsum(size[order]))
    a = 0
    while a < len(groups) - 1:
        b = max(a + 1, int(np.searchsorted(ends[groups], ends[groups[a]] + SORTED, side="right")) - 1)
        rows_ = order[groups[a] : groups[b]]
        own = size[rows_]
        start = np.cumsum(own) - own
        take = np.repeat(begin[rows_] - start, own) + np.arange(own.sum())
        part = text[take]
        windows = own - length + 1
        of = np.repeat(np.arange(len(rows_)), windows)
        inside = np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
        suffix = start[of] + inside
        ranked, runs = suffix_order(part, suffix, length)
        several = np.diff(np.append(runs, len(ranked))) > 1
        if several.any():
            run = np.cumsum(np.isin(np.arange(len(ranked)), runs)) - 1
            d, p = doc[rows_][of][ranked], (at[rows_][of] + inside)[ranked]
            by = np.lexsort((p, d, run))
            first = by[np.append(True, run[by][1:] != run[by][:-1])][several]
            key, check = window_keys(prefix_hash(part), prefix_hash(part, BYTE_2), suffix[ranked[first]], length)
            yield in_shard(key, trigger[groups[a] : groups[b]][of[ranked[first]]], bits), check, d[first], p[first]
        a = b


def remove(docs: DataFrame, uri: str, bits: int, with_kept: bool = False, hot_limit: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the spans removed and the bytes kept."""
    extra = [("spans", pa.list_(pa.int64())), ("kept", pa.binary())] if with_kept else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(uri, bits, hot_limit)
        known = hashstore.Shards(f"{uri}/windows", bits, ("doc", "at"), checked=True)

        def repeated(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, base: np.ndarray) -> np.ndarray:
            """Which bytes some window covers that starts earlier too."""
            p = Parse(data, offsets, bits)
            mine, place = ids[p.doc], p.at + base[p.doc]
            later, warm, hot = found.classify(p, mine, place)
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, p.first[later], 1)
            np.add.at(cover, p.last[later] + p.length, -1)
            for chosen, is_hot in ((np.flatnonzero(warm), False), (np.flatnonzero(hot), True)):
                if not len(chosen):
                    continue
                start, of = p.windows(chosen)
                key, check = p.window_keys(start)
                there, doc, at = known.look_up(key if is_hot else in_shard(key, p.trigger[chosen][of], bits), check)
                own = mine[chosen][of]
                repeat = start[there & ((doc < own) | ((doc == own) & (at < place[chosen][of] + start - p.first[chosen][of])))]
                cover[: len(data)] += np.bincount(repeat, minlength=len(data))[: len(data)].astype(np.int32)
                cover -= np.bincount(repeat + p.length, minlength=len(data) + 1).astype(np.int32)
            return np.cumsum(cover[:-1]) > 0

        for batch in batches:
            ids, n = ids_of(batch.column(0)), len(batch)
            size, gone, spans, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            cut, kept = [[]] * n, [b""] * n

            def close(i: int, text: np.ndarray, part: np.ndarray) -> None:
                size[i], gone[i] = len(text), np.count_nonzero(part)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                spans[i] = len(edge) // 2
                rest = text[~part].tobytes() if gone[i] else text.tobytes()
                digest[i] = hashlib.sha256(rest).hexdigest()
                if with_kept:
                    cut[i], kept[i] = edge.tolist(), rest

            whole, mask = string_views(batch.column(1)), np.empty(0, bool)
            for rows, base, data, offsets in sections(batch.column(1), PARSED, LENGTH - 1):
                out = repeated(data, offsets, ids[rows], base)
                first, last = whole[1][rows[0]], whole[1][rows[-1] + 1]
                if last - first == len(data):
                    for k, i in enumerate(rows.tolist()):
                        a, b = offsets[k], offsets[k + 1]
                        close(i, data[a:b], out[a:b])
                    continue
                if not base[0]:  # the first section of a long text
                    mask = np.zeros(last - first, bool)
                mask[base[0] : base[0] + len(data)] |= out
                if base[0] + len(data) == last - first:
                    close(int(rows[0]), whole[0][first:last], mask)
            cols = [batch.column(0), *(pa.array(x) for x in (size, gone, spans)), pa.array(digest), *((pa.array(cut, extra[0][1]), pa.array(kept, extra[1][1])) if with_kept else ())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(e[0] for e in extra)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.mapInArrow(run, schema + (", spans array<long>, kept binary" if with_kept else ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_kept: bool = False, hot_limit: int = HOT, shard: int = SHARD, fan: int = hashstore.FAN) -> DataFrame:
    """What is left of each text when repeats of LENGTH bytes are removed; spans are [start, end, start, end, ...] in bytes."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = hashstore.shard_bits(size / 35, shard, fan)
    uri = fresh(spark, "repeats")
    find_phrases(plain, uri, bits, fan)
    find_windows(plain, uri, bits, hot_limit, fan)
    out = durable(remove(plain, uri, bits, with_kept, hot_limit), "kept")
    discard(spark, uri)
    return out.withColumnRenamed("doc_id", id_col)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
