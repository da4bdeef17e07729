"""Arrays in the shared folder that workers map into memory.

A store is a folder with one file a shard; a file holds named arrays behind a header. A
shard is written under a name of its own and then renamed, so a repeated or
speculative task leaves the same whole file. Every shard of a store is written, empty ones
too, and reading one that is not there raises: a lost file is never taken for an empty one.

Paths are URIs as Hadoop's file system has them (``common.fresh``). Where the shared folder is a mounted
file system, workers map the files as they are, without keeping a file handle; from another store (through
pyarrow's file systems) a worker fetches a shard to its own temporary folder. At most OPEN
shards are mapped, or fetched, at once in a worker, however many there are.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa

#: Shards that a worker has open at once.
OPEN = 128
ALIGN = 64

_open: OrderedDict[str, tuple[dict[str, np.ndarray], str | None]] = OrderedDict()
_folder: list[str] = []


def local_path(uri: str) -> str | None:
    """The path of a file: URI; None for other stores."""
    parts = urlparse(uri)
    if not parts.scheme:
        raise ValueError(f"not a URI: {uri}")
    return unquote(parts.path) if parts.scheme == "file" else None


def _remote(uri: str):
    from pyarrow import fs

    parts = urlparse(uri)
    scheme = "s3" if parts.scheme in ("s3a", "s3n") else parts.scheme
    return fs.FileSystem.from_uri(parts._replace(scheme=scheme).geturl())


def write(uri: str, name: str, **arrays: np.ndarray) -> None:
    """Write one shard."""
    arrays = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    parts = [len(head).to_bytes(8, "little") + head]
    size = len(parts[0])
    for a in arrays.values():
        parts += [bytes(-size % ALIGN), a.data if len(a) else b""]
        size += -size % ALIGN + a.nbytes
    path, part = local_path(uri), f"{name}.{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{part}", "wb") as out:
            for p in parts:
                out.write(p)
        os.replace(f"{path}/{part}", f"{path}/{name}")
        return
    store, path = _remote(uri)
    store.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}/{part}") as out:
        for p in parts:
            out.write(p)
    store.move(f"{path}/{part}", f"{path}/{name}")


def read(uri: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a shard, mapped. FileNotFoundError if it is not there."""
    key = f"{uri}/{name}"
    if key in _open:
        _open.move_to_end(key)
        return _open[key][0]
    path, fetched = local_path(uri), None
    path = fetched = _fetch(uri, name) if path is None else None
    path = path or f"{local_path(uri)}/{name}"
    with open(path, "rb") as f:
        kept = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        raw = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **kept))
    at = 8 + int.from_bytes(raw[:8], "little")
    arrays = {}
    for field, kind, n in json.loads(bytes(raw[8:at])):
        at += -at % ALIGN
        arrays[field] = np.frombuffer(raw, kind, n, at) if n else np.empty(0, kind)
        at += np.dtype(kind).itemsize * n
    _open[key] = arrays, fetched
    while len(_open) > OPEN:
        _, (_, old) = _open.popitem(last=False)  # unmapped with the last array that uses it
        if old is not None:
            os.remove(old)
    return arrays


def _fetch(uri: str, name: str) -> str:
    from pyarrow import fs

    if not _folder:
        _folder.append(tempfile.mkdtemp())
        atexit.register(shutil.rmtree, _folder[0], True)
    store, path = _remote(uri)
    copy = f"{_folder[0]}/{uuid.uuid4().hex}"
    fs.copy_files(f"{path}/{name}", copy, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
    return copy


def cuts_of(key: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Where each of 2 ** bits ranges' keys are among sorted ones."""
    inner = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
    return list(zip([0, *inner], [*inner, len(key)]))


class Shards:
    """Sorted keys with values in 2 ** bits shards, shard k holding the keys whose top bits are k.

    With a second hash (the field check), keys are told apart by both, and may repeat.
    """

    def __init__(self, uri: str, bits: int, values: tuple[str, ...], part: str = "", checked: bool = False) -> None:
        self.uri, self.bits, self.checked = uri, bits, checked
        self.key, self.check, *self.values = (f"{part}{n}" for n in ("key", "check", *values))

    def look_up(self, keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Whether each key is there, and its values as int64 (0 where not)."""
        there = np.zeros(len(keys), bool)
        out = [np.zeros(len(keys), np.int64) for _ in self.values]
        order = np.argsort(keys)
        ranked = keys[order]
        shard = ranked >> np.uint64(64 - self.bits)
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
        for lo, hi in zip(starts, [*starts[1:], len(shard)]):
            arrays = read(self.uri, f"{shard[lo]}")
            have = arrays[self.key]
            if not len(have):
                continue
            part, rows = ranked[lo:hi], order[lo:hi]
            at = np.searchsorted(have, part)
            at[at == len(have)] = 0
            hit = have[at] == part
            if self.checked:
                want, second = checks[rows], arrays[self.check]
                again = np.flatnonzero(hit & (second[at] != want))
                while len(again):  # look at the next one with that key
                    after = at[again] + 1
                    same = (after < len(have)) & (have[np.minimum(after, len(have) - 1)] == part[again])
                    hit[again[~same]] = False
                    again = again[same]
                    at[again] = after[same]
                    again = again[second[at[again]] != want[again]]
            there[rows[hit]] = True
            for o, name in zip(out, self.values):
                o[rows[hit]] = arrays[name][at[hit]]
        return (there, *out)


# -- dealing blocks out to shards

#: Bits of a shard's number that one exchange deals by.
FAN = 7


def shard_bits(entries: float, each: int, fan: int = FAN) -> int:
    """Bits for shards of about so many entries; fan at least, so that small inputs are dealt like large ones."""
    return max(fan, int(entries // each).bit_length())


def dealt(rows, bits: int, fields: list[str], merge, flush: int, fan: int = FAN):
    """rows (shard, fields: binary) of blocks dealt by their shard's first fan bits -> by all bits, a block in order of its shard.

    A block sends 2 ** fan rows however many shards there are. Where there are more, each
    exchange deals on by the next fan bits: a task gathers the rows of one range up to
    flush bytes, merges them, and sends one row for each of the range's parts. So rows grow
    with the input. merge(columns of parts, done bits, new bits) gives the parts' columns. Every
    shard gets one empty row, so that it is written even if nothing falls into it.
    """
    from pyspark.sql import functions as F

    schema = "shard int, " + ", ".join(f"{f} binary" for f in fields)
    done = min(fan, bits)
    while done < bits:
        more = min(fan, bits - done)
        # a range is dealt to several tasks by the blocks' own bytes
        rows = rows.repartition(1 << (done + more), "shard", F.pmod(F.xxhash64(*fields), F.lit(1 << more))).sortWithinPartitions("shard")

        def spread(batches, done=done, more=more):
            def send(shard, parts):
                columns = merge([list(c) for c in zip(*parts)], done, more)
                return pa.RecordBatch.from_arrays([pa.array([(shard << more) + k for k in range(1 << more)], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", *fields])

            now, parts, held = None, [], 0
            for batch in batches:
                for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if parts and (shard != now or held > flush):
                        yield send(now, parts)
                        parts, held = [], 0
                    now = shard
                    parts.append(row)
                    held += sum(map(len, row))
            if parts:
                yield send(now, parts)

        rows = rows.mapInArrow(spread, schema)
        done += more
    spark = rows.sparkSession
    marks = spark.range(1 << bits).select(F.col("id").cast("int").alias("shard"), *[F.lit(b"").alias(f) for f in fields])
    return rows.unionByName(marks).repartitionById(1 << bits, "shard").sortWithinPartitions("shard")


def by_shard(batches, fields: int):
    """(shard, its rows without the shard) of batches that are sorted by their first column."""
    now, rows = None, []
    for batch in batches:
        for shard, *row in zip(*(batch.column(i).to_pylist() for i in range(fields + 1))):
            if shard != now:
                if rows:
                    yield now, rows
                now, rows = shard, []
            rows.append(row)
    if rows:
        yield now, rows
