"""Fast ids for a word-level BPE tokenizer file (lower case, white space dropped, byte-level words).

Such a tokenizer never merges across white space, so a block of texts is cut at spaces,
its distinct chunks are cut into distinct pieces, and the tokenizer's own model sees each
piece that isn't remembered, once; ids are put together by Arrow. Ids equal
``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that share their chunks.
BLOCK = 4 << 20
#: Bytes of pieces and their ids, each counted with the objects' own size, beyond which only those of the next block stay remembered.
REMEMBERED, OBJECT = 16 << 20, 200
#: Where texts are cut; other white space is left to the pieces.
SPACES = re.compile(r"[ \n\t\r]")
#: Unicode white space, for use inside a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordIds:
    """Ids of texts, by blocks; pieces are remembered from block to block."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        pattern = next(p["pattern"]["Regex"] for p in spec["pretokenizers"] if p["type"] == "Split")
        # \s would also match the separators U+001C to U+001F, which aren't Unicode white space
        self.pieces = regex.compile(pattern.replace(r"\s", WHITE)).findall
        self.table = {i: c for i, c in enumerate(byte_chars())}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def normal(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.tokenizer.normalizer.normalize_str(text)
        return text.lower()  # composed already, and each letter has one lower case

    def piece(self, piece: str) -> bytes:
        raw = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def chunk_ids(self, chunks: list[str]) -> pa.LargeListArray:
        """The ids of each of some distinct chunks."""
        older: dict[str, bytes] = {}
        if self.held > REMEMBERED:
            older, self.known, self.held = self.known, {}, 0
        known, out = self.known, []
        for chunk in chunks:
            if chunk.isalpha():  # one piece; chunks are normalized already
                parts = (chunk,)
            elif (word := chunk[:-1]).isalpha() and chunk[-1] in ",.;:!?":
                parts = (word, chunk[-1])
            else:
                parts = self.pieces(chunk)
            for p in parts:
                if p not in known:
                    known[p] = ids = older.get(p) or self.piece(p)
                    self.held += OBJECT + len(p) + len(ids)
            out.append(known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]))
        firsts = np.zeros(len(out) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4, out=firsts[1:])
        return pa.LargeListArray.from_arrays(pa.array(firsts), pa.array(np.frombuffer(b"".join(out), "<u4")))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of some normalized texts."""
        rows = pa.array(texts, pa.large_string())
        for space in "\n\t\r":
            rows = pc.replace_substring(rows, space, " ")
        parts = pc.split_pattern(rows, " ")
        coded, ends = parts.values.dictionary_encode(), parts.offsets.to_numpy()
        del rows, parts
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        distinct = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")  # faster than one by one
        done = spread(self.chunk_ids(distinct), coded.indices.to_numpy(), ends)
        ids, ends = done.values.to_numpy(), done.offsets.to_numpy().tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts come as runs of about BLOCK bytes, a longer one by itself."""
        special = {k: t for k, t in enumerate(texts) if "<|" in t and any(s in t for s in self.specials)}
        plain = ["" if k in special else self.normal(t) for k, t in enumerate(texts)]
        out = self.block(plain) if len(plain) != 1 else [np.concatenate([self.block([x])[0] for x in sections(plain[0], BLOCK)])]
        for k, t in special.items():
            out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_block([text])[0]


def sections(text: str, size: int) -> Iterator[str]:
    """text cut before white space into parts of about size characters."""
    at = 0
    while space := SPACES.search(text, at + size):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def spread(lists: pa.LargeListArray, at: np.ndarray, ends: np.ndarray) -> pa.LargeListArray:
    """lists[at], put together from each of ends to the next."""
    taken = lists.take(pa.array(at))
    return pa.LargeListArray.from_arrays(pa.array(taken.offsets.to_numpy()[ends]), taken.values)
