"""Vectors: cosine likeness, the deterministic hashed embedding, and embedders of the user's own.

The embedding hashes each token (64-bit FNV style, wrapping) three times: for the sign, for a
bucket that gets the sign, and for a second bucket that gets half the sign. All of it
is Catalyst expressions; 64-bit wrapping multiplication is done on 32-bit halves, as
ANSI arithmetic raises on overflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, tokens

# The seeds of the three hashes (bucket, second bucket, sign), and the prime 2^40 + 435.
SEEDS = (1469598103934665603, 1099511628211, 7809847782465536322)
PRIME_HIGH_SHIFT, PRIME_LOW = 40, 435
DIMENSIONS = 64

_HALF = (1 << 32) - 1


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.when(fine & (scale > 0), dot / scale).otherwise(F.lit(0.0))


def hash_halves(token: Column, seed: int) -> Column:
    """struct(hi, lo) of the 64-bit hash of token's bytes: xor a byte, multiply by the prime, wrapping."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(token)), lambda i: F.conv(F.hex(F.substring(token.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(seed >> 32).cast("long").alias("hi"), F.lit(seed & _HALF).cast("long").alias("lo"))

    def step(s: Column, byte: Column) -> Column:
        lo = s["lo"].bitwiseXOR(byte)
        t = lo * PRIME_LOW
        hi = s["hi"] * PRIME_LOW + F.shiftright(t, 32) + F.shiftleft(lo, PRIME_HIGH_SHIFT - 32).bitwiseAND(_HALF)
        return F.struct(hi.bitwiseAND(_HALF).alias("hi"), t.bitwiseAND(_HALF).alias("lo"))

    return F.aggregate(codes, start, step)


def modulo(h: Column, n: int) -> Column:
    return ((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<double> of length 1, or zeros where there is no token."""
    word = F.filter(F.transform(tokens(ascii_lower(text)), lambda t: F.regexp_replace(t, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")), lambda t: t != "")

    def parts(t: Column) -> Column:
        def of(h: Column) -> Column:
            sign = F.when(h[2]["lo"] % 2 == 0, 1.0).otherwise(-1.0)
            main = F.struct(modulo(h[0], dimensions).alias("k"), sign.alias("v"))
            return F.array(main, F.struct(modulo(h[1], dimensions).alias("k"), (sign * 0.5).alias("v"))) if dimensions > 1 else F.array(main)

        return F.transform(F.array(F.array(*[hash_halves(t, s) for s in SEEDS])), of)[0]

    def fold(all_parts: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), dimensions)
        add = lambda v, p: F.transform(v, lambda x, i: F.when(i == p["k"], x + p["v"]).otherwise(x))
        return F.aggregate(all_parts, zero, add)

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]

    return F.transform(F.array(fold(F.flatten(F.transform(word, parts)))), unit)[0]


#: text -> vector; a user's own embedder is any such function of columns, a pandas UDF included.
Embedder = Callable[[Column], Column]


def semantic(hay: Column, query: str, embedder: Embedder | None) -> Column:
    """Likeness of query and text, 0 at least; 0 without an embedder."""
    if embedder is None:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), cosine(embedder(F.lit(query)), embedder(hay)))
