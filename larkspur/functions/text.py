"""Text expressions: tokens, haystacks, snippets, query intents."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark an intent of a query.
SEQUENCE = ("timeline", "before", "after", "first", "last", "sequence")
DURATION = ("how long", "duration", "lasting", "long-running", "long running")
RECURRENCE = ("recurring", "repeat", "repeats", "again", "every ", "habit")
BOUNDARY = ("boundary", "handoff", "checkpoint", "session", "window")
CONTINUITY = ("what led", "what changed", "what happened next", "unresolved", "follow up", "follow-up", "same episode")

#: White space as Unicode has it, in Spark and on the driver: U+001C to U+001F are none, which Python's split() takes for some.
UNICODE_SPACE = r"(?U)\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_SPACE = re.compile(f"[{SPACES}]+")


def ascii_lower_text(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def query_terms(query: str) -> list[str]:
    """White-space tokens of a query, ASCII lower-case, repeats kept. A query is one literal: its terms are worked out once."""
    return [ascii_lower_text(t) for t in WHITE_SPACE.split(query) if t]


def has_intent(query: str, phrases: tuple[str, ...]) -> bool:
    low = ascii_lower_text(query)
    return any(p in low for p in phrases)


def ascii_lower(c: Column) -> Column:
    """ASCII letters only: other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, UNICODE_SPACE), "")


def approximate_tokens(content: Column, summary: Column) -> Column:
    count = lambda c: F.size(tokens(F.coalesce(c, F.lit(""))))
    return (count(content) + count(summary)).cast("long")


def trimmed(c: Column) -> Column:
    """Without white space at both ends, line feeds included."""
    return F.btrim(c, F.lit(SPACES))


def haystack(content: Column, summary: Column) -> Column:
    return F.concat(ascii_lower(content), F.lit(" "), ascii_lower(F.coalesce(summary, F.lit(""))))


def matched_terms(hay: Column, terms: list[str]) -> Column:
    """The terms, in query order and with repeats, that occur in hay as substrings."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(t)), F.lit(t)) for t in terms]))


def count_terms(hay: Column, terms: list[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(hay, F.lit(t)).cast("int")
    return out


def any_term(hay: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(hay, F.lit(t))
    return out


def snippet(c: Column, size: int = 160) -> Column:
    """The trimmed text's first size characters, with dots if there are more."""
    t = trimmed(c)
    return F.when(F.char_length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def per_mille(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 1000).cast("int")
