"""Text functions shared by queries: word splitting, tails of names, stable ids, line counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a place.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "our", "so", "that", "the", "their", "this", "to", "via", "we", "will", "with",
    "add", "build", "create", "implement", "make", "new", "feature", "support",
]


def words(text: Column) -> Column:
    """Lower-case words; camel case and every character but letters and digits divide."""
    split = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words; all of two or more if there are none."""
    every = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    long = F.filter(every, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.when(F.size(long) > 0, long).otherwise(F.filter(every, lambda w: F.length(w) >= 2))


def tail(name: Column) -> Column:
    """What follows the last separator of a qualified name."""
    return F.element_at(F.split(name, r"\\|::|\.|#|/"), -1)


def owner_of(name: Column) -> Column:
    """What stands before the last ``::``; null if nothing does."""
    return F.nullif(F.regexp_extract(name, r"^(.+)::[^:]*$", 1), F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_<sha256>`` over the parts as a JSON array."""
    return F.concat(F.lit(prefix + "_"), F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))


def line_count(text: Column) -> Column:
    """Line feeds, and one more if the last line isn't closed; empty text has no line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def excerpt(text: Column, start: int, end: int, most_lines: int = 40, most_bytes: int = 2_000_000) -> Column:
    """Lines ``start`` to ``end``, ``most_lines`` at most; null for a text that is too large."""
    n = min(end - start + 1, most_lines)
    return F.when(F.octet_length(text) <= most_bytes, F.array_join(F.slice(F.split(text, "\n"), start, n), "\n"))
