"""Secret scanning with a trigram inverted index.

Each rule's pattern is parsed, and a Boolean trigram query is derived from it: strings
that every match must hold become conjunctions of their trigrams, alternatives become
disjunctions, and whatever can't be pinned down becomes "any".  Texts are indexed block by
block where they lie: for the trigrams that some query mentions, postings are bitmaps over
the block's texts.  A rule's query is answered by intersecting and uniting postings, and
only the texts that remain are matched against the pattern.  Rules whose query is "any",
such as runs of hexadecimal digits, scan every text.  The index is dropped with its
block, so nothing is shuffled, and memory is bounded by a block.

Besides the base kinds the scan knows the kinds in ``EXTRA``; base spans are
never changed by them.

Defined results.  Null texts count as empty and have no span.  Spans are counted in code
points, end exclusive, ordered by start, then by kind as listed.  Rows are
independent, so repeated rows give equal results; long texts are scanned whole.  An empty table gives an empty result.
Extra columns are ignored by the report and kept by the mask, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import lower_ascii, text_buffers
from .common import table


class Rule(NamedTuple):
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: Whether a match counts; a match that doesn't still uses up its text.
    accepts: Callable[[re.Match], bool] = bool
    #: The group at which the span starts.
    first: int = 0


#: The base kinds, with their patterns and least lengths: fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", accepts=lambda m: len(m[0]) >= 18),
    Rule("hex", r"[0-9a-f]+", accepts=lambda m: len(m[0]) >= 16),
)
#: Further kinds, by the public formats of their issuers.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    # From the start of a run of its letters only, so that a long run is read once.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # From the start of a run of scheme letters only, so that a long run is read once.
    Rule("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+)://[^\s/:@]++:[^\s/:@]{4,}+@", first=1),
)

#: A query: ``True`` (any text), ``("tri", trigram)``, ``("and", parts)`` or ``("or", parts)``.
Query = bool | tuple
#: Sets of exact strings above this size are given up for what is known of them.
MANY = 32


def conjunction(parts: list[Query]) -> Query:
    flat = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def disjunction(parts: list[Query]) -> Query:
    flat = list(dict.fromkeys(parts))
    # An alternative that asks for all that another asks for, and more, adds nothing.
    plain = {q: frozenset(mentioned(q)) for q in flat if q is not True and (q[0] == "tri" or all(x[0] == "tri" for x in q[1]) and q[0] == "and")}
    flat = [q for q in flat if q not in plain or not any(other < plain[q] for other in plain.values())]
    return True if not flat or True in flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def trigrams(text: str) -> Query:
    """All trigrams of a string; texts are indexed with A-Z lower-cased."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return conjunction([("tri", raw[i : i + 3]) for i in range(len(raw) - 2)])


def _any_of(strings: set[str]) -> Query:
    return disjunction([trigrams(s) for s in sorted(strings)])


def derive(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query that every text with a match satisfies."""

    def strings_of(node) -> set[str] | None:
        """The strings a single node can match, or None if they aren't few."""
        kind, arg = node
        if kind is op.LITERAL:
            return {chr(arg)}
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(x) for _, x in arg}
        if kind is op.SUBPATTERN:
            return exact(arg[-1])
        if kind is op.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 4:
            if (one := exact(arg[2])) is None:
                return None
            out, now = set(), {""}
            for n in range(arg[1] + 1):
                out |= now if n >= arg[0] else set()
                now = {a + b for a in now for b in one}
                if len(now) > MANY:
                    return None
            return out
        if kind is op.AT:
            return {""}
        return None

    def exact(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            if (more := strings_of(node)) is None:
                return None
            out = {a + b for a in out for b in more}
            if len(out) > MANY:
                return None
        return out

    def inner(node) -> Query:
        """What is known of a node whose strings aren't few."""
        kind, arg = node
        if kind is op.SUBPATTERN:
            return walk(arg[-1])
        if kind is op.BRANCH:
            return disjunction([walk(x) for x in arg[1]])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            return walk(arg[2])
        return True

    def walk(nodes) -> Query:
        parts: list[Query] = []
        run = {""}
        for node in nodes:
            more = strings_of(node)
            if more is not None and len(run) * len(more) <= MANY:
                run = {a + b for a in run for b in more}
                continue
            parts.append(_any_of(run))
            run = more if more is not None and len(more) <= MANY else {""}
            if more is None:
                parts.append(inner(node))
        return conjunction([*parts, _any_of(run)])

    return walk(parser.parse(pattern, flags & ~re.ASCII))


def mentioned(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(mentioned, query[1]))


def answer(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Bitmap of the block's texts that may match."""
    if query is True:
        return np.ones(n, dtype=bool)
    if query[0] == "tri":
        return postings[query[1]]
    parts = [answer(q, postings, n) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Index:
    """Postings of a block for the trigrams that some rule's query mentions."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [derive(r.pattern, r.flags) for r in rules]
        self.grams = sorted(set().union(*map(mentioned, self.queries)))
        self.number = {g[0] << 16 | g[1] << 8 | g[2]: i for i, g in enumerate(self.grams)}
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        for code, i in self.number.items():
            self.slot[code] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        n = len(offsets) - 1
        out = np.zeros((len(self.grams), n), dtype=bool)
        if len(data) >= 3:
            low = lower_ascii(data).astype(np.int32)
            slot = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(slot >= 0)
            first = np.searchsorted(offsets, at, side="right") - 1
            whole = np.searchsorted(offsets, at + 2, side="right") - 1 == first
            out[slot[at[whole]], first[whole]] = True
        return dict(zip(self.grams, out, strict=True))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        found = self.postings(data, offsets)
        return [answer(q, found, len(offsets) - 1) for q in self.queries]


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...] = BASE + EXTRA) -> Iterator[pa.RecordBatch]:
    index = Index(rules)
    # A run of hex digits is all of a match, so the least length may stand in the pattern; failing runs are the same either way.
    patterns = [re.compile(r"[0-9a-f]{16,}" if r.kind == "hex" else r.pattern, r.flags) for r in rules]
    names = [r.kind for r in BASE]
    for batch in batches:
        column = batch.column("text")
        out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for a, b, data, offsets in text_buffers(column):
            hits = index.candidates(data, offsets)
            some = np.logical_or.reduce(hits)
            for i in range(b - a):
                spans: list[tuple[int, int, str, int]] = []
                if some[i]:
                    text = column[a + i].as_py() or ""
                    for order, (rule, pattern, hit) in enumerate(zip(rules, patterns, hits, strict=True)):
                        if hit[i]:
                            spans += [(m.start(rule.first), order, rule.kind, m.end()) for m in pattern.finditer(text) if rule.accepts(m)]
                base = [s for s in spans if s[2] in names]
                for kind in names:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out}, schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of base spans, and all spans."""
    return docs.select("doc_id", "text").mapInArrow(scan, _DDL)


def mask(docs: DataFrame, fill: str = "*") -> DataFrame:
    """``docs`` with the characters of every span replaced; other columns and rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(scan(iter([batch])))
            texts = []
            for text, line in zip(batch.column("text").to_pylist(), found.column("spans").to_pylist(), strict=True):
                if line:
                    parts = list(text)
                    for span in line.split(","):
                        _, a, b = span.split(":")
                        parts[int(a) : int(b)] = fill * (int(b) - int(a))
                    text = "".join(parts)
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    # The scan reads doc_id and text; the mask keeps whatever else is there.
    keep = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return keep.mapInArrow(run, keep.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
