"""Token-id output: documents packed into rows of one length by best-fit decreasing.

Documents are encoded, cut losslessly into pieces of ``LENGTH`` tokens at most, and packed
longest first, each piece into the row with the least room that holds it.  A
segment tree over capacities finds that row in logarithmic time.  Packing works on groups of
about ``GROUP`` tokens within a partition, so memory is bounded, nothing is shuffled, and a
group of that size leaves few rows unfilled.

A packed row carries its ids as a matrix row (little-endian 32-bit, filled up with ``PAD``), the
cumulative lengths of its segments, and for each segment where the position count restarts and
at which value: 0, or the offset within the document for a later piece.

Defined results.  Null and empty texts, and those without tokens, take no place.  Repeated rows are packed
each by itself.  Ids may be null.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import BinaryCoder, coder, read_vocabulary
from .common import table

LENGTH = 2048
#: Tokens that are packed together.
GROUP = 1 << 21
#: Fills rows up: the vocabulary's end-of-text token.
PAD = 49407

_SCHEMA = pa.schema([
    ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("position_starts", pa.list_(pa.int32())),
])
_DDL = "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, doc_ids array<long>, position_starts array<int>"


class Capacities:
    """Open rows by room left: a segment tree of how many there are, and a stack of rows at each leaf."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room of ``least`` or more, and its room."""
        at = least + self.size
        # Upward until a subtree to the right, or the leaf itself, holds a row; then down its left edge.
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.tree[at]:
                    at += 1
        room = at - self.size
        while at:
            self.tree[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is in exactly one row, and no row passes ``length``."""
    open_ = Capacities(length)
    rows: list[list[int]] = []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[piece]
        if (found := open_.take(size)) is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        if room > size:
            open_.add(room - size, row)
    return rows


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """Cuts of a document of n tokens."""
    return [(a, min(a + length, n)) for a in range(0, n, length)]


def packed(docs: DataFrame, length: int = LENGTH, group: int = GROUP, path: str | None = None, pad: int = PAD) -> DataFrame:
    """Packed rows: ``pack_id, n_tokens, input_ids, cu_seqlens, doc_ids, position_starts``."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def flush(held: list[tuple[int | None, int, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for _, _, x in held]
        rows = best_fit_decreasing(sizes, length)
        for a in range(0, len(rows), 256):
            some = rows[a : a + 256]
            matrix = np.full((len(some), length), pad, dtype="<i4")
            ends = []
            for line, row in zip(matrix, some, strict=True):
                at = [0]
                for i in row:
                    line[at[-1] : at[-1] + sizes[i]] = held[i][2]
                    at.append(at[-1] + sizes[i])
                ends.append(at)
            yield pa.RecordBatch.from_pydict({
                "pack_id": range(first + a, first + a + len(some)), "n_tokens": [e[-1] for e in ends], "input_ids": [line.tobytes() for line in matrix], "cu_seqlens": ends,
                "doc_ids": [[held[i][0] for i in row] for row in some], "position_starts": [[held[i][1] for i in row] for row in some],
            }, schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value, BinaryCoder)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 33
        held, tokens = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = c.array(text.as_py())
                held += [(doc, a, ids[a:b]) for a, b in pieces(len(ids), length)]
                tokens += len(ids)
                if tokens >= group:
                    yield from flush(held, first)
                    first += len(held)
                    held, tokens = [], 0
        if held:
            yield from flush(held, first)

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)


def unpacked(rows: DataFrame) -> DataFrame:
    """The pieces of packed rows: ``doc_id, position, ids array<int>``; in order of position they are the document again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "position": [], "ids": []}
            for raw, ends, docs, starts in zip(*(batch.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "doc_ids", "position_starts")), strict=True):
                ids = np.frombuffer(raw, dtype="<i4")
                for i, (doc, start) in enumerate(zip(docs, starts, strict=True)):
                    out["doc_id"].append(doc)
                    out["position"].append(start)
                    out["ids"].append(ids[ends[i] : ends[i + 1]])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return rows.mapInArrow(run, "doc_id long, position int, ids array<int>")


def write_packed(docs: DataFrame, path: str, length: int = LENGTH) -> None:
    """Packed rows as Parquet: one binary matrix row each, with cumulative lengths and position starts."""
    packed(docs, length).write.mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
