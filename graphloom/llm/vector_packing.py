"""Best-fit packing under several capacities at once.

A sequence has room for tokens, for a number of documents, and for attention cost (the sum of squared
lengths of its pieces).  Documents are encoded, ended by one id and cut into pieces of a sequence's length at most.
Pieces are placed longest first; among the sequences whose residual capacities hold a piece in every
dimension, the one with the best score takes it: the least weighted norm of what would be left, or the
greatest weighted dot product of demand and residual.  Weights are each dimension's share of its capacity that an
average piece takes, so the scarce dimension decides.

All three demands of a piece follow from its length, so pieces of one length are interchangeable: the
placement is made for the whole table at once from the counted lengths (no more rows than a sequence has
tokens, however large the table).  Sequences with equal content stand as one run, so a placement is a list of steps "these pieces
of this length go to this run, so many into each".  Pieces find theirs by their number within
their length, which tasks count on their own; where a task's numbers begin is a running sum over tasks.
Nothing is packed by partition, so no sequence stays unfilled because a partition ended.

Defined results.  Null texts count as empty; an empty text is the end id alone.  Repeated rows are packed each by itself,
ids may be null, ties go to the run with the lowest number.  An empty table gives no rows; extra columns are ignored.
Which of equally long pieces takes which place depends on how the table is split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BinaryCoder, coder, read_vocabulary
from .common import sent, stored, table

LENGTH = 2048
#: Ends every document.
END = 0

_PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, number long"


class Placement:
    """Runs of sequences with equal content, and the steps that fill them.

    A step ``(length, first, run, each, before)``: pieces of ``length`` from number ``first`` on go to the sequences from ``run`` on,
    ``each`` into one, behind ``before`` tokens that are there.
    """

    def __init__(self, counts: dict[int, int], length: int, documents: int, cost: int, score: str = "norm"):
        if score not in ("norm", "dot"):
            raise ValueError(f"score is norm or dot, not {score!r}")
        self.capacity = np.array([length, documents, cost], dtype=np.int64)
        if any((self.demand(n) > self.capacity).any() for n in counts):
            raise ValueError("a piece alone passes a capacity")
        self.score, self.steps, self.sequences = score, [], 0
        pieces = sum(counts.values())
        total = sum((self.demand(n).astype(object) * m for n, m in counts.items()), np.zeros(3, dtype=object))
        self.weights = np.array([float(t) for t in total]) / max(pieces, 1) / self.capacity
        #: First sequence, how many there are, and what is used of each capacity; one row a run.
        self.first, self.many, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
        for n in sorted(counts, reverse=True):
            self._place(n, counts[n])

    @staticmethod
    def demand(length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)

    def best(self, demand: np.ndarray) -> int | None:
        """The run that takes a piece of this demand, if any holds it."""
        room = self.capacity - self.used
        holds = np.flatnonzero((room >= demand).all(axis=1))
        if not len(holds):
            return None
        if self.score == "norm":
            points = -(self.weights * ((room[holds] - demand) / self.capacity) ** 2).sum(axis=1)
        else:
            points = (self.weights * (room[holds] / self.capacity) * (demand / self.capacity)).sum(axis=1)
        ahead = holds[points == points.max()]
        return int(ahead[np.argmin(self.first[ahead])])

    def _fit(self, used: np.ndarray, demand: np.ndarray) -> int:
        """How many pieces one sequence takes before another is chosen: the fuller one is the better fit again, but has the smaller dot product."""
        return int(((self.capacity - used) // demand).min()) if self.score == "norm" else 1

    def _place(self, length: int, left: int) -> None:
        demand, number = self.demand(length), 0
        while left:
            at = self.best(demand)
            if at is None:
                # Nothing holds it: new sequences; each is filled before the next is opened, whatever the score.
                each = min(int((self.capacity // demand).min()), left)
                run, used, many = self.sequences, np.zeros(3, dtype=np.int64), left // each
                self.sequences += many
            else:
                each = min(self._fit(self.used[at], demand), left)
                run, used, many = int(self.first[at]), self.used[at].copy(), min(int(self.many[at]), left // each)
                if many == self.many[at]:
                    keep = np.arange(len(self.first)) != at
                    self.first, self.many, self.used = self.first[keep], self.many[keep], self.used[keep]
                else:
                    self.first[at] += many
                    self.many[at] -= many
            self.steps.append((length, number, run, each, int(used[0])))
            used = used + each * demand
            if (used < self.capacity).all():
                self.first, self.many, self.used = np.append(self.first, run), np.append(self.many, many), np.vstack([self.used, used])
            number, left = number + many * each, left - many * each

    def lookup(self) -> dict[int, np.ndarray]:
        """By length its steps as rows ``first, run, each, before``, in order of ``first``."""
        out: dict[int, list] = {}
        for length, *step in self.steps:
            out.setdefault(length, []).append(step)
        return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def find(steps: np.ndarray, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of one length with these numbers."""
    first, run, each, before = steps[np.searchsorted(steps[:, 0], numbers, side="right") - 1].T
    turn = numbers - first
    return run + turn // each, before + turn % each * length


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """Encoded pieces; ``part`` and ``number`` count those of one length within the task that made them."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    last = np.array([end], dtype="<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary.value, BinaryCoder)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: Counter[int] = Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([c.array(text.as_py()), last])
                for piece, start in enumerate(range(0, len(ids), length)):
                    cut = ids[start : start + length]
                    rows.append((doc, piece, start, len(cut), cut.tobytes(), part, seen[len(cut)]))
                    seen[len(cut)] += 1
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = ("doc_id", "piece", "start", "length", "ids", "part", "number")
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def placed(rows: DataFrame, placement: Placement, counts: DataFrame) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``counts``: how many there are of each part and length."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin")), "begins")
    steps = rows.sparkSession.sparkContext.broadcast(placement.lookup())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "at"))
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            ends = np.flatnonzero(np.diff(lengths[order])) + 1
            for some in np.split(order, ends) if len(order) else []:
                length = int(lengths[some[0]])
                sequence[some], offset[some] = find(steps.value[length], length, numbers[some])
            kept = batch.drop_columns(["at"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    numbered = rows.join(sent(begins), ["part", "length"]).withColumn("at", F.col("number") + F.col("begin")).drop("part", "number", "begin")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("at").schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(run, schema)


def packed(docs: DataFrame, length: int = LENGTH, documents: int | None = None, cost: int | None = None, score: str = "norm", end: int = END, path: str | None = None) -> DataFrame:
    """Per piece ``length, doc_id, piece, start, ids, ids_crc32, sequence_id, offset``; ``ids`` are little-endian 32-bit numbers.

    ``documents``: pieces a sequence may hold; ``cost``: its sum of squared lengths.  Neither binds unless given.
    """
    cost = length * length if cost is None else cost
    documents = length if documents is None else documents
    rows = pieces(docs, min(length, isqrt(cost)), end, path).withColumn("ids_crc32", F.crc32("ids"))
    rows = stored(rows, "pieces")
    counts = rows.groupBy("part", "length").count()
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    return placed(rows, Placement(by_length, length, documents, cost, score), counts)


def sequences(rows: DataFrame) -> DataFrame:
    """Whole sequences of packed pieces: ``sequence_id, n_tokens, input_ids, cu_seqlens, doc_ids, position_starts``."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    # A sequence holds no more pieces than tokens.
    s = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("s"))
    return s.select(
        "sequence_id", F.aggregate("s", F.lit(0), lambda n, x: n + x["length"]).alias("n_tokens"), F.aggregate("s", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("input_ids"),
        F.concat(F.array(F.lit(0).cast("long")), F.transform("s", lambda x: x["offset"] + x["length"])).alias("cu_seqlens"),
        F.transform("s", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("s", lambda x: x["start"]).alias("position_starts"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
