"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes when it lies in a string of ``LENGTH`` bytes (200) that also starts
somewhere else.  Plain prefix doubling ranks every byte position in every round.
Here the rounds run over ever fewer positions, and none is lost:

1. Every window of ``LENGTH`` bytes holds a leftmost least hash among its strings of
   ``LENGTH / 4`` bytes; that choice depends on the window alone, so equal windows
   choose the same string at the same offset.  These anchors, about one in 64
   bytes, are the first positions, and the rank of an anchor is the hash of its string.
   Ranks that occur once end here, with all windows that chose them.
2. Surviving anchors are ranked by the pair (first rank, rank of everything their windows
   cover).  A pair that occurs twice settles all its windows as repeated.
3. Anchors whose first rank repeats while their pair doesn't lie at the edge of a repeat.
   Each distinct pair of such a group sends its bytes once, and position rank pairs
   (rank of h bytes at p, rank of h bytes at p + h) are sorted and reranked for h =
   50, 100, up to 200 bytes, dropping positions as their rank becomes unique.
   Groups of over ``WIDE`` distinct pairs, such as a line that very many texts share, do
   the last round in Spark, where each window is a key of its own.

Ranks are 64-bit hashes; a match has to agree in the anchor's rank, in the offset and
in an independently hashed window, 128 bits in all.

Defined results.  Null texts are empty, and empty or short texts lose nothing.  A row
repeated as a whole counts as another occurrence, so its text goes if it has ``LENGTH``
bytes.  Matches never cross texts, and long texts are scanned whole.  An empty table gives an empty result.  Extra columns
are ignored, whatever their names.  Rows are told apart by id and a 64-bit hash of the text, or two such hashes where the id is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import U64, RangeHash, mix, sliding_min, text_buffers
from .common import stored, table

LENGTH = 200
#: What tells rows apart.
ROW = ["ra", "rb"]
#: Distinct pairs of one anchor rank from which its windows are compared in Spark, not within one task.
WIDE = 20_000
_LOW = (1 << 28) - 1
#: Bytes of contexts that a task ranks at a time.
_CHUNK = 8 << 20


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor positions with their first and last window start, and the anchors' and covers' ranks."""
    k = length // 4
    starts, ends = offsets[:-1], offsets[1:]
    long_enough = ends - starts >= length
    if not long_enough.any():
        return None
    hashes = RangeHash(data)
    rank = hashes.rolling(k)
    place = np.arange(len(rank), dtype=U64)
    least = sliding_min((rank & ~U64(_LOW)) | place, length - k + 1)
    step = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(step, starts[long_enough], 1)
    np.add.at(step, ends[long_enough] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    chosen = (least[window] & U64(_LOW)).astype(np.int64)
    text = np.searchsorted(offsets, window, side="right") - 1
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(window)) - 1
    at, low, high = chosen[first], window[first], window[last]
    cover = RangeHash(data, 1).of(low, high + length)
    cover = mix(cover + (at - low).astype(U64) * U64(0x9E3779B97F4A7C15))
    return text[first], at, low, high, rank[at], cover


def _pieces(batch: pa.RecordBatch, length: int):
    """Runs of texts; a text above the run's size comes in overlapping parts, each with all windows that start in it."""
    most = 2 << 20
    for a, _, data, offsets in text_buffers(batch.column("text"), most):
        if len(data) <= 4 * most:
            yield a, 0, data, offsets
        else:
            for at in range(0, max(1, len(data) - length + 1), most):
                part = data[at : at + most + length - 1]
                yield a, at, part, np.array([0, len(part)], dtype=np.int64)


def anchors(batches: Iterator[pa.RecordBatch], length: int = LENGTH, ranks_only: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ra, rb = (batch.column(c).to_numpy() for c in ROW)
        for a, base, data, offsets in _pieces(batch, length):
            if (found := _anchors(data, offsets, length)) is None:
                continue
            text, at, low, high, rank, cover = found
            if ranks_only:
                yield pa.RecordBatch.from_pydict({"kh": rank.view(np.int64)})
                continue
            # start of the first window, offset of the anchor and number of further windows; the last two are below 256
            spot = ((low - offsets[text] + base) << 16) | ((at - low) << 8) | (high - low)
            yield pa.RecordBatch.from_pydict({"kh": rank.view(np.int64), "hh": cover.view(np.int64), "ra": ra[a + text], "rb": rb[a + text], "spot": spot})


def contexts(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The bytes under the windows of the anchors asked for."""
    for batch in batches:
        column = batch.column("asked").combine_chunks() if isinstance(batch.column("asked"), pa.ChunkedArray) else batch.column("asked")
        keys = list(zip(*(batch.column(c).to_pylist() for c in ROW), strict=True))
        text = batch.column("text").cast(pa.binary())
        out: dict[str, list] = {"kh": [], "wide": [], "open": [], "ra": [], "rb": [], "spot": [], "bytes": []}
        for i in range(len(column)):
            raw, key = text[i].as_py() or b"", keys[i]
            for ask in column[i].as_py():
                low, more = ask["spot"] >> 16, ask["spot"] & 255
                out["kh"].append(ask["kh"])
                out["wide"].append(ask["wide"])
                out["open"].append(ask["open"])
                out["ra"].append(key[0])
                out["rb"].append(key[1])
                out["spot"].append(ask["spot"])
                out["bytes"].append(raw[low : low + more + length])
            if len(out["kh"]) >= 4096:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT)
                out = {k: [] for k in out}
        if out["kh"]:
            yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT)


_CONTEXT = pa.schema([("kh", pa.int64()), ("wide", pa.bool_()), ("open", pa.bool_()), ("ra", pa.int64()), ("rb", pa.int64()), ("spot", pa.int64()), ("bytes", pa.binary())])
_CONTEXT_DDL = "kh long, wide boolean, open boolean, ra long, rb long, spot long, bytes binary"


def _windows(rows: pa.Table, length: int):
    """Every window of the contexts: its row, start within the row, key of its place (group and offset), and the hashes to double."""
    raw = rows.column("bytes").combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    spot = rows.column("spot").to_numpy()
    counts = (spot & 255) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = ((spot >> 8) & 255)[row] - start
    place = mix(rows.column("kh").to_numpy().view(U64)[row] + before.astype(U64) * U64(0xBF58476D1CE4E5B9))
    return row, start, place, RangeHash(data, 1), offsets[row] + start


def _spans(rows: pa.Table, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch | None:
    """From repeated windows in order: for each open row the span from its first repeated window to the end of its last."""
    wanted = rows.column("open").to_numpy(zero_copy_only=False)[row]
    row, start = row[wanted], start[wanted]
    if not len(row):
        return None
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    last = np.append(first[1:], len(row)) - 1
    low = rows.column("spot").to_numpy()[row[first]] >> 16
    return pa.RecordBatch.from_pydict({**{c: rows.column(c).to_numpy()[row[first]] for c in ROW}, "a": low + start[first], "b": low + start[last] + length})


def _double(rows: pa.Table, length: int) -> pa.RecordBatch | None:
    """Prefix doubling over the windows of whole groups."""
    row, start, place, hashes, at = _windows(rows, length)
    h = length // 4
    # the first rank: position's place, and the quarter window there
    rank, shift, alive = hashes.rolling(h), h, np.arange(len(row))
    while True:
        pair = mix(rank[at[alive]] + U64(0x94D049BB133111EB) * place[alive])
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(pair), dtype=bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        alive = alive[twice]
        if shift == length or not len(alive):
            return _spans(rows, row[alive], start[alive], length) if len(alive) else None
        step = min(shift, length - shift)
        rank = mix(rank[: len(rank) - step] * U64(0xD6E8FEB86659FD93) + rank[step:])
        shift += step


def settle(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Prefix doubling over rows that come sorted by anchor rank; a chunk ends where a rank ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < _CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        ranks = rows.column("kh").to_numpy()
        cut = int(np.searchsorted(ranks, ranks[-1], side="left"))
        if cut == 0:
            continue
        if (out := _double(rows.slice(0, cut).combine_chunks(), length)) is not None:
            yield out
        held = rows.slice(cut).combine_chunks().to_batches()
        size = sum(x.nbytes for x in held)
    if held and (out := _double(pa.Table.from_batches(held).combine_chunks(), length)) is not None:
        yield out


def loose(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Windows of wide groups, each with the last rank of prefix doubling as a key of its own."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        row, start, place, hashes, at = _windows(rows, length)
        rank = mix(hashes.of(at, at + length) + U64(0x94D049BB133111EB) * place)
        low = rows.column("spot").to_numpy() >> 16
        wanted = rows.column("open").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"kh": place.view(np.int64), "w": rank.view(np.int64), **{c: rows.column(c).to_numpy()[row] for c in ROW}, "low": low[row], "a": low[row] + start, "open": pa.array(wanted[row])})


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted(spans or (), key=lambda x: x["a"]):
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [(a, b) for a, b in out]


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        n_bytes, n_removed, n_spans, kept_hash, kept_text = [], [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            raw, at, parts = text[i].as_py() or b"", 0, []
            runs = _merged(spans)
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            kept = b"".join(parts)
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(len(runs))
            kept_hash.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(kept_hash, pa.string()), "kept": pa.array(kept_text, pa.binary())})


def repeated_spans(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """The texts by row key ``ra, rb``, and the spans ``ra, rb, a, b`` (bytes) that repeats cover."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias("ra"), F.xxhash64(text).alias("rb"), "doc_id", text.alias("text"))
    slim = source.select(*ROW, "text").where(F.octet_length("text") >= length)
    # Written out, so that the join's other side, which may hold a very frequent rank, can be split.
    counts = stored(slim.mapInArrow(lambda it: anchors(it, length, True), "kh long").groupBy("kh").count().where("count > 1").select("kh"), "ranks")
    found = stored(slim.mapInArrow(lambda it: anchors(it, length), "kh long, hh long, ra long, rb long, spot long").join(counts, "kh"), "anchors")
    pairs = stored(found.groupBy("kh", "hh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "spot")).alias("one")), "pairs")
    ranks = pairs.groupBy("kh").agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).where("least = 1").select("kh", (F.col("pairs") > wide).alias("wide"))
    whole = found.join(pairs.where("n > 1").select("kh", "hh"), ["kh", "hh"]).select(*ROW, F.shiftright("spot", 16).alias("a"), (F.shiftright("spot", 16) + F.col("spot").bitwiseAND(255) + length).alias("b"))
    asked = (
        pairs.join(ranks, "kh").select("one.ra", "one.rb", F.struct("kh", "wide", (F.col("n") == 1).alias("open"), F.col("one.spot").alias("spot")).alias("ask"))
        .groupBy(*ROW).agg(F.collect_list("ask").alias("asked"))
    )
    edges = stored(source.join(asked, ROW).mapInArrow(lambda it: contexts(it, length), _CONTEXT_DDL), "edges")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = edges.where("not wide").repartition(n, "kh").sortWithinPartitions("kh").mapInArrow(lambda it: settle(it, length), "ra long, rb long, a long, b long")
    single = edges.where("wide").mapInArrow(lambda it: loose(it, length), "kh long, w long, ra long, rb long, low long, a long, open boolean")
    twice = single.groupBy("kh", "w").count().where("count > 1").select("kh", "w")
    far = single.where("open").join(twice, ["kh", "w"]).groupBy(*ROW, "low").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b")).select(*ROW, "a", "b")
    return source, whole.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the bytes ``kept``."""
    source, spans = repeated_spans(docs, length, wide)
    by_row = spans.groupBy(*ROW).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return source.join(by_row, ROW, "left").select("doc_id", "text", "spans").mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, s, substr(h, 2 * s + 1, 2400) AS piece, CAST(length(h) / 2 AS BIGINT) AS n FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT), 1000)) AS s FROM d) q),
p AS (SELECT r, s, piece, n, unnest(range(least(1000, n - s))) AS j FROM c),
w AS (SELECT r, s + j AS i, substr(piece, 2 * j + 1, 2) AS x, CASE WHEN s + j + 200 <= n THEN md5(substr(piece, 2 * j + 1, 400)) END AS k FROM p),
f AS (SELECT r, i, x, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS f FROM w),
g AS (SELECT r, i, x, max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT *, CASE WHEN gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) = 0 THEN 1 ELSE 0 END AS starts FROM g),
t AS (SELECT r, CAST(count(*) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(starts) AS BIGINT) AS n_spans, string_agg(CASE WHEN gone = 0 THEN x END, '' ORDER BY i) AS kept FROM a GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
