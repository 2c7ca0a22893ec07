"""Exact self-join on the Jaccard similarity of word shingles.

1. Each text becomes its set of distinct 5-word shingles, as sorted 64-bit hashes.
   Equal sets fall into one class by a 128-bit digest; only the class's first row goes on.
2. Two sets at 80 % share a hash among the first ``n - ceil(0.8 n) + 1`` of either, in
   any fixed order of hashes, and for the smaller set ``n - ceil(0.8 * 2 n / 1.8) + 1`` are enough.  The order
   puts frequent shingles last: a Misra-Gries pass over all texts finds them, ``COMMON`` at most.
3. Rows that share a prefix shingle go to the tile of that shingle's first row.  Near copies have
   the same first row at most of their shingles, so a row enters few tiles, however many
   shingles it shares.  A tile is cut by size bands; each set also enters the next band, so
   that any two sets in reach of each other meet.
   The smaller of two linked sets holds the first shingle that they share early in its prefix.  So rows that
   have a tile's shingles late, as all letters of one template may, are held against its early rows alone.
4. Within a tile, rows are compared by hashed bitmaps: the sets differ in at least as many shingles
   as the bitmaps differ in bits, which bounds the overlap from above.  A search from row to row connects
   what may link and yields one pair fewer than it has rows at most.  Connected rows are a group of candidates.
5. Each group comes together once more, cut by size bands, now with its texts.  Bitmaps come first again, and what
   they let through is decided by intersecting the sorted arrays; rows already joined are not
   compared again.  Links are again fewer than rows, and their components are the result.

A tile or group of over ``MOST`` shingles is held against its first row while it streams by.
Only what is not linked with that is dealt out with all rows of the tile, in
blocks of bounded size.

Defined results.  Null texts and texts without words have an empty set and are linked
with nothing.  A text of one to four words is one shingle.  Long texts are taken whole.  Rows that
repeat an id are placed each by its own text.  A row without id is linked with nothing and
has a null component.  Equal sets and repeated rows are one class.  An empty table gives an
empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import U64, RangeHash, lower_ascii, mix, released, text_buffers, words
from .common import sent, stored, table
from .components import components

WORDS = 5
#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: The most frequent shingles that are ordered last, rarer ones first; 9 bytes each wherever they are sent.
COMMON = 1 << 19
#: Counters of each partition's Misra-Gries sketch.
COUNTERS = 1 << 18
#: Shingles of the sets that a task holds of one tile; 8 bytes each.
MOST = 1 << 21
#: Marks slots beyond the prefix that the smaller set of a pair needs; row numbers lie below.
_LATE = 1 << 62
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)


def shingles(column: pa.Array, width: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per run of texts: first row, all shingle hashes in reading order, and each text's first shingle (one more at the end)."""
    for a, _, data, offsets in text_buffers(column):
        low = lower_ascii(data)
        starts, ends, first = words(low, offsets)
        w = RangeHash(low).of(starts, ends)
        counts = np.diff(first)
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        at = np.concatenate([[0], np.cumsum(n)])
        begin = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
        short = np.repeat(np.minimum(counts, width), n)
        h = short.astype(U64) * U64(0x2545F4914F6CDD1D)
        pad = np.concatenate([w, np.zeros(width, U64)])
        for i in range(width):
            h += np.where(i < short, pad[begin + i] * _TIMES[i % len(_TIMES)] * U64(2 * (i // len(_TIMES)) + 1), U64(0))
        yield a, mix(h), at


def sets(column: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for _, h, at in shingles(column, width):
        for i in range(len(at) - 1):
            yield np.unique(h[at[i] : at[i + 1]])


def frequent(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS, at_once: int = 3 * COUNTERS) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over a partition's shingles, taking in ``at_once`` of them at a time."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def take(new: list[np.ndarray]) -> None:
        nonlocal keys, counts
        fresh, n = np.unique(np.concatenate(new), return_counts=True)
        at = np.searchsorted(keys, fresh)
        known = np.zeros(len(fresh), dtype=bool)
        if len(keys):
            known = keys[np.minimum(at, len(keys) - 1)] == fresh
            counts[at[known]] += n[known]
        keys, counts = np.concatenate([keys, fresh[~known]]), np.concatenate([counts, n[~known]])
        if len(keys) > counters:
            counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]

    held, n = [], 0
    for batch in batches:
        for _, h, _ in shingles(batch.column(0)):
            held.append(h)
            n += len(h)
            if n >= at_once:
                take(held)
                held, n = [], 0
    if n:
        take(held)
    # What a partition holds only once or twice beyond the sketch's cut can't lift a shingle among the common ones.
    keep = counts > 2
    yield pa.RecordBatch.from_pydict({"h": keys[keep].view(np.int64), "n": counts[keep]})
    released()


def common_shingles(docs: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the class of each: four to a doubling of its count."""
    rows = docs.select("text").mapInArrow(frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    found = rows.select("h", F.floor(4 * F.log2("n")).cast("int").alias("c")).toArrow()
    h, c = found.column(0).to_numpy().astype(np.int64).view(U64), found.column(1).to_numpy().astype(np.uint8)
    order = np.argsort(h)
    return h[order], c[order]


def rare_first(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the one order that all sets share: shingles that aren't common by hash, then common ones by class and hash."""
    keys, classes = common
    if not len(keys) or not len(s):
        return s
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, classes[at], 0), kind="stable")]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a batch's sets take."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    released()


def describe(batches: Iterator[pa.RecordBatch], common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per text: size, digest and bitmap of its set, and its prefix shingles."""
    for batch in sliced(batches):
        size, digests, bits, prefix = [], [], [], []
        for s in sets(batch.column("text")):
            n = len(s)
            size.append(n)
            digests.append(digest(s))
            bits.append(bitmap(s, bitmap_bits(n)).tobytes() if n else None)
            take = n - -(-PERCENT * n // 100) + 1 if n else 0
            prefix.append(rare_first(s, common)[:take].view(np.int64))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n": pa.array(size, pa.int32()), "digest": pa.array(digests, pa.binary()),
            "bits": pa.array(bits, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())),
        })


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def bitmap_bits(n: int) -> int:
    """Bitmap length for a set of n: a power of two of four times the size or more."""
    return max(64, 1 << int(4 * n - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def fold(packed: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap brought to fewer bits; the hash's low bits place a shingle, so halves lie over each other."""
    while len(packed) * 8 > bits:
        packed = packed[: len(packed) // 2] | packed[len(packed) // 2 :]
    return packed


def most_common(n: int, bits: np.ndarray, others: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of a set with others by the bitmaps: (n + m - differing bits) / 2."""
    apart = np.bitwise_count(maps ^ bits).sum(axis=1, dtype=np.int64)
    return np.minimum(np.minimum(others, n), (others + n - apart) // 2)


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with other sorted arrays."""
    t = np.concatenate(others)
    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
    return np.add.reduceat((s[at] == t).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


class Tile:
    """Rows of a tile, or of a part of one, with their bitmaps and, where links are decided exactly, their sets."""

    def __init__(self, band: int, rows: list[tuple]):
        self.band = band
        self.row = np.array([r[0] for r in rows], dtype=np.int64)
        self.own = np.array([r[1] for r in rows], dtype=np.int64)
        self.n = np.array([r[2] for r in rows], dtype=np.int64)
        least = 8 * min(len(r[3]) for r in rows)
        self.maps = np.stack([fold(r[3], least) for r in rows]).view(U64)
        self.sets = [r[4] for r in rows]
        self.late = np.array([r[6] for r in rows], dtype=bool)

    def links(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of the rows ``among`` that link with row i, or may, if there are no sets.  A pair counts in the band of its larger set, and where one of it is early."""
        if self.late[i]:
            among = among[~self.late[among]]
        n, m = self.n[i], self.n[among]
        among = among[(np.maximum(self.own[among], self.own[i]) == self.band) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))]
        if len(among):
            m = self.n[among]
            among = among[100 * (most := most_common(n, self.maps[i], m, self.maps[among])) >= PERCENT * (n + m - most)]
        if len(among) and self.sets[i] is not None:
            m, both = self.n[among], overlaps(self.sets[i], [self.sets[k] for k in among])
            among = among[100 * both >= PERCENT * (n + m - both)]
        return among

    def forest(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row and those first reached from it, over all connected rows: a spanning forest.  A row that was reached is not compared again but to reach others."""
        free, early = np.ones(len(self.row), dtype=bool), ~self.late
        # Late rows link with early ones alone, so nothing is left for them once those were seeds.
        for seed in np.flatnonzero(early):
            if not free[seed]:
                continue
            free[seed] = False
            reached = [seed]
            while reached:
                i = reached.pop()
                left = np.flatnonzero(free & early if self.late[i] else free)
                found = self.links(i, left) if len(left) else left
                if len(found):
                    free[found] = False
                    reached += found.tolist()
                    yield i, found


#: Of edges: two rows, or a row of a wide tile that isn't linked with the tile's first.
_EDGES = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("tile", pa.int64()), ("band", pa.int32())])
_EDGES_DDL = "x long, y long, tile long, band int"


def _edges(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(x), np.concatenate(y)
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none.cast(pa.int32())], schema=_EDGES)


def _described(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, tuple]]:
    """Each row's key and ``row, own, n, bitmap, set, whether it asks, whether it is late``.  With texts the set comes from the text, if that is the one the row stands for; else there is none."""
    at = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    row, own, n = (batch.column(c).to_pylist() for c in ("row", "own", "n"))
    ask = batch.column("ask").to_pylist() if "ask" in batch.schema.names else [False] * len(row)
    late = batch.column("late").to_pylist()
    if "text" not in batch.schema.names:
        for i, raw in enumerate(batch.column("bits").to_pylist()):
            yield at[i], (row[i], own[i], n[i], np.frombuffer(raw, np.uint8), None, ask[i], late[i])
        return
    wanted = batch.column("digest").to_pylist()
    for i, s in enumerate(sets(batch.column("text"))):
        if digest(s) == wanted[i]:
            yield at[i], (row[i], own[i], n[i], bitmap(s, bitmap_bits(n[i])), s, ask[i], late[i])


def parts(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """Rows sorted by key, cut into one list a key, or several where their sets hold over ``most`` shingles; whether a list ends its key.  Of equal rows in succession one is taken."""
    key, held, size, last = None, [], 0, None
    for batch in sliced(batches):
        for k, r in _described(batch, keys):
            if k != key:
                if held:
                    yield key, held, True
                key, held, size = k, [], 0
            elif (r[0], r[5]) == last:
                continue
            elif size + r[2] > most:
                yield key, held, False
                held, size = [], 0
            held.append(r)
            size += r[2]
            last = r[0], r[5]
    if held:
        yield key, held, True


def compare_tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of each tile, fewer than its rows.  A tile that comes in parts is held against its first row, and what isn't linked with that is named."""
    xs, ys, n, first = [], [], 0, None
    for (tile, band), rows, last in parts(batches, ["tile", "band"], most):
        if first is None and last:
            t = Tile(band, rows)
            for i, found in t.forest():
                xs.append(np.full(len(found), t.row[i]))
                ys.append(t.row[found])
                n += len(found)
        else:
            first = first or rows[0]
            t = Tile(band, [first, *[r for r in rows if r[0] != first[0]]])
            others = np.arange(1, len(t.row))
            found = t.links(0, others)
            xs.append(np.full(len(found), first[0]))
            ys.append(t.row[found])
            n += len(found)
            rest = t.row[np.setdiff1d(others, found)]
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64()), pa.array(np.full(len(rest), tile)), pa.array(np.full(len(rest), band, np.int32))], schema=_EDGES)
            first = None if last else first
        if n > 10_000:
            yield _edges(xs, ys)
            xs, ys, n = [], [], 0
    if n:
        yield _edges(xs, ys)


def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between left-over rows of a wide tile, which ask, and a block of its rows: fewer than there are rows."""
    for (_, band, _, _), rows, _ in parts(batches, ["tile", "band", "i", "j"], _LATE):
        t = Tile(band, rows)
        ask = np.array([r[5] for r in rows])
        ids, at = np.unique(t.row, return_inverse=True)
        group, block = np.arange(len(ids)), np.flatnonzero(~ask)
        xs, ys = [], []
        for i in np.flatnonzero(ask):
            for k in t.links(i, block[group[at[block]] != group[at[i]]]):
                if group[at[k]] != group[at[i]]:
                    group[group == group[at[k]]] = group[at[i]]
                    xs.append(t.row[i])
                    ys.append(t.row[k])
        if xs:
            yield _edges([np.array(xs)], [np.array(ys)])


def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slot's row with the first row of its shingle.  Slots come sorted by shingle, early ones first; a shingle that is early nowhere decides no pair."""
    last, lead = None, -1
    for batch in batches:
        h, v = batch.column("h").to_numpy(), batch.column("v").to_numpy()
        if not len(h):
            continue
        fresh = np.append(h[0] != last, h[1:] != h[:-1])
        at = np.flatnonzero(fresh)
        # The shingle's own first row, or the one carried over where it began in an earlier batch.
        tile = np.append(lead, np.where(v[at] < _LATE, v[at], -1))[np.cumsum(fresh)]
        row = v & (_LATE - 1)
        keep = (tile >= 0) & (tile != row)
        last, lead = h[-1], tile[-1]
        yield pa.RecordBatch.from_pydict({"tile": tile[keep], "row": row[keep], "late": v[keep] >= _LATE})


def banded(members: DataFrame, name: str) -> DataFrame:
    """``tile, band, own, late, row, n``: each row in its own size band and in the next, where that holds a row of its own, an early one and another."""
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    both = members.select("tile", "row", "n", "late", own.alias("own")).select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    full = both.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("top"), F.min("late").alias("late")).where("k > 1 and top = band and not late").select("tile", "band")
    return stored(both.join(full, ["tile", "band"]).select("tile", "band", "own", "late", "row", "n"), name)


def linked(members: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """``u, v``: links that connect whatever is linked within a tile.  ``members``: the tiles; ``placed``: the same with what is compared."""
    found = stored(placed.repartition("tile", "band").sortWithinPartitions("tile", "band", "late", "row").mapInArrow(lambda it: compare_tiles(it, most), _EDGES_DDL), "links")
    pairs = found.where("tile is null").select(F.col("x").alias("u"), F.col("y").alias("v"))
    rest = found.where("tile is not null").select("tile", "band", F.col("x").alias("row"))
    if rest.isEmpty():
        return pairs
    # Early rows that ask meet every block, late ones the blocks of early rows: a late row is no late row's partner.
    part = lambda df, name: df.groupBy("tile", "band").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("late") == late, F.col("n"))), F.lit(0)) / most).alias(f"{kind}_{name}") for kind, late in (("early", False), ("late", True))])
    asking = part(rest.join(members, ["tile", "band", "row"]), "askers")
    wide = stored(part(members.join(asking, ["tile", "band"], "left_semi"), "blocks").join(asking, ["tile", "band"]), "wide")
    rows = placed.join(wide, ["tile", "band"])

    def dealt(kind: str) -> F.Column:
        """A row's number among the early or late parts, early ones first."""
        of = lambda n: F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1)))
        return F.when(F.col("late"), F.col(f"early_{kind}") + of(F.col(f"late_{kind}"))).otherwise(of(F.col(f"early_{kind}")))

    def every(kind: str) -> F.Column:
        n = F.col(f"early_{kind}") + F.when(F.col("late"), 0).otherwise(F.col(f"late_{kind}"))
        return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))

    asked = rows.withColumn("ask", F.lit(False)).withColumn("i", every("askers")).withColumn("j", dealt("blocks"))
    askers = rows.join(rest, ["tile", "band", "row"], "left_semi").withColumn("ask", F.lit(True)).withColumn("i", dealt("askers")).withColumn("j", every("blocks"))
    cells = asked.unionByName(askers).drop(*wide.columns[2:]).repartition("tile", "band", "i", "j").sortWithinPartitions("tile", "band", "i", "j", F.desc("ask"), "row")
    more = stored(cells.mapInArrow(compare_cells, _EDGES_DDL), "links")
    return pairs.unionByName(more.select(F.col("x").alias("u"), F.col("y").alias("v")))


def links(docs: DataFrame, common: int = COMMON, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Each row with its set's size and class (``doc_id, row, n, head, rep``: the class's first row and its id), and the components of classes (``node, component``, by row)."""
    frequent_ = common_shingles(docs, common)
    rows = stored(
        docs.select("doc_id", "text").mapInArrow(lambda it: describe(it, frequent_), "doc_id long, n int, digest binary, bits binary, prefix array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sets"
    )
    first = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("digest", F.col("first.row").alias("head"), F.col("first.doc_id").alias("rep"))
    named = F.col("doc_id").isNotNull()
    of_row = stored(
        rows.select("doc_id", "row", "n", "digest").join(first, "digest", "left")
        .select("doc_id", "row", "n", F.when(named, F.col("head")).alias("head"), F.when(named, F.col("rep")).alias("rep")), "classes"
    )
    copies = of_row.where("head is null or head <> row").select("row")
    early = F.expr(f"i <= n - ({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT}")
    slots = rows.join(sent(copies), "row", "left_anti").select("row", "n", F.posexplode("prefix").alias("i", "h")).select("h", F.when(early, F.col("row")).otherwise(F.col("row").bitwiseOR(F.lit(_LATE))).alias("v"))
    met = stored(slots.repartition("h").sortWithinPartitions("h", "v").mapInArrow(leaders, "tile long, row long, late boolean").groupBy("tile", "row").agg(F.min("late").alias("late")), "met")
    members = banded(met.unionByName(met.select("tile", F.col("tile").alias("row"), F.lit(False).alias("late")).distinct()).join(rows.select("row", "n"), "row"), "members")
    maybe = linked(members, members.join(rows.select("row", "bits"), "row"), most)
    group = components(maybe).select(F.col("node").alias("row"), F.col("component").alias("tile"))
    chosen = stored(rows.select("row", "doc_id", "n", "digest").join(group, "row"), "candidates")
    members = banded(chosen.withColumn("late", F.lit(False)), "members")
    asked = stored(members.join(chosen.select("row", "doc_id", "digest"), "row"), "asked")
    texts = docs.select("doc_id", "text").join(sent(asked), "doc_id").drop("doc_id")
    return of_row, components(linked(members, texts, most))


def jaccard_components(docs: DataFrame, common: int = COMMON, most: int = MOST) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``."""
    of_row, found = links(docs, common, most)
    heads = of_row.where("head = row").select(F.col("row").alias("node"), "doc_id")
    placed = stored(found.join(heads, "node"), "placed")
    label = placed.select(F.col("node").alias("head"), "component").join(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("head", "component_id")
    return of_row.join(sent(stored(label, "labels")), "head", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id; columns as they are.

    Rows that share an id stay or go together: they stay if one of them is the first of its component.  Rows without id stay.
    """
    placed = jaccard_components(docs).where("doc_id is not null")
    gone = placed.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id")
    return docs.join(stored(gone, "gone"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT r, doc_id, len(sh) AS n FROM s), e AS (SELECT r, unnest(sh) AS h FROM s),
i AS (SELECT a.r AS x, b.r AS y, count(*) AS met FROM e a JOIN e b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM i JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * met >= 80 * (a.n + b.n - met) AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (WITH RECURSIVE c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, u.y FROM c JOIN u ON u.x = c.b) SELECT * FROM c)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(m.doc_id) AS component_id FROM n JOIN c ON c.a = n.r JOIN n m ON m.r = c.b GROUP BY n.r, n.doc_id, n.n
"""
