"""Packing under several capacities against a placement piece by piece, and on awkward tables."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import vector_packing as vp

SCHEMA = "doc_id long, text string, ids string, part string, number string, length string, offset string, begin string"
WORDS = "the quick brown fox jumps over a lazy dog while ünïcödé 12 things 😀 remain unbelievably indescribable".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def one_by_one(counts, length, documents, cost, score):
    """Every piece placed on its own, every open sequence looked at: the pieces of each sequence in order."""
    capacity = np.array([length, documents, cost], dtype=np.int64)
    total = sum(np.array([n, 1, n * n], dtype=object) * m for n, m in counts.items())
    weights = np.array([float(t) for t in total]) / sum(counts.values()) / capacity
    used, held = [], []
    for n in sorted(counts, reverse=True):
        demand = np.array([n, 1, n * n], dtype=np.int64)
        for _ in range(counts[n]):
            best = None
            for i, u in enumerate(used):
                room = capacity - u
                if (room >= demand).all():
                    points = -(weights * ((room - demand) / capacity) ** 2).sum() if score == "norm" else (weights * (room / capacity) * (demand / capacity)).sum()
                    if best is None or points > best[0]:
                        best = points, i
            if best is None:
                used.append(np.zeros(3, dtype=np.int64))
                held.append([])
                best = 0, len(used) - 1
            used[best[1]] = used[best[1]] + demand
            held[best[1]].append(n)
    return held


def by_steps(placement, counts):
    """The pieces of each sequence in order of their offsets, as the steps tell."""
    held = collections.defaultdict(list)
    for n, steps in placement.lookup().items():
        sequence, offset = vp.find(steps, n, np.arange(counts[n]))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            held[s].append((o, n))
    out = []
    for s in range(placement.sequences):
        at = 0
        for o, n in sorted(held[s]):
            assert o == at
            at += n
        out.append([n for _, n in sorted(held[s])])
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "cost"), [(64, 64 * 64), (5, 64 * 64), (64, 2000), (3, 1700)])
def test_steps_do_what_one_by_one_does(score, documents, cost):
    rnd = random.Random(documents * cost)
    for most in (3, 12, 40):
        counts = {n: rnd.randrange(1, 30) for n in rnd.sample(range(1, most + 1), min(most, 12))}
        placement = vp.Placement(counts, 64, documents, cost, score)
        got = by_steps(placement, counts)
        assert sorted(map(sorted, got)) == sorted(map(sorted, one_by_one(counts, 64, documents, cost, score)))
        for s in got:
            assert sum(s) <= 64 and len(s) <= documents and sum(n * n for n in s) <= cost


def test_few_sequences_and_few_steps_for_any_number_of_pieces():
    rnd = random.Random(1)
    counts = {n: rnd.randrange(1, 3_000_000) // n + 1 for n in range(1, 2049)}
    placement = vp.Placement(counts, 2048, 2048, 2048**2)
    tokens = sum(n * m for n, m in counts.items())
    assert placement.sequences <= 1.001 * -(-tokens // 2048) and len(placement.steps) < 50_000


def test_what_no_capacity_holds_is_refused():
    with pytest.raises(ValueError, match="alone"):
        vp.Placement({10: 1}, 64, 64, 99)
    with pytest.raises(ValueError, match="norm or dot"):
        vp.Placement({10: 1}, 64, 64, 100, "best")


def awkward():
    rnd = random.Random(2)
    texts = [None, "", "   ", "a", prose(rnd, 5000), prose(rnd, 2047), "x" * 9000, "<|endoftext|> it's", "word " * 2047, "word " * 2048, "\x00\x01"]
    texts += [prose(rnd, rnd.randrange(0, 400)) for _ in range(150)] + ["the same text"] * 80
    rows = list(enumerate(texts))
    return rows + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]


def checked(got, docs, length, documents, cost, room=None):
    """Contract of the result: every piece of every document once, sequences without gaps, every capacity kept."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), length)):
            cut = np.array(ids[start : start + length], dtype="<u4").tobytes()
            want[doc, piece, start, len(cut) // 4, zlib.crc32(cut)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = collections.defaultdict(list)
    room = room or length
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert len(places) <= documents and sum(n * n for _, n in places) <= cost
        assert at <= room
    return len(held), sum(k[3] * m for k, m in want.items())


def test_whole_table(spark):
    rows = awkward()
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(7)
    got = vp.packed(docs)
    found = got.collect()
    n, tokens = checked(found, rows, 2048, 2048, 2048**2)
    assert n <= -(-tokens // 2048) + 1
    for r in found:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    whole = vp.sequences(got).collect()
    assert len(whole) == n
    for s in whole:
        mine = sorted((r["offset"], bytes(r["ids"])) for r in found if r["sequence_id"] == s["sequence_id"])
        assert bytes(s["input_ids"]) == b"".join(b for _, b in mine) and s["cu_seqlens"] == [*(o for o, _ in mine), s["n_tokens"]]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_other_capacities(spark, score):
    rows = awkward()
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    # A piece of more than 200 tokens would pass the cost on its own, so documents are cut there.
    checked(vp.packed(docs, 256, 6, 40_000, score).collect(), rows, 200, 6, 40_000, 256)


def test_empty_table_and_ids(spark):
    assert vp.packed(spark.createDataFrame([], SCHEMA)).count() == 0
    got = vp.packed(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("").alias("text")))
    assert got.agg(F.countDistinct("sequence_id"), F.max("offset"), F.sum("length")).first() == (1, 99, 100)
