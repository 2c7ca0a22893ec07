"""Fill-in-middle against a plain version, and on awkward tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, marked string, n string, digest string, form string, low string, prefix string"


def plainly(doc_id, text):
    """Units listed, cut and put together without markers."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def awkward():
    rnd = random.Random(3)
    pieces = ["\x01", "\x02", "\x03", "\x04", "\x02\x03", "\x02\x04", "ab", "Z", " ", "\n", "\r\n", "é", "ß", "😀", "é", "<", "S>", "<S", "<P", "M>", "1", "$0", "\\", " ", "\x85", "K", "ſ"]
    texts = [None, "", " ", "a", "word", "\x01", "\x02", "\x02\x03", "\x01\x02\x01", "a<P>b", "<S>", "x <M", "<<S", "😀" * 9, "the end.\n" * 300]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    rows = list(enumerate(texts))
    return rows + [(7, "one more"), (7, "one more"), (None, "no id here"), (None, None), (-5, "below zero"), (1 << 60, "large")]


def test_parts_output_and_restored_text(spark):
    rows = awkward()
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    out = fim.fill_in_middle(docs)
    got = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert sorted(map(str, [(r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["again"]) for r in got])) == sorted(
        map(str, [(i, *plainly(i, t), t or "") for i, t in rows])
    )
    forms = {r["form"] for r in got}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("shares", [(0, 0), (0, 100), (100, 50)])
def test_shares_of_forms(spark, shares):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = {r[0] for r in fim.fill_in_middle(docs, plain_percent=shares[0], spm_percent=shares[1]).select("form").distinct().collect()}
    assert forms == {(0, 0): {"psm"}, (0, 100): {"spm"}, (100, 50): {"plain"}}[shares]


def test_a_seed_cuts_otherwise(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words that are cut here or there").alias("text"))
    cuts = [[tuple(r) for r in fim.fill_in_middle(docs, seed).orderBy("doc_id").select("prefix", "middle").collect()] for seed in (1, 1, 2)]
    assert cuts[0] == cuts[1] != cuts[2]


def test_very_long_texts(spark):
    texts = ["lorem ipsum, " * 150_000, "\x01\x02" * 500_000, "é" * 1_000_000, "a" * 2_000_000]
    got = fim.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), plain_percent=0)
    rows = got.select("doc_id", "n", F.sha2(F.col("output").cast("binary"), 256).alias("o"), F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("r")).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n"] == len(UNIT.findall(text)) and r["r"] == hashlib.sha256(text.encode()).hexdigest() != r["o"]


def test_empty_table_and_no_python(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
