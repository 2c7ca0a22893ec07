"""The change stream, its log, and the index and trees that spare reading everything."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.ingest import incremental
from graphloom.operators import lookup, names
from graphloom.sources import merkle
from graphloom.streaming import debounce

CHANGES = "tree string, path string, change string, ts timestamp, seq long"


def windows(rows, delay, most, end):
    """What closes before ``end``, one tree after the other, a change at a time."""
    out = []
    for tree in sorted({r[0] for r in rows}):
        since, held = None, {}

        def close():
            n = sum(len(v) for v in held.values())
            if len(held) > most:
                out.append((tree, since, None, None, n, True))
            else:
                out.extend((tree, since, p, v[-1], len(v), False) for p, v in held.items())

        for _, path, change, ts, _ in sorted((r for r in rows if r[0] == tree), key=lambda r: (r[3], r[4])):
            if since is not None and ts >= since + delay:
                close()
                since, held = None, {}
            since = since or ts
            held.setdefault(path, []).append(change)
        if since is not None and since + delay < end:
            close()
    return sorted(out, key=str)


def test_debounced_stream_survives_a_restart(spark, tmp_path):
    rnd, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b"]), f"p{rnd.randrange(9)}", rnd.choice(["changed", "deleted"]), start + dt.timedelta(minutes=i * 3 + rnd.randrange(3), microseconds=rnd.randrange(10**6)), i) for i in range(240)]
    source, out, checkpoint, delay = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", dt.timedelta(minutes=30)

    def go(some):
        # The session's own zone reads what was written here.
        spark.createDataFrame(some, CHANGES).coalesce(1).write.mode("append").parquet(source)
        stream = debounce.debounced(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source), 30 * 60_000, 5)
        with debounce.state_store(spark):
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return stream.schema

    # The second run goes on with the windows that the first left open.
    for some in (rows[:100], rows[100:]):
        schema = go(some)
    got = sorted(((r["tree"], r["since"], r["path"], r["change"], r["coalesced"], r["full_scan"]) for r in spark.read.schema(schema).parquet(out).collect()), key=str)
    assert got == windows(rows, delay, 5, max(r[3] for r in rows))
    assert {r[5] for r in got} == {True, False} and spark.conf.get("spark.sql.streaming.stateStore.providerClass") != debounce.PROVIDER


def test_lifecycle_of_runs_that_end_and_fail(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    log = debounce.LifecycleLog(spark, f"{tmp_path}/log", most=3)
    spark.streams.addListener(log)
    runs = []
    try:
        for name, column in (("good", "id"), ("bad", "CAST(raise_error('no') AS INT)")):
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").selectExpr(f"{column} AS id")
            q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception:
                assert name == "bad"
            runs.append(str(q.runId))
            assert log.wait(q.runId)
    finally:
        spark.streams.removeListener(log)
    rows = spark.read.schema(log.SCHEMA).parquet(f"{tmp_path}/log").orderBy("run_id", "number").collect()
    good, bad = ([r for r in rows if r["run_id"] == run] for run in runs)
    assert [r["event"] for r in good] == ["started", "progressed", "ended"] and good[1]["rows"] == 10
    assert bad[0]["event"] == "started" and bad[-1]["event"] == "failed" and "no" in bad[-1]["detail"]


def test_trees_of_hashes_name_the_leaves_that_differ(spark):
    rows = [(f"src/{i}.py", str(i)) for i in range(600)]
    now = dict(rows) | {"src/5.py": "new", "more.py": "1"}
    del now["src/9.py"]
    a, b = (spark.createDataFrame(x, "relative_path string, content_hash string") for x in (rows, sorted(now.items())))
    found, leaves = merkle.drift(b, a, 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, incremental.drift(b, a).collect())) == [("more.py", "added"), ("src/5.py", "changed"), ("src/9.py", "deleted")]
    assert 1 <= leaves.count() <= 3 and merkle.depth_for(600, 4) == 2
    assert merkle.drift(a, a, 4)[1].count() == 0
    trees = [merkle.root(merkle.tree(x, 2)).first() for x in (a, a.orderBy(F.desc("relative_path")), b)]
    assert trees[0] == trees[1] != trees[2]
    empty = a.where("false")
    assert merkle.tree(empty).count() == 0 and merkle.drift(a, empty, 4)[0].count() == 600 and merkle.drift(empty, empty)[0].count() == 0


def test_index_finds_what_a_scan_finds(spark):
    rnd = random.Random(6)
    part = lambda: "".join(rnd.choice("abcÀé_%!x") for _ in range(rnd.randrange(1, 7)))
    nodes = [{"id": str(i), "kind": "class", "canonical_name": f"{part()}.{part()}", "display_name": part(), "origin": "ast", "confidence": "certain", "attributes_json": None if i % 3 else f'{{"k":"{part()}"}}'} for i in range(300)]
    roles = [{"node_id": str(i), "role": f"role.{part()}", "origin": "x", "confidence": "certain", "rule_id": "r"} for i in range(0, 300, 7)]
    plain = Graph.of(spark, nodes=nodes, classifications=roles)
    g = names.indexed(plain, 32)
    for term in ("abc", "ÀÉ", "àéx", "%!", "x", "role.", nodes[5]["canonical_name"], "nowhere at all", "ab_"):
        assert lookup.find_component(g, term, 100).collect() == lookup.find_component(plain, term, 100).collect(), term
        both = f"{term} a"
        assert lookup.search(g, both, limit=100).collect() == lookup.search(plain, both, limit=100).collect(), both
    held = names.candidates(g, nodes[5]["canonical_name"]) if len(nodes[5]["canonical_name"]) > 2 else None
    assert held is None or held.count() < 30
    assert names.candidates(g, "ab") is None and names.candidates(plain, "abc") is None
    steps = spark.createDataFrame([([3, 7, 8, 20],), ([],)], "p array<int>").select(names.summed(names.differences(F.col("p"))).alias("p")).collect()
    assert [r["p"] for r in steps] == [[3, 7, 8, 20], []]
    empty = names.indexed(Graph.of(spark))
    assert lookup.find_component(empty, "abc").count() == 0


def test_postings_of_a_block_hold_every_trigram_in_order(spark):
    rows = pd.DataFrame({"block": [3, 3, 3], "place": [9, 2, 5], "low": ["abcab", "xabc", "éab\U0001f600"]})
    found = names._posted(rows)
    assert {g: np.cumsum(s).tolist() for g, s in zip(found["gram"], found["steps"])} == {"abc": [2, 9], "bca": [9], "cab": [9], "xab": [2], "éab": [5], "ab\U0001f600": [5]}
    # Numbers are summed outside of lambdas, in one pass over a list.
    places = list(range(0, 60_000, 3))
    steps = spark.createDataFrame([(places,)], "p array<int>").select(names.summed(names.differences(F.col("p"))).alias("p")).first()["p"]
    assert steps == places
