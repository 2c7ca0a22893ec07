"""The driver's contract, and that the corpus subpackage can be taken away."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
#: Queries that are held against their SQL here; the driver does all of them.
SOME = [
    "qry_01_architecture_summary", "imp_01_impact_analysis", "cyc_01_all_kinds", "pol_01_check_architecture", "snp_01_snapshot_diff", "agg_05_in_out_cross_degree", "bnd_03_prefix_membership", "snp_05_quality_gate", "ded_01_dead_code",
    "rec_02_resolution_cascade", "rec_03_method_of_return", "rec_04_namespaced_function", "jon_05_nodes_in_files", "imp_02_changed_files_impact", "rec_12_contribution_audit", "snp_04_quality_metrics", "loc_01_suggest_location", "dia_01_diagram_pool",
    "rec_02_inherited_members", "imp_03_test_impact", "cyc_01_long_ring", "snk_01_written", "str_02_debounced", "qry_02_indexed_names", "src_07_hash_tree",
    "src_02_ignore_matcher", "src_03_language", "cls_07_test_path", "cls_00_engine", "rec_07_collapse_edges", "str_04_overflow", "agg_07_boundary_cohesion", "hlt_02_hotspots", "flw_01_explain_flow",
]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_changed_files_hold_components_of_every_kind(spark):
    """Orders count among the changed components and their dependants, as a plain walk over the whole graph finds them."""
    from graphloom import schema as S
    from graphloom.plans import catalog
    from graphloom.views import graph

    g = graph(spark, str(DATA))
    run = lambda name: catalog.QUERIES[name](spark, str(DATA)).collect()
    files = {r["id"] for r in g.files.where(g.files.relative_path.isin(catalog.PATHS)).collect()}
    nodes = {r["id"]: (r["canonical_name"], r["kind"]) for r in g.nodes.where("id is not null").collect()}
    direct = {r["id"] for r in g.nodes.where(g.nodes.file_id.isin(files)).select("id").collect()}
    assert "method" in {nodes[i][1] for i in direct}
    assert sorted(r["id"] for r in run("jon_05_nodes_in_files")) == sorted(direct)

    users = {}
    for r in g.edges.where(g.edges.kind.isin(S.IMPACT_KINDS)).select("source_id", "target_id").distinct().collect():
        users.setdefault(r["target_id"], set()).add(r["source_id"])
    best = {}
    for seed in direct:
        known = level = {seed}
        for distance in (1, 2, 3):
            level = {u for i in level for u in users.get(i, ())} - known
            known = known | level
            for i in level & nodes.keys():
                best[i] = min(best.get(i, (9, "")), (distance, seed))
    expected = sorted((d, nodes[i][0], i, seed) for i, (d, seed) in best.items())[:100]
    assert "method" in {nodes[i][1] for _, _, i, _ in expected}
    assert [(r["distance"], r["canonical_name"], r["id"], r["seed"]) for r in run("imp_02_changed_files_impact")] == expected


def test_diagnostics_and_audit_take_all_events(spark):
    from graphloom.plans import catalog
    from graphloom.views import graph

    events = spark.read.parquet(str(DATA / "events.parquet")).select("event_id", "user_id").collect()
    told = graph(spark, str(DATA)).diagnostics.groupBy("severity").count().collect()
    assert {r["severity"]: r["count"] for r in told} == {s: sum(r["event_id"] % 3 == k for r in events) for k, s in enumerate(("error", "warning", "info"))}

    asked = {str(r["page_id"]) for r in spark.read.parquet(str(DATA / "pages.parquet")).collect()}
    got = [str(r["user_id"]) for r in events]
    expected = {(i, "omitted") for i in asked - set(got)} | {(i, "misattributed") for i in set(got) - asked} | {(i, "duplicated") for i in asked & set(got) if got.count(i) > 1}
    assert {tuple(r) for r in catalog.QUERIES["rec_12_contribution_audit"](spark, str(DATA)).collect()} == expected


def test_rest_works_without_the_corpus_subpackage(tmp_path):
    """Everything but the corpus folders is there, as after their deletion; a query of the rest runs."""
    for name in ("graphloom", "__spark_entry__.py", "tests", "bench.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "graphloom/llm")
    shutil.rmtree(tmp_path / "tests/llm")
    text = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print(len(q), any(n.startswith("op") or n == "pipeline" for n in q), q["src_06_fingerprint"](s, {str(DATA)!r}).count())
"""
    said = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, env=os.environ | {"HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert said.returncode == 0 and said.stdout.split()[-3:][1:] == ["False", "200"], said.stderr
