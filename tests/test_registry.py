"""The driver's contract, and a spread of registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from fieldscope.plans.spread import portions
from workloads import load

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = """
capture_summary benchmark_summary health_snapshot health_rank object_lifecycle pool_activity hot_functions storage_delta
catalog_search name_match_roots error_occurrences evidence_migrate evidence_number order_reconcile history_prune label_parity
tree_flatten path_resolve graph_reach canonical_text findings_union catalog_extract cpu_report ring_state_stream
""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    own, queries, oracle = load(), entry.queries(), entry.oracle_sql()
    assert len(own.QUERIES) > 130 and set(own.ORACLES) == set(own.QUERIES)
    assert set(own.QUERIES) <= set(queries) and set(own.ORACLES) <= set(oracle) <= set(queries)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    relation = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


def test_objects_are_dealt_by_their_number(spark, monkeypatch):
    from workloads import views

    monkeypatch.setattr(views, "portions", lambda df, *keys: portions(df, *keys, rows=500))
    whole = views.object_snapshots(spark, SMALL)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and views.table(spark, SMALL, "lineitem").count() > 2000
    assert whole.count() == whole.select("session_id", "snap_no", "object_id").distinct().count()


def test_object_report_reads_what_its_layers_left(spark):
    read = entry.queries()["object_report"](spark, SMALL).inputFiles()
    assert read and not [f for f in read if f.startswith(f"file://{SMALL}/")]  # each layer is worked out once, whatever the report asks of it
