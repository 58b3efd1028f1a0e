"""Small tables are written by few tasks, however many shuffle partitions there are."""

import os

import pytest

from fieldscope import session
from fieldscope.llm import quality, secrets, simhash


@pytest.fixture
def many_partitions(spark):
    """Shuffles into 60 partitions that nothing puts together."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_work_tables_are_few_files(spark, docs, many_partitions, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    plain = {(r["doc_id"], r["text"]) for r in docs.collect()}
    left = {(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()}
    secrets.secret_spans(docs).collect()
    assert left and left <= plain
    files = {d: sum(f.endswith(".parquet") for f in os.listdir(tmp_path / d)) for d in os.listdir(tmp_path)}
    assert any(d.startswith("fingerprint-links") for d in files) and any(d.startswith("trigram-index") for d in files)
    assert max(files.values()) <= 16, files


def test_in_few_tasks_goes_by_rows(spark):
    many = spark.range(0, 1000, 1, 100)
    assert session.in_few_tasks(many, 1000).rdd.getNumPartitions() == 16
    assert session.in_few_tasks(many, 40, 1).rdd.getNumPartitions() == 40
    assert session.in_few_tasks(many, 10**9).rdd.getNumPartitions() == 100
    assert sorted(r["id"] for r in session.in_few_tasks(many, 1000).collect()) == list(range(1000))


def test_text_is_sent_once(docs):
    plan = quality.signals(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_measured" not in plan
    assert "_measured" in quality.signals(docs, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
