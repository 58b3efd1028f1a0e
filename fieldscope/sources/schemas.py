"""Declared schemas of the telemetry tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

from fieldscope.functions.numbers import METRICS
from fieldscope.operators.evidence import STORED

DDL = {
    "samples": "session_id bigint, sample_id bigint, ts_us bigint, last_time double, recent_average double, "
    "overall_last double, application_last double, self_overhead double",
    "metric_counters": "client_id bigint, session_id bigint, name string, title string, loaded boolean, phase string, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", memory double",
    "totals": "client_id bigint, overall_recent double, application_recent double",
    "capture_sessions": "client_id bigint, session_id string, addon string, created_at bigint",
    "object_snapshots": "session_id bigint, snap_no bigint, object_id bigint, path string, object_type string, "
    "location string, shown boolean, on_update boolean, self_time double, self_calls bigint",
    "function_snapshots": "session_id bigint, snap_no bigint, path string, fn_id bigint, self_time double, "
    "inclusive_time double, calls bigint",
    "pool_snapshots": "session_id bigint, pool_id bigint, path string, snap_no bigint, active bigint, capacity bigint",
    "storage_roots": "session_id bigint, name string, phase string, bytes bigint, tables bigint, entries bigint",
    "event_records": "session_id bigint, seq bigint, ts_us bigint, event string, args array<struct<type:string,text:string>>",
    "calls": "session_id bigint, seq bigint, ts_us bigint, path string, args array<struct<type:string,text:string>>",
    "catalog": "build bigint, event_name string, signature string",
    "errors": "seq bigint, time bigint, session string, counter bigint, message string, stack string, locals string, source string",
    "exports": "id bigint, account string, created_at bigint, kind string, title string, path string, content string, locale string",
    "evidence": STORED,
    "history": "account string, seq bigint, code string, result string, succeeded boolean, timestamp bigint",
    "nodes": "id bigint, parent_id bigint, key string, kind string, value string",
    "edges": "src bigint, dst bigint",
    "benchmark_samples": "run_id string, iteration bigint, elapsed double, allocated bigint, deallocated bigint",
    "manifest": "build bigint, ord bigint, path string",
    "labels": "locale string, key string, value string",
    "findings": "id string, severity string, build bigint, file string, line int, message string, evidence string",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
