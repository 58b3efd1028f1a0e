"""Streams run to the end of what is available; the tables they leave are compared."""

from pyspark.sql import functions as F

from fieldscope.session import fresh_dir
from fieldscope.streaming import captures as C
from fieldscope.streaming import merged as M
from fieldscope.streaming import runner as R
from workloads import views as V
from workloads.events import ARGUMENTS
from workloads.lifecycle import LIFECYCLE
from workloads.registry import query


def events(spark, d):
    return R.table_stream(spark, f"{d}/events*.parquet")


@query(
    "event_capture_stream",
    f"SELECT seq, event, array_to_string({ARGUMENTS}, ', ') AS summary FROM event_records WHERE event IN ('CLICK', 'ERROR')",
    ("event_records",),
)
def event_capture_stream(spark, d):
    live = V.event_records(spark, d, events(spark, d))
    captured = C.event_capture_stream(live, ["CLICK", "ERROR"], V.event_records(spark, d))
    return R.run_to_table(captured.select("seq", "event", "summary"), "events")


@query(
    "ring_state_stream",
    """SELECT session_id, seq, event, row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, seq DESC) AS rank
    FROM event_records QUALIFY rank <= 25""",
    ("event_records",),
)
def ring_state_stream(spark, d):
    live = V.event_records(spark, d, events(spark, d))
    changes = R.run_to_table(C.ring_state_stream(live, 25, 4), "ring")
    return C.ring_contents(changes, 25).select("session_id", "seq", "event", "rank")


@query(
    "sample_windows_stream",
    """WITH w AS (SELECT session_id, ts_us - ts_us % 21600000000 AS start_us, count(last_time) AS samples,
        sum(last_time::DECIMAL(28,6))::DOUBLE AS total, max(last_time) AS peak FROM samples GROUP BY ALL)
    SELECT *, total / nullif(samples, 0) AS average FROM w""",
    ("samples",),
)
def sample_windows_stream(spark, d):
    live, end = R.closable(V.samples(spark, d, events(spark, d)))
    return R.run_to_table(C.sample_windows_stream(live, "6 hours", delay="1 hour"), "windows", end=end)


@query(
    "capture_session_stream",
    """WITH g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM samples),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS no FROM g),
    s AS (SELECT session_id, count(*) AS samples, sum(last_time::DECIMAL(28,6))::DOUBLE AS total, min(ts_us) AS started_us, max(ts_us) AS ended_us
      FROM n GROUP BY session_id, no)
    SELECT * FROM s""",
    ("samples",),
)
def capture_session_stream(spark, d):
    live, end = R.closable(V.samples(spark, d, events(spark, d)))
    return R.run_to_table(C.capture_session_stream(live, "12 hours", delay="1 hour"), "sessions", end=end)


@query(
    "capture_control_stream",
    """WITH RECURSIVE c AS (SELECT user_id AS session_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn,
        CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'manual' ELSE 'combat' END AS action
      FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    r AS (SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::BIGINT AS open, 0::BIGINT AS no,
        NULL::BIGINT AS capture_no, NULL::BIGINT AS started_us, NULL::BIGINT AS ended_us, NULL::VARCHAR AS reason FROM c
      UNION ALL
      SELECT session_id, rn, CASE WHEN action = 'start' THEN CASE WHEN running THEN open ELSE t END END,
        no + CASE WHEN action = 'start' AND NOT running THEN 1 ELSE 0 END,
        CASE WHEN over OR stopped THEN no END, CASE WHEN over OR stopped THEN open END,
        CASE WHEN over THEN open + 1800000000 WHEN stopped THEN t END, CASE WHEN over THEN 'complete' WHEN stopped THEN action END
      FROM (SELECT c.*, r.open, r.no, coalesce(c.t >= r.open + 1800000000, false) AS over, coalesce(c.t < r.open + 1800000000, false) AS running,
              coalesce(c.t < r.open + 1800000000, false) AND c.action <> 'start' AS stopped
            FROM r JOIN c ON c.session_id = r.session_id AND c.rn = r.rn + 1))
    SELECT session_id, capture_no, started_us, ended_us, reason FROM r WHERE reason IS NOT NULL
    UNION ALL SELECT session_id, no, open, open + 1800000000, 'complete' FROM r
    WHERE open IS NOT NULL AND rn = (SELECT max(rn) FROM c WHERE c.session_id = r.session_id)""",
)
def capture_control_stream(spark, d):
    """Signups start a capture of half an hour, purchases stop it by hand, errors by combat."""
    e = events(spark, d).filter("event_type IN ('signup', 'purchase', 'error')")
    control = e.select(
        F.col("user_id").alias("session_id"),
        V.epoch_us("ts").alias("ts_us"),
        F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "manual").otherwise("combat").alias("action"),
        F.lit(1800 * 1000000).cast("bigint").alias("duration_us"),
    )
    live, end = R.closable(control, session_id=-1)
    return R.run_to_table(C.capture_control_stream(live, longest_seconds=1800, delay="1 hour"), "control", end=end)


@query(
    "object_state_stream",
    f"WITH {LIFECYCLE} SELECT session_id, newly_observed, activations, reused_activations, hidden_transitions, reuse_rate FROM lifecycle",
    ("object_snapshots",),
)
def object_state_stream(spark, d):
    """Snapshots stored in two stretches of four files, and read back a stretch per micro-batch."""
    path = fresh_dir(spark, "snapshots")
    snapshots = V.object_snapshots(spark, d).select("session_id", "object_id", "snap_no", "shown")
    for half in (F.col("snap_no") <= 1998, F.col("snap_no") > 1998):
        snapshots.filter(half).repartition(4, "object_id").write.mode("append").parquet(path)
    return M.object_state_stream(R.table_stream(spark, path, files_per_batch=4), fresh_dir(spark, "objects"))


@query(
    "error_feed_stream",
    """SELECT coalesce(message, '') AS message, coalesce(stack, '') AS stack, sum(coalesce(counter, 1))::BIGINT AS occurrences,
      min(time) AS first_time, max(time) AS last_time, max(seq) AS latest_seq,
      sha256(coalesce(message, '') || chr(10) || coalesce(stack, '')) AS signature
    FROM errors GROUP BY ALL""",
    ("errors",),
)
def error_feed_stream(spark, d):
    return M.error_feed_stream(V.errors(spark, d, events(spark, d)), fresh_dir(spark, "errors"))


@query("late_data", "SELECT seq, event, session_id FROM event_records", ("event_records",))
def late_data(spark, d):
    live = V.event_records(spark, d, events(spark, d)).select("seq", "event", "session_id", "ts_us")
    again = V.event_records(spark, d, events(spark, d)).select("seq", "event", "session_id", "ts_us")
    return R.run_to_table(C.late_data(live.unionByName(again)).drop("ts_us"), "late")
