"""Queries on event streams; each equals a batch query on the same events."""

from pyspark.sql import functions as F

from ..functions.scratch import fresh_path
from ..functions.tables import Landing
from ..operators import traces as R
from ..operators.store import top
from ..streaming import streams as S
from ..streaming import timers as W
from .registry import query


def _events(t):
    return S.source(t.spark, f"{t.folder}/events.parquet")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_at_least_once(t):
    return S.landed(_events(t).select("event_id", "user_id", "event_type"), "events")


@query("SELECT DISTINCT user_id, event_type, ts::DATE::VARCHAR AS day FROM events")
def stream_dedup(t):
    rows = _events(t).withColumn("day", F.to_date("ts").cast("string"))
    return S.landed(S.deduplicated(rows, ["user_id", "event_type", "day"], "ts"), "dedup")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) >= 50 AS good FROM events")
def stream_bad_rows(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    good, bad = S.good_and_bad(_events(t).select("event_id", "props"), k >= 50, "bad")
    return good.select("event_id", F.lit(True).alias("good")).union(bad.select("event_id", F.lit(False)))


@query("SELECT 'errors' AS sink, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events")
def stream_fanout(t):
    tries = []

    def passing(b):  # fails in a task, once
        tries.append(1)
        return b.select(F.when(F.lit(len(tries) == 1) & (F.col("event_type") == "error"), F.raise_error(F.lit("a passing fault")).cast("long")).otherwise(F.col("user_id")).alias("user_id")).distinct()

    sinks = {"errors": lambda b: b.where("event_type = 'error'").select("event_id"), "users": passing, "broken": lambda b: b.select("no_such_column")}
    found, _ = S.fan_out(_events(t), sinks, "fan")
    errors = found["errors"].agg(F.lit("errors").alias("sink"), F.count("*").alias("n"))
    return errors.union(found["users"].distinct().agg(F.lit("users"), F.count("*")))


@query("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def stream_acknowledged(t):
    rows = _events(t).select("event_id", "user_id", "event_type", "props")
    made = lambda b: b.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return S.acknowledged(rows, made, F.col("event_type").isin("purchase", "error"), "ack")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 1 THEN repeat('0', (user_id % 3)::INT) || user_id END AS p, '{"values":["' || event_type || '"]}' AS attributes FROM events""")
def stream_span_export(t):
    parent = F.concat(F.repeat(F.lit("0"), F.pmod("user_id", F.lit(3)).cast("int")), F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")))
    rows = _events(t).select("event_id", parent.alias("parent"), F.array("event_type").alias("attributes"))
    folder = fresh_path(t.spark, "stream-spans")
    S.export_spans(rows, folder, every=None).awaitTermination()
    return Landing(t.spark, f"{folder}/rows").read(S.span_rows(rows).schema).select("event_id", F.col("parent").alias("p"), "attributes")


PROJECTION_SQL = """SELECT user_id, min(ts) AS started, arg_max(event_type, (ts, event_id)) AS last_kind, max(ts) AS last_seen, min(ts) FILTER (event_type IN ('purchase', 'error')) AS finished, count(*) AS n FROM events GROUP BY user_id"""


@query(PROJECTION_SQL)
def stream_projection(t):
    return S.landed(S.projection(_events(t), "user_id", "ts", "event_id", "event_type", ["purchase", "error"]), "projection", "complete")


@query("""WITH keys AS (SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 20)
    SELECT user_id, event_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM keys) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""")
def stream_replay_buffer(t):
    return S.replay_buffers(_events(t).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "replay", 10, 20).drop("ts")


@query("""SELECT event_id, user_id, silent_s FROM (SELECT *, epoch(ts)::BIGINT AS s, (epoch_us(ts) // 1000000) - (epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000) AS silent_s FROM events) WHERE silent_s > 45000""")
def stream_liveness_gaps(t):
    rows = S.landed(_events(t).select("event_id", "user_id", "ts"), "liveness")
    return S.gaps(rows, "user_id", "ts", "event_id", 45_000).select("event_id", "user_id", "silent_s")


CLOCK_SQL = "clock AS (SELECT max(epoch_us(ts) // 1000) AS c FROM events)"


@query(f"""WITH {CLOCK_SQL}, signals AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id, event_type <> 'view' AS good FROM events UNION ALL SELECT DISTINCT user_id, c, NULL, false FROM events, clock),
    gaps AS (SELECT *, at_ms - lag(at_ms) OVER w > 45000000 AS stale, lag(at_ms) OVER w + 45000000 AS stale_at,
        coalesce(sum(good::INT) OVER (PARTITION BY user_id ORDER BY at_ms, event_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM signals WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id NULLS LAST))
    SELECT user_id AS key, 'stale' AS state, min(stale_at) AS at_ms FROM gaps WHERE stale GROUP BY user_id, part
    UNION ALL SELECT user_id, 'recovered', max(at_ms) FILTER (good) FROM gaps GROUP BY user_id, part HAVING bool_or(stale) AND bool_or(good)""")
def stream_liveness_timers(t):
    """Views are signals of the link, all other events messages; the clock is the greatest time of the stream."""
    return W.landed(W.liveness(_events(t), "user_id", "ts", "event_id", F.col("event_type") != "view", 45_000), "watchdog")


@query(f"""WITH {CLOCK_SQL}, moves AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS n,
        CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' ELSE 'opened' END AS kind FROM events),
    opened AS (SELECT key, min(at_ms) AS opened, arg_min(n, (at_ms, n)) AS open_n FROM moves WHERE kind = 'opened' GROUP BY key),
    decisions AS (SELECT m.*, coalesce((at_ms > opened OR at_ms = opened AND n > open_n) AND at_ms - opened <= 14400000, false) AS timely FROM moves m LEFT JOIN opened USING (key) WHERE kind <> 'opened'),
    marked AS (SELECT *, timely AND row_number() OVER (PARTITION BY key, timely ORDER BY at_ms, n) = 1 AS wins FROM decisions)
    SELECT key, CASE WHEN wins THEN kind ELSE 'REFUSED' END AS status, 'user' AS reviewer, at_ms FROM marked
    UNION ALL SELECT key, 'REJECTED', 'system', opened + 14400000 FROM opened, clock WHERE c - opened > 14400000 AND key NOT IN (SELECT key FROM marked WHERE wins)""")
def stream_gate_timers(t):
    """A gate for each user and day: the first of other events opens it, purchases approve and errors reject."""
    gate = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    kind = F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_type") == "error", "REJECTED").otherwise("opened")
    return W.landed(W.gates(_events(t).withColumn("gate", gate), "gate", "ts", "event_id", kind, 14_400), "gates")


@query("""WITH RECURSIVE asked AS (SELECT user_id, event_id AS n, epoch_us(ts) // 1000 AS at_ms, (event_id % 7) * 14400000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
    walk AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::BIGINT[] AS ends, NULL::BIGINT AS n, NULL::BOOLEAN AS admitted, 0::BIGINT AS at_ms FROM asked
        UNION ALL SELECT a.user_id, a.i, CASE WHEN len(list_filter(w.ends, lambda e: e > a.at_ms)) < 2 THEN list_append(list_filter(w.ends, lambda e: e > a.at_ms), a.at_ms + a.ms) ELSE list_filter(w.ends, lambda e: e > a.at_ms) END,
            a.n, len(list_filter(w.ends, lambda e: e > a.at_ms)) < 2, a.at_ms FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.i = w.i + 1)
    SELECT user_id AS key, n, admitted, len(ends)::INT AS running, at_ms FROM walk WHERE i > 0""")
def stream_admissions(t):
    """Each user's events as requests that run for some hours, two at once at most."""
    return W.landed(W.admissions(_events(t), "user_id", "ts", "event_id", F.col("event_id") % 7 * 14_400_000, 2), "admissions")


@query("""SELECT DISTINCT ts, user_id, event_type FROM (SELECT ts, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10') ORDER BY ts DESC, user_id, event_type LIMIT 50""")
def stream_snapshot_history(t):
    snapshot = t.events.where("ts < TIMESTAMP_NTZ '2024-01-20'").select("ts", "user_id", "event_type")
    history = S.landed(_events(t).where("ts >= TIMESTAMP_NTZ '2024-01-10'").select("ts", "user_id", "event_type"), "history")
    return top(snapshot.unionByName(history).distinct(), 50, F.desc("ts"), "user_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-29' - INTERVAL 60 SECOND ORDER BY ts, event_id LIMIT 500")
def stale_redelivery(t):
    return S.stale(t.events.where("event_type = 'view'").select("event_id", "ts"), "ts", "2024-01-29", 60, 500, "event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(t):
    timed = _events(t).withColumn("at", F.col("ts").cast("timestamp"))
    counts = timed.withWatermark("at", "1 day").groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return S.landed(counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"), "tumbling", "complete")


@query("""WITH marked AS (SELECT *, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 > 14400)::INT AS fresh FROM events),
    numbered AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS session FROM marked)
    SELECT user_id, session::BIGINT AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM numbered GROUP BY ALL""")
def ext_session(t):
    return R.sessions(t.events, "user_id", "ts", "event_id", 14_400).groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
