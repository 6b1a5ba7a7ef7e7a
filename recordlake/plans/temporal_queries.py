"""Queries of changes, availability and time travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.operators import temporal

from . import views
from .registry import Tables, query

CHANGES = "changes AS (SELECT entity_id, path, pos, ts, before AS \"from\", k AS \"to\" FROM (SELECT *, lag(k) OVER (PARTITION BY entity_id, path ORDER BY ts, pos) AS before FROM obs WHERE k IS NOT NULL) WHERE before IS NOT NULL AND before <> k)"
KNOWN = "known AS (SELECT entity_id, path, arg_max(k, (ts, pos)) AS k, max(ts) AS seen_at FROM obs WHERE k IS NOT NULL GROUP BY 1, 2)"
W = f"WITH {views.OBS}, {CHANGES}, {KNOWN} "
MID = "TIMESTAMP '2024-01-15 00:00:00'"
LATE = "TIMESTAMP '2024-01-22 00:00:00'"


def _changes(t: Tables) -> DataFrame:
    return temporal.changes(views.observations(t))


def _known(t: Tables) -> DataFrame:
    return temporal.last_known(views.observations(t))


@query(W + 'SELECT entity_id, path, pos, "from", "to" FROM changes')
def change_stream(t: Tables) -> DataFrame:
    return _changes(t).drop("at")


@query(W + "SELECT entity_id, path, k, epoch_us(seen_at) // 1000 AS seen_ms FROM known")
def last_known(t: Tables) -> DataFrame:
    return _known(t).select("entity_id", "path", "k", F.unix_millis("seen_at").alias("seen_ms"))


@query(W + ", early AS (SELECT entity_id, path, arg_max(k, (ts, pos)) AS k FROM obs WHERE day < DATE '2024-01-05' GROUP BY 1, 2) SELECT coalesce(e.entity_id, k.entity_id) AS entity_id, coalesce(e.path, k.path) AS path, coalesce(e.k, k.k) AS k FROM early e FULL JOIN known k ON e.entity_id = k.entity_id AND e.path = k.path")
def fill_missing(t: Tables) -> DataFrame:
    early = temporal.last_known(views.observations(t).where("day < '2024-01-05'")).select("entity_id", "path", "k")
    return temporal.fill_missing(early, _known(t).select("entity_id", "path", "k"), ("entity_id", "path"), "k")


TRANSITIONS = 'transitions AS (SELECT entity_id, pos, ts, before AS "from", k AS "to" FROM (SELECT *, lag(k) OVER (PARTITION BY entity_id ORDER BY ts, pos) AS before FROM obs WHERE k IS NOT NULL) WHERE before IS NOT NULL AND before <> k)'


@query(f"WITH {views.OBS}, {TRANSITIONS} SELECT entity_id, pos, \"from\", \"to\" FROM transitions")
def metric_transitions(t: Tables) -> DataFrame:
    return temporal.changes(views.observations(t), ("entity_id",)).drop("at")


@query(f"WITH {views.OBS}, {TRANSITIONS} SELECT entity_id, epoch_us(max(ts)) // 1000 AS latest_ms FROM transitions GROUP BY 1")
def latest_change(t: Tables) -> DataFrame:
    return temporal.changes(views.observations(t), ("entity_id",)).groupBy("entity_id").agg(F.unix_millis(F.max("at")).alias("latest_ms"))


@query(W + "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM changes GROUP BY 1")
def changes_by_month(t: Tables) -> DataFrame:
    return temporal.month_counts(_changes(t))


@query(W + "SELECT entity_id, path, pos FROM changes ORDER BY ts DESC, pos DESC LIMIT 1000")
def recent_changes_topn(t: Tables) -> DataFrame:
    return _changes(t).orderBy(F.desc("at"), F.desc("pos")).limit(1000).select("entity_id", "path", "pos")


@query(f"WITH {views.OBS}, c AS (SELECT *, lag((k, value)) OVER (PARTITION BY entity_id ORDER BY ts, pos) AS b FROM obs) SELECT entity_id, pos, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, pos DESC) AS INTEGER) AS age FROM c WHERE b IS NULL OR b <> (k, value) QUALIFY age <= 16")
def metric_history_tail(t: Tables) -> DataFrame:
    return temporal.metric_tail(views.observations(t), ("k", "value"), 16).select("entity_id", "pos", "age")


GAPS = """ev AS (SELECT * FROM obs WHERE status IS NOT NULL),
gaps AS (SELECT *, count(*) FILTER (status = 'deleted') OVER (PARTITION BY entity_id ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS gap FROM ev),
rest AS (SELECT * FROM gaps WHERE gap > 0 AND status = 'public' QUALIFY row_number() OVER (PARTITION BY entity_id, gap ORDER BY ts, pos) = 1)"""


@query(f"WITH {views.OBS}, {GAPS} SELECT entity_id, pos, source FROM rest")
def restorations_any(t: Tables) -> DataFrame:
    return temporal.restorations(views.observations(t)).drop("at")


@query(f"WITH {views.OBS}, {GAPS} SELECT entity_id, pos, source FROM rest WHERE source = 'api'")
def restorations_verified(t: Tables) -> DataFrame:
    return temporal.restorations(views.observations(t), verified=True).drop("at")


@query(f"WITH {views.OBS}, {GAPS} SELECT entity_id, count(*) AS n, epoch_us(max(ts)) // 1000 AS latest_ms FROM rest WHERE source = 'api' GROUP BY 1")
def restored_summary(t: Tables) -> DataFrame:
    own = temporal.restorations(views.observations(t), verified=True)
    return own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.unix_millis(F.max("at")).alias("latest_ms"))


ACTIVITY = """ev AS (SELECT * FROM obs WHERE status IS NOT NULL),
genuine AS (SELECT *, count(*) FILTER (status = 'deleted') OVER w AS gap, lag(status) OVER (PARTITION BY entity_id ORDER BY ts, pos) AS before FROM ev WHERE status <> 'public' OR source = 'api' WINDOW w AS (PARTITION BY entity_id ORDER BY ts, pos ROWS UNBOUNDED PRECEDING)),
states AS (SELECT *, last_value(CASE WHEN status <> 'public' OR source = 'api' THEN status END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM ev),
act AS (
  SELECT entity_id, pos, ts, 'new' AS type FROM (SELECT * FROM ev WHERE status = 'public' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts, pos) = 1)
  UNION ALL SELECT entity_id, pos, ts, 'deleted' FROM genuine WHERE status = 'deleted' AND (before IS NULL OR before <> 'deleted')
  UNION ALL SELECT entity_id, pos, ts, 'restored' FROM (SELECT * FROM genuine WHERE gap > 0 AND status = 'public' QUALIFY row_number() OVER (PARTITION BY entity_id, gap ORDER BY ts, pos) = 1)
  UNION ALL SELECT entity_id, pos, ts, 'restore-candidate' FROM states WHERE status = 'public' AND source = 'listing' AND state = 'deleted')"""
A = f"WITH {views.OBS}, {ACTIVITY} "


def _activity(t: Tables) -> DataFrame:
    return temporal.activity(views.observations(t))


@query(A + "SELECT entity_id, pos, type FROM act")
def activity_stream(t: Tables) -> DataFrame:
    return _activity(t).drop("at")


@query(A + ", x AS (SELECT *, max(CASE WHEN type = 'restore-candidate' THEN (ts, pos) END) OVER (PARTITION BY entity_id) AS c, max(CASE WHEN type IN ('deleted', 'restored') THEN (ts, pos) END) OVER (PARTITION BY entity_id) AS r FROM act) SELECT entity_id, pos, type FROM x WHERE type <> 'restore-candidate' OR ((ts, pos) = c AND (r IS NULL OR (ts, pos) > r))")
def activity_dedup(t: Tables) -> DataFrame:
    return temporal.activity_dedup(_activity(t)).drop("at")


@query(A + f"SELECT entity_id, CASE WHEN type IN ('deleted', 'restore-candidate') THEN 'deleted' WHEN type IN ('new', 'restored') THEN 'public' ELSE 'coverage-unknown' END AS status FROM (SELECT entity_id, arg_max(type, (ts, pos)) FILTER (ts <= {MID}) AS type FROM act GROUP BY 1)")
def status_as_of(t: Tables) -> DataFrame:
    return temporal.status_as_of(_activity(t), F.expr(MID))


@query(f"WITH {views.OBS}, f AS (SELECT entity_id, min(ts) AS first FROM obs GROUP BY 1) SELECT count(*) FILTER (first <= TIMESTAMP '2024-01-01 06:00:00') AS captured_by, count(*) FILTER (first > TIMESTAMP '2024-01-01 06:00:00') AS captured_after FROM f")
def captured_by(t: Tables) -> DataFrame:
    first = views.observations(t).groupBy("entity_id").agg(F.min("at").alias("first"))
    end = F.expr("TIMESTAMP '2024-01-01 06:00:00'")
    return first.agg(F.count_if(F.col("first") <= end).alias("captured_by"), F.count_if(F.col("first") > end).alias("captured_after"))


def _version(name: str, ts: str) -> str:
    return f'{name} AS (SELECT n.entity_id, n.path, coalesce(u.undo, n.k) AS k FROM known n LEFT JOIN (SELECT entity_id, path, arg_min("from", (ts, -pos)) AS undo FROM changes WHERE ts > {ts} GROUP BY 1, 2) u ON u.entity_id = n.entity_id AND u.path = n.path)'


@query(W + f", {_version('v', MID)} SELECT * FROM v")
def version_as_of(t: Tables) -> DataFrame:
    return temporal.version_as_of(_known(t), _changes(t), F.expr(MID))


@query(W + f", {_version('v', MID)}, {_version('w', LATE)} SELECT v.entity_id, v.path, v.k AS before, w.k AS after FROM v JOIN w ON v.entity_id = w.entity_id AND v.path = w.path WHERE v.k <> w.k")
def version_diff(t: Tables) -> DataFrame:
    known, change = _known(t), _changes(t)
    return temporal.version_diff(temporal.version_as_of(known, change, F.expr(MID)), temporal.version_as_of(known, change, F.expr(LATE)))


@query(W + "SELECT entity_id, epoch_us(ts) // 1000 AS at_ms FROM (SELECT DISTINCT entity_id, ts FROM changes) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) <= 20")
def version_choices(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    times = _changes(t).select("entity_id", "at").distinct()
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("at")))
    return times.withColumn("nth", nth).where("nth <= 20").select("entity_id", F.unix_millis("at").alias("at_ms"))


@query(f"WITH {views.OBS}, ok AS (SELECT entity_id, max((ts, pos)) AS ok FROM obs WHERE status = 'public' GROUP BY 1) SELECT o.entity_id, count(DISTINCT day) AS days FROM obs o LEFT JOIN ok ON ok.entity_id = o.entity_id WHERE status = 'deleted' AND (ok IS NULL OR (ts, pos) > ok) GROUP BY 1 HAVING count(DISTINCT day) >= 2")
def deletion_confirmed(t: Tables) -> DataFrame:
    return temporal.deletion_confirmed(views.observations(t))


@query(f"WITH {views.OBS} SELECT DISTINCT entity_id FROM obs WHERE entity_id NOT IN (SELECT entity_id FROM obs WHERE day = DATE '2024-01-30') AND entity_id NOT IN (SELECT entity_id FROM obs WHERE status = 'deleted' AND day > DATE '2024-01-25')")
def absent_from_pass(t: Tables) -> DataFrame:
    obs = views.observations(t)
    seen, queued = obs.where("day = '2024-01-30'"), obs.where("status = 'deleted' and day > '2024-01-25'")
    return obs.select("entity_id").distinct().join(seen, "entity_id", "left_anti").join(queued, "entity_id", "left_anti")


@query(f"WITH {views.OBS} SELECT entity_id, source, pos FROM obs QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY ts, pos) > 1")
def first_baseline(t: Tables) -> DataFrame:
    return temporal.first_baseline(views.observations(t), ("entity_id", "source")).select("entity_id", "source", "pos")


@query(f"WITH {views.OBS} SELECT entity_id, pos, count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n, n > 6 AS over FROM obs")
def rate_limit_24h(t: Tables) -> DataFrame:
    return temporal.sliding_limit(views.observations(t), 24, 6).select("entity_id", "pos", "n", "over")


COOLDOWN = """WITH RECURSIVE o AS (SELECT user_id AS entity_id, event_id AS pos, epoch_us(ts) AS t FROM events),
counted AS (
  SELECT entity_id, arg_min(pos, (t, pos)) AS pos, min(t) AS t FROM o GROUP BY entity_id
  UNION ALL
  SELECT o.entity_id, arg_min(o.pos, (o.t, o.pos)) AS pos, min(o.t) AS t FROM counted c JOIN o ON o.entity_id = c.entity_id AND o.t >= c.t + 1800000000 GROUP BY o.entity_id)
SELECT entity_id, pos FROM counted"""


@query(COOLDOWN)
def cooldown_30m(t: Tables) -> DataFrame:
    return temporal.cooldown(views.observations(t))


@query(f"WITH {views.OBS}, x AS (SELECT *, lag(k) OVER w AS bk, lag(source) OVER w AS bs FROM obs WHERE path = 'view' WINDOW w AS (PARTITION BY entity_id ORDER BY ts, pos)) SELECT DISTINCT entity_id FROM x WHERE bk IS NOT NULL AND bk <> k AND bs <> source")
def refresh_queue(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("at", "pos")
    own = views.observations(t).where("path = 'view'").withColumns({"bk": F.lag("k").over(w), "bs": F.lag("source").over(w)})
    return own.where("bk is not null and bk <> k and bs <> source").select("entity_id").distinct()
