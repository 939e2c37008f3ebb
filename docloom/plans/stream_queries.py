"""Queries of the streaming jobs: windowed measures as batches, stateful jobs run as streams over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.evaluation_queries import PAIR
from docloom.plans.fixtures import TURNS
from docloom.plans.registry import Tables, query
from docloom.store import new_folder
from docloom.streaming import requests as S


def stream(t: Tables, name: str) -> DataFrame:
    table = getattr(t, name)
    return t.spark.readStream.schema(table.schema).parquet(f"{t.folder}/{name}.parq*t")


def once(t: Tables, df: DataFrame) -> DataFrame:
    at = new_folder(t.spark, "streams")
    return S.run_once(df, f"{at}/checkpoint", f"{at}/out")


def _at():
    """Seconds since the epoch, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6")


SLIDES = "SELECT (floor(epoch(ts) / {0})::BIGINT - unnest(range(0, {1}))) * {0} AS window_start, * FROM events"


@query(f"SELECT window_start, round(count(*) / 300, 6) AS rate FROM ({SLIDES.format(15, 20)}) GROUP BY 1")
def request_rate_5m(t: Tables) -> DataFrame:
    return S.request_rate(t.events)


@query(f"SELECT window_start, round(count(*) FILTER (event_type = 'click') / greatest(count(*), 1e-4), 6) AS hit_rate FROM ({SLIDES.format(60, 5)}) GROUP BY 1")
def hit_rate_5m(t: Tables) -> DataFrame:
    return S.hit_rate(t.events, F.col("event_type") == "click")


@query(f"SELECT window_start, round(quantile_cont(value, 0.95), 6) AS p95 FROM ({SLIDES.format(60, 5)}) GROUP BY 1")
def latency_p95_5m(t: Tables) -> DataFrame:
    return S.latency_p95(t.events)


@query(
    f"""SELECT window_start, any_value(n) AS n, round(max(value) FILTER (k = ceil(0.95 * n)), 6) AS p95 FROM (SELECT window_start, value, count(*) OVER w AS n, row_number() OVER (w ORDER BY value) AS k FROM ({SLIDES.format(60, 5)}) WINDOW w AS (PARTITION BY window_start)) GROUP BY 1"""
)
def latency_sketch_5m(t: Tables) -> DataFrame:
    """The value of that rank, which sketches give exactly for windows of so few events."""
    return S.latency_sketches(t.events).select("window_start", "n", "p95")


@query("SELECT floor(epoch(ts) / 300)::BIGINT * 300 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_status_counts(t: Tables) -> DataFrame:
    return S.tumbling_counts(t.events)


@query(
    """WITH RECURSIVE r AS (SELECT event_id AS request_id, user_id || '|' || event_type AS key, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT request_id, key, n, tm AS entry, false AS hit FROM r WHERE n = 1 UNION ALL
      SELECT r.request_id, r.key, r.n, CASE WHEN r.tm - f.entry < 3600 THEN f.entry ELSE r.tm END, r.tm - f.entry < 3600 FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
    SELECT request_id, key, hit FROM f"""
)
def stream_cache_exact(t: Tables) -> DataFrame:
    e = stream(t, "events")
    return once(t, S.cache_exact(e.select(F.col("event_id").alias("request_id"), F.concat_ws("|", "user_id", "event_type").alias("key"), _at().alias("at"))))


@query(
    """SELECT request_id, entry_id, rank FROM (SELECT r.event_id AS request_id, e.event_id AS entry_id, row_number() OVER (PARTITION BY r.event_id ORDER BY e.ts DESC, e.event_id DESC) AS rank
    FROM events r JOIN events e ON e.event_type = r.event_type AND e.ts < r.ts AND e.event_id % 3 = 0) WHERE rank <= 5"""
)
def stream_recent_candidates(t: Tables) -> DataFrame:
    e = stream(t, "events")
    return once(t, S.recent_candidates(e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("model"), _at().alias("at"), (F.col("event_id") % 3 == 0).alias("is_entry"))))


@query(f"WITH {TURNS} SELECT conv_id, turn, count(*) OVER w AS n, string_agg({PAIR}, chr(10)) OVER w AS recent FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def stream_session_memory(t: Tables) -> DataFrame:
    """A turn stands in for a minute."""
    return once(t, S.session_memory(stream(t, "conversations").withColumn("at", (F.col("turn") + 1) * 60.0)))


@query(
    """WITH RECURSIVE p AS (SELECT 'up' || user_id % 10 AS upstream, epoch_us(ts) / 1e6 AS tm, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT upstream, n, bad::INT AS fails, -1e18::DOUBLE AS until, NULL::DOUBLE AS opened FROM p WHERE n = 1 UNION ALL
      SELECT p.upstream, p.n, CASE WHEN paused THEN f.fails WHEN opens OR NOT p.bad THEN 0 ELSE f.fails + 1 END, CASE WHEN opens THEN p.tm + 30 ELSE f.until END, CASE WHEN opens THEN p.tm END
      FROM f JOIN (SELECT * FROM p) p ON p.upstream = f.upstream AND p.n = f.n + 1, LATERAL (SELECT p.tm < f.until AS paused), LATERAL (SELECT NOT paused AND p.bad AND f.fails + 1 >= 3 AS opens))
    SELECT upstream, round(opened, 6) AS unhealthy_from, round(opened + 30, 6) AS unhealthy_to FROM f WHERE opened IS NOT NULL"""
)
def cooldown_windows(t: Tables) -> DataFrame:
    p = t.events.select(F.concat(F.lit("up"), F.col("user_id") % 10).alias("upstream"), _at().alias("at"), (F.col("event_type") == "error").alias("failed"), "event_id")
    return S.cooldown_windows(p).select("upstream", F.round("unhealthy_from", 6).alias("unhealthy_from"), F.round("unhealthy_to", 6).alias("unhealthy_to"))
