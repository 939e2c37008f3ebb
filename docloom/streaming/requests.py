"""Streams of requests, messages and manual files.

Windowed measures take a batch or a stream alike. Stateful ones work per key in time order within what a
trigger brings; keys must reach the stream in order across triggers. State does not stay for ever: entries go with their time to live, models and conversations
when they have been idle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.lookup import CANDIDATES, KEPT, TTL_SECONDS
from docloom.store import stored

# Failures that make an upstream unhealthy, and seconds of its pause.
ALLOWED_FAILS, COOLDOWN_SECONDS = 3, 30
#: Size of a latency sketch.
SKETCH_K = 4000
#: Seconds after which the state of a model or a conversation without requests goes.
IDLE_SECONDS = 86_400
#: Rows that a key's fold hands on at once.
ROWS_AT_ONCE = 50_000


def windowed(events: DataFrame, measures: dict[str, Column], length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = x.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return g.select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', w.start)").alias("window_start"), *keys, *measures)


def request_rate(events: DataFrame) -> DataFrame:
    """Requests a second over the trailing five minutes, every 15 seconds."""
    return windowed(events, {"rate": F.round(F.count(F.lit(1)) / 300, 6)}, slide="15 seconds")


def hit_rate(events: DataFrame, hit: Column) -> DataFrame:
    return windowed(events, {"hit_rate": F.round(F.count_if(hit) / F.greatest(F.count(F.lit(1)).cast("double"), F.lit(1e-4)), 6)}, slide="1 minute")


def latency_sketches(events: DataFrame, latency: str = "value", k: int = SKETCH_K, late: str = "10 minutes") -> DataFrame:
    """(window_start, n, p95, sketch) over the trailing five minutes, every minute, on a batch and a stream alike: each event goes into one KLL sketch of its minute, and five
    of these are merged. Exact up to k events; beyond, the rank of p95 is off by some 2.3 / k ** 0.9, a twentieth of a percent at 4,000."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    minutes = x.groupBy(F.window("ts", "1 minute").alias("m")).agg(F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"), F.count(latency).alias("n"))
    merged = minutes.groupBy(F.window(F.window_time("m"), "5 minutes", "1 minute").alias("w")).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', w.start)").alias("window_start")
    return merged.select(start, "n", F.round(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95))), 6).alias("p95"), "sketch")


def latency_p95(events: DataFrame, latency: str = "value") -> DataFrame:
    """Exact on a batch, by merged sketches on a stream."""
    if events.isStreaming:
        return latency_sketches(events, latency).select("window_start", "p95")
    return windowed(events, {"p95": F.round(F.percentile(latency, 0.95), 6)}, slide="1 minute")


def tumbling_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    return windowed(events, {"n": F.count(F.lit(1))}, keys=(key,))


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _timed(df: DataFrame, late: str) -> DataFrame:
    """df with its column `at` (seconds) as event time too; what comes later than `late` is dropped."""
    return df.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)


def _expires(state: GroupState, at: float) -> None:
    """The state goes when the watermark has passed `at` (seconds), if nothing comes before."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def cache_exact(requests: DataFrame, ttl: float = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """requests (request_id, key, at in seconds): hit or miss; a miss writes the entry, a hit does not renew it. A key's entry leaves the state when the watermark
    has passed its end. Grouped state with timeouts: typed state with timers took some 18 ms a key in Python workers, in a trial of 100 keys."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["request_id", "key", "hit"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        entry = state.get[0] if state.exists else None
        out = []
        for r in _ordered(pdfs, ["at", "request_id"]).itertuples():
            hit = entry is not None and r.at - entry < ttl
            entry = entry if hit else r.at
            out.append((r.request_id, key[0], hit))
        if entry is not None:
            state.update((entry,))
            _expires(state, entry + ttl)
        yield pd.DataFrame(out, columns=columns)

    return _timed(requests, late).groupBy("key").applyInPandasWithState(step, "request_id long, key string, hit boolean", "entry double", "append", GroupStateTimeout.EventTimeTimeout)


def recent_candidates(requests: DataFrame, most: int = CANDIDATES, kept: int = KEPT, idle: float = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """requests (request_id, model, at, is_entry): the newest entries of the model before each request, from the newest `kept`. A model without requests
    for `idle` seconds is forgotten. Of a model's rows in a batch only three numbers each are held; what is found leaves by ROWS_AT_ONCE rows."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["request_id", "entry_id", "rank"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        ids, last, new = (list(state.get[0]), state.get[1], list(state.get[2])) if state.exists else ([], None, [])
        out: list[tuple[int, int, int]] = []
        x = _ordered((p[["request_id", "at", "is_entry"]] for p in pdfs), ["at", "request_id"])
        for r in x.itertuples():
            if last is None or r.at > last:
                ids, new, last = (ids + new)[-kept:], [], r.at
            out += [(r.request_id, e, i + 1) for i, e in enumerate(reversed(ids[-most:]))]
            if r.is_entry:
                new.append(r.request_id)
            if len(out) >= ROWS_AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if last is not None:
            state.update((ids, last, new))
            _expires(state, last + idle)
        yield pd.DataFrame(out, columns=columns)

    return _timed(requests, late).groupBy("model").applyInPandasWithState(step, "request_id long, entry_id long, rank long", "ids array<long>, last double, new array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def session_memory(messages: DataFrame, n: int = 3, idle: float = IDLE_SECONDS, late: str = "1 day") -> DataFrame:
    """messages (conv_id, turn, role, text, at in seconds): at each answered question, the transcript of the last n turns. A conversation is forgotten when it has had no
    message for `idle` seconds."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "turn", "n", "recent"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        turns, asked, asked_at, last = (list(state.get[0]), *state.get[1:]) if state.exists else ([], None, None, 0.0)
        out = []
        for r in _ordered(pdfs, ["turn"]).itertuples():
            if r.role == "assistant" and asked is not None:
                turns = [*turns, f"用户: {asked}\n客服: {r.text}"][-n:]
                out.append((key[0], asked_at, len(turns), "\n".join(turns)))
            asked, asked_at = (r.text, r.turn) if r.role == "user" else (None, None)
            last = max(last, r.at)
        state.update((turns, asked, asked_at, last))
        _expires(state, last + idle)
        yield pd.DataFrame(out, columns=columns)

    return _timed(messages, late).groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, n long, recent string", "turns array<string>, asked string, asked_at long, last double", "append", GroupStateTimeout.EventTimeTimeout)


def cooldowns(at: list[float], failed: list[bool], fails: int, until: float, allowed: int = ALLOWED_FAILS, pause: float = COOLDOWN_SECONDS) -> tuple[list[tuple[float, float]], int, float]:
    """Pauses (from, to) of one upstream; requests within a pause do not count."""
    out = []
    for t, bad in zip(at, failed, strict=True):
        if t < until:
            continue
        fails = fails + 1 if bad else 0
        if fails >= allowed:
            until, fails = t + pause, 0
            out.append((t, until))
    return out, fails, until


def cooldown_windows(probes: DataFrame) -> DataFrame:
    """probes (upstream, at, failed), a stream or a batch: unhealthy intervals."""
    shape = "upstream string, unhealthy_from double, unhealthy_to double"

    def rows(key, found) -> pd.DataFrame:
        return pd.DataFrame([(key[0], a, b) for a, b in found], columns=["upstream", "unhealthy_from", "unhealthy_to"])

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, until = state.get if state.exists else (0, float("-inf"))
        x = _ordered(pdfs, ["at"])
        found, fails, until = cooldowns(x["at"].tolist() if len(x) else [], x["failed"].tolist() if len(x) else [], fails, until)
        state.update((fails, until))
        yield rows(key, found)

    def whole(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at", kind="stable")
        return rows(key, cooldowns(x["at"].tolist(), x["failed"].tolist(), 0, float("-inf"))[0])

    g = probes.groupBy("upstream")
    return g.applyInPandasWithState(step, shape, "fails int, until double", "append", GroupStateTimeout.NoTimeout) if probes.isStreaming else g.applyInPandas(whole, shape)


def run_once(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into parquet, and reads the result."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def incremental_ingest(manuals: DataFrame, table: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], version: str, buckets: int = 64) -> None:
    """A stream of manuals (doc_id, md, <version>): chunks of each manual's newest version replace those of its doc_id in a parquet folder of
    `buckets` buckets of ids. Of equal versions in a batch the greater text stays; a later batch always replaces an earlier one. Only the buckets that
    a batch touches are written again."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("doc_id").agg(F.max(F.struct(version, "md")).alias("newest")).select("doc_id", "newest.*")
        new = chunk(last).withColumn("bucket", bucket)
        try:
            old = spark.read.schema(new.schema).parquet(table)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = spark.createDataFrame([], new.schema)
        ids = stored(last.select("doc_id"), "ingest_ids")
        kept = old.join(ids.select(bucket.alias("bucket")).distinct(), "bucket", "left_semi").join(ids, "doc_id", "left_anti").select(*new.columns)
        merged = stored(kept.unionByName(new), "ingest")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    manuals.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
