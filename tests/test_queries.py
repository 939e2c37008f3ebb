"""Registered queries against their SQL on the smallest tables, streams against batches, and the entry without the llm folders."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from docloom import plans
from docloom.operators.lookup import cache_entries
from docloom.plans.registry import Tables
from docloom.streaming import requests as S

HEAVY = {"mid_rollup", "big_rollup", "search_mid", "search_big", "search_small", "min_rerank_score", "recall_meta", "hybrid_topk", "dense_fallback", "hit_overlap", "new_chunks", "topk_per_query", "ordered_hits", "image_manifest", "hydrate_hits", "lift_to_parent", "expansion_effect", "degradation_report", "running_budget"}


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(set(plans.SQL) - HEAVY))
def test_query_equals_its_sql(spark, sf, sql, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = sql.execute(plans.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(float(x[names.index(c)]) if type(x[names.index(c)]).__name__ == "Decimal" else x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)
    assert got == want


def test_streamed_cache_equals_the_fold(spark, sf):
    t = Tables(spark, sf)
    e = t.events.selectExpr("event_id as request_id", "concat_ws('|', user_id, event_type) as key", "cast(ts as timestamp) as ts")
    batch = {(r["request_id"], r["hit"]) for r in cache_entries(e).collect()}
    assert batch == {(r["request_id"], r["hit"]) for r in plans.QUERIES["stream_cache_exact"](spark, sf).collect()}


def test_windows_of_a_stream_equal_those_of_a_batch(spark, sf):
    t = Tables(spark, sf)
    stream = spark.readStream.schema(t.events.schema).parquet(f"{sf}/events.parq*t")
    q = S.tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, S.tumbling_counts(t.events).collect()))


def test_cooldowns():
    found, fails, until = S.cooldowns([0, 1, 2, 3, 20, 40, 41, 42], [True] * 8, 0, -1.0)
    assert found == [(2, 32), (42, 72)] and fails == 0 and until == 72
    assert S.cooldowns([0, 1, 2, 3], [True, True, False, True], 0, -1.0)[0] == []


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", float(i), i % 5 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "upstream string, at double, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = S.run_once(S.cooldown_windows(s), str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.cooldown_windows(df).collect()))


def test_incremental_ingest(spark, tmp_path):
    """The newest version of a manual in a batch stays, and a later batch replaces it; other manuals of its bucket are kept."""
    schema = "doc_id string, md string, v long"
    chunk = lambda d: d.selectExpr("doc_id", "explode(split(md, ' ')) as w")
    for n, rows in enumerate(([("a", "old", 1), ("a", "x y", 2), ("b", "z", 1), ("a", "older", 0)], [("a", "q", 0)])):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").json(str(tmp_path / "in"))
        S.incremental_ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), chunk, "v", buckets=2)
        assert n or sorted(r["w"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["x", "y", "z"]
    assert sorted((r["doc_id"], r["w"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", "q"), ("b", "z")]


def test_the_entry_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'bm25_topk' in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_bounds_skip_postings_and_lose_no_hit(spark, sf):
    from docloom.operators import retrieval as R
    from docloom.plans.registry import Tables
    from docloom.plans.retrieval_queries import asked, index

    t = Tables(spark, sf)
    idx, queries = index(t), asked(t)
    hits = lambda df: {(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect()}
    for k in (1, 20, 10_000):
        assert hits(R.bm25_topk(queries, idx, k)) == hits(R.top_k(R.bm25_scores(queries, idx).where("score > 0"), k))
    read = R.bounded_terms(queries, idx, 20).groupBy("lead").agg({"df": "sum"}).collect()
    assert {r["lead"]: r["sum(df)"] for r in read}[True] < sum(r["sum(df)"] for r in read) / 2


def test_state_goes_after_its_time(spark, tmp_path):
    """Three triggers: many keys, one key after their time to live, and one more that comes after the watermark has moved; hits are those of one batch."""
    schema = "request_id long, key string, at double"
    base = 1_700_000_000.0
    parts = [[(i, f"k{i % 40}", base + i) for i in range(80)], [(100, "late", base + 9000.0)], [(101, "k1", base + 9001.0), (102, "late", base + 9002.0)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = S.cache_exact(source, 3600.0).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert held[-1] <= (40, 41, 2)[n] and (n < 2 or held[-1] == 2)
    got = {r["request_id"]: r["hit"] for r in spark.read.schema("request_id long, key string, hit boolean").parquet(str(tmp_path / "out")).collect()}
    assert got == {i: i >= 40 for i in range(80)} | {100: False, 101: False, 102: True}


def test_sketches_of_many_events_and_of_a_stream(spark, tmp_path):
    """60,000 latencies in one window: the rank is within the bound; a stream's windows are the batch's."""
    from pyspark.sql import functions as F

    many = spark.range(60_000).select(F.timestamp_seconds(1_700_000_040 + F.col("id") % 240).alias("ts"), ((F.col("id") * 7919) % 60_000).cast("double").alias("value"))
    got = S.latency_sketches(many).where("n = 60000").first()
    assert abs(got["p95"] / 60_000 - 0.95) < 0.005
    few = spark.range(500).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"), ((F.col("id") * 31) % 97).cast("double").alias("value"))
    few.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.range(1).select(F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"), F.lit(0.0).alias("value"))
    source = spark.readStream.schema(few.schema).parquet(str(tmp_path / "in"))
    for df in (None, late):
        if df is not None:
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = S.run_once(S.latency_sketches(source).select("window_start", "n", "p95"), str(tmp_path / "c"), str(tmp_path / "o"))
    want = {tuple(r) for r in S.latency_sketches(few).select("window_start", "n", "p95").collect()}
    assert {tuple(r) for r in out.collect() if r["window_start"] < 1_790_000_000} == want
