"""Evaluation and statistics tables: token counts, hit rates, accuracies, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_stats(chunks: DataFrame, by: str, tokens: str, salt: int = 64) -> DataFrame:
    """count, min, max, avg (2 digits), p50 and p90 by index: places n div 2 and int((n - 1) * 0.9) of the sorted values.

    Values are counted first, so a level of any size is a table of distinct values with running counts."""
    counts = chunks.groupBy(by, F.col(tokens).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(by))
    x = counts.withColumn("upto", upto).withColumn("n", n)
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    return x.groupBy(by).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 2).alias("mean"),
        pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.floor((F.col("n") - 1) * 0.9)).alias("p90"),
    )


def hit_at_k(gold: DataFrame, hits: DataFrame, by: str | None = None, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """gold (query_id, chunk_id), hits (query_id, chunk_id, rank): share of questions with any gold chunk in the first k, in percent."""
    best = gold.join(hits.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").groupBy("query_id", *([by] if by else [])).agg(F.min("rank").alias("best"))
    grouped = best.groupBy(by) if by else best.groupBy()
    shares = [F.round(100 * F.avg((F.coalesce(F.col("best") <= k, F.lit(False))).cast("double")), 2).alias(f"hit_at_{k}") for k in ks]
    return grouped.agg(F.count(F.lit(1)).alias("questions"), *shares)


def mapped_questions(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    known = evidence.select("query_id").distinct().withColumn("mapped", F.lit(True))
    return questions.select("query_id").join(known, "query_id", "left").select("query_id", F.coalesce("mapped", F.lit(False)).alias("mapped"))


def ablation_diff(gold: DataFrame, a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """Per question: found by a, by b; and what only one finds."""
    found = lambda h, n: gold.join(h.where(F.col("rank") <= k), ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn(n, F.lit(True))
    no = F.lit(False)
    x = gold.select("query_id").distinct().join(found(a, "a"), "query_id", "left").join(found(b, "b"), "query_id", "left").select("query_id", F.coalesce("a", no).alias("a"), F.coalesce("b", no).alias("b"))
    return x.agg(F.count_if("a").alias("hits_a"), F.count_if("b").alias("hits_b"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


def class_accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy in total (label null) and for each label."""
    right = F.round(F.avg((F.col(label) == F.col(predicted)).cast("double")), 6).alias("accuracy")
    return rows.rollup(label).agg(F.count(F.lit(1)).alias("n"), right)


def upstream_scoreboard(probes: DataFrame) -> DataFrame:
    """probes (name, ok, status, elapsed): 100 and up to 20 for speed if ok, 30 for a 403, 10 for a 404, else 0; ranked."""
    late = F.coalesce(F.col("elapsed"), F.lit(999.0))
    score = F.when(F.col("ok"), 100 + F.greatest(F.lit(0.0), 20 - 5 * late)).when(F.col("status") == 403, 30.0).when(F.col("status") == 404, 10.0).otherwise(0.0)
    return probes.withColumn("score", F.round(score, 2)).orderBy(F.desc("score"), "name")


def cache_counters(requests: DataFrame, kind: Column) -> DataFrame:
    """Requests, hits and misses; kind: exact, semantic, or null for a miss."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(kind.isNotNull()).alias("hits"), F.count_if(kind.isNull()).alias("misses"), F.count_if(kind == "exact").alias("exact"), F.count_if(kind == "semantic").alias("semantic")
    )


def missing_tags(templates: DataFrame, required: DataFrame) -> DataFrame:
    """templates (name, text), required (name, tag): tags that are absent, or opened and not closed."""
    j = required.join(templates, "name", "left")
    opened, closed = F.contains("text", F.concat(F.lit("<"), "tag", F.lit(">"))), F.contains("text", F.concat(F.lit("</"), "tag", F.lit(">")))
    return j.select("name", "tag", F.coalesce(~opened, F.lit(True)).alias("missing"), F.coalesce(opened & ~closed, F.lit(False)).alias("unclosed")).where("missing OR unclosed")
