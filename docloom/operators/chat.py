"""Conversations as tables: turns, histories, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import format_turns

# Turns of a window, and from how many turns on a summary is due.
WINDOW, TRIGGER = 5, 10


def pair_turns(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A user's message and the assistant's that follows it directly."""
    w = Window.partitionBy(key).orderBy(order)
    x = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return x.where("role = 'user' AND next_role = 'assistant'").select(key, order, F.col("text").alias("user_message"), F.col("next_text").alias("assistant_message"))


def sliding_turns(turns: DataFrame, n: int = WINDOW, before_only: bool = False, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each turn with the array of the last n, with itself or before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1) if before_only else Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return turns.withColumn("recent", F.collect_list(F.struct(F.col("user_message").alias("user"), F.col("assistant_message").alias("assistant"))).over(w))


def history_context(sessions: DataFrame, turns: DataFrame, summaries: DataFrame, strategy: str = "sliding_summary", n: int = WINDOW, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, context, turns_used, summary_used) of every session; one without turns has an empty context."""
    if strategy not in ("sliding_window", "summary", "sliding_summary"):
        raise ValueError(f"unknown memory strategy: {strategy}")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    keep = 1 if strategy == "summary" else n
    last = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)
    pair = F.struct(F.col(order).alias("o"), F.col("user_message").alias("user"), F.col("assistant_message").alias("assistant"))
    g = last.groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("recent"))
    x = sessions.select(key).distinct().join(g, key, "left").join(summaries.select(key, "summary"), key, "left")
    some, has = F.coalesce(F.size("recent"), F.lit(0)) > 0, F.coalesce(F.col("summary") != "", F.lit(False)) & F.lit(strategy != "sliding_window")
    text = format_turns(F.col("recent"))
    # The headings of a history.
    head = {"sliding_window": F.lit(""), "summary": F.lit("最近一轮:\n"), "sliding_summary": F.format_string("最近 %d 轮对话:\n", F.size("recent"))}[strategy]
    body = F.concat_ws("\n\n", F.when(has, F.concat(F.lit("历史摘要: "), "summary")), F.concat(head, text))
    return x.select(key, F.when(some, body).otherwise("").alias("context"), F.when(some, F.size("recent")).otherwise(0).cast("long").alias("turns_used"), (some & has).alias("summary_used"))


def summary_due(turns: DataFrame, old: DataFrame, new: DataFrame, trigger: int = TRIGGER, key: str = "conv_id") -> DataFrame:
    """(key, due, summary): sessions of `trigger` turns or more take the new summary if there is one; all others keep the old."""
    n = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    x = n.join(old.select(key, F.col("summary").alias("old")), key, "left").join(new.select(key, F.col("summary").alias("new")), key, "left")
    due = F.col("n") >= trigger
    return x.select(key, due.alias("due"), F.when(due, F.coalesce(F.nullif("new", F.lit("")), "old")).otherwise(F.col("old")).alias("summary"))


def standalone_query(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """queries (query_id, text, history): the rewritten text, or the original where the history is empty or the rewrite blank."""
    r = rewrites.select("query_id", F.col("text").alias("rewritten"))
    use = (F.col("history") != "") & (F.trim(F.coalesce("rewritten", F.lit(""))) != "")
    return queries.join(r, "query_id", "left").select("query_id", F.when(use, F.trim("rewritten")).otherwise(F.col("text")).alias("standalone"))


def reset_session(turns: DataFrame, key_value, key: str = "conv_id") -> DataFrame:
    return turns.where(~F.col(key).eqNullSafe(F.lit(key_value)))
