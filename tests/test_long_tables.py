"""Work that must not grow faster than a table, or land on the driver."""

from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import structure as S


def test_lines_of_a_table_are_made_once(spark):
    """Before, the header was looked up in all lines anew for each row."""
    rows = "\n".join(f"| {i} | name |" for i in range(300))
    df = spark.createDataFrame([(f"| k | n |\n|---|---|\n{rows}",)], "md string").select(S.split_table(F.col("md"), 150).alias("parts"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1
    parts = df.first()["parts"]
    assert all(p.startswith("| k | n |\n|---|---|\n| ") for p in parts) and "\n".join(p.split("\n", 2)[2] for p in parts) == rows


def test_extracted_points_are_not_broadcast(spark):
    """Points and relations grow with the replies; Spark took their size for small and sent them through the driver before."""
    reply = '{"points":[{"id":"a","label":"x"},{"id":"b","label":"y"}],"relations":[{"source":"a","target":"b","type":"T","confidence":0.5},{"source":"a","target":"c","type":"T","confidence":0.5}]}'
    replies = spark.createDataFrame([("p1", ["1"], reply)], "pair_id string, chunk_ids array<string>, reply string")
    points, relations = G.parse_extraction(replies)
    assert [tuple(r) for r in relations.collect()] == [("p1_a", "p1_b", "T", 0.5)] and points.count() == 2
    assert "BroadcastExchange" not in relations._jdf.queryExecution().executedPlan().toString()
