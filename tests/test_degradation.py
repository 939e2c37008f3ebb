"""Every fault of the report is tried on the same queries."""

import os

import duckdb

from docloom import plans


def test_all_faults_are_reported_as_in_sql(spark, sf):
    """Before, sparse hits and a cut of them were all that was counted."""
    got = sorted(map(tuple, plans.QUERIES["degradation_report"](spark, sf).select("scenario", "queries", "hits", "same_top3", "ok").collect()))
    assert {r[0] for r in got} == {"normal", "dense_failure", "rerank_failure", "both_failure", "context_2000", "context_5000", "context_10000"}
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    assert got == sorted(c.execute(plans.SQL["degradation_report"]).fetchall())
