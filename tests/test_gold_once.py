"""Queries that need the gold evidence twice find it once."""

from docloom.operators import lookup as L
from docloom.plans import evaluation_queries as Q
from docloom.plans.registry import Tables


def test_passages_are_searched_once(spark, sf, monkeypatch):
    """Before, expansion_effect searched all texts for all passages twice."""
    calls, real = [], L.passages_in
    monkeypatch.setattr(L, "passages_in", lambda *a: calls.append(1) or real(*a))
    got = Q.expansion_effect(Tables(spark, sf)).first()
    n = Q.new_chunks(Tables(spark, sf)).groupBy("query_id").count().collect()
    asked = Q.gold(Tables(spark, sf)).select("query_id").distinct().count()
    assert len(calls) == 1 + 2
    assert got["share_gaining"] == round(len(n) / asked, 6) and got["mean_gain"] == round(sum(r["count"] for r in n) / asked, 6)
