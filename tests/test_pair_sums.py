"""Pairs summed up where they are made: all of them, and none of them dealt."""

from itertools import combinations

from docloom import plans
from docloom.operators import graph as G


def test_sums_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "SUM_BLOCK", 4)
    monkeypatch.setattr(G, "PAIRS_AT_ONCE", (3, 2))
    rows = [("d", f"s{i % 3}", i) for i in range(30)] + [("d", "s5", 7), ("e", "s", 1), ("e", "t", 2), ("e", None, 3), ("f", "s", 1), (None, "s", 1), (None, "t", 2), ("g", "s", None)]
    chunks = spark.createDataFrame(rows, "doc_id string, big string, chunk_id long")
    pairs = [(d, min(a, b), max(a, b)) for (d, s, a), (e, t, b) in combinations(rows, 2) if d and d == e and s and t and s != t and a != b]
    for keep, processed in ((lambda a, b: True, None), (lambda a, b: (a + b) % 3 != 0, lambda a, b: (a + b) % 3 == 0)):
        left = [p for p in pairs if keep(*p[1:])]
        want = sorted((d, sum(p[0] == d for p in left), sum(p[1] for p in left if p[0] == d), sum(p[2] for p in left if p[0] == d)) for d in {p[0] for p in left})
        assert sorted(map(tuple, G.pair_sums(chunks, processed).collect())) == want


def test_no_pair_is_dealt(spark, sf, monkeypatch):
    """Before, section_pairs joined row by row, and unprocessed_pairs shuffled all pairs twice."""

    def refused(*_):
        raise AssertionError("pairs were written out")

    for name in ("section_pairs", "unprocessed_pairs"):
        monkeypatch.setattr(G, name, refused)
        assert plans.QUERIES[name](spark, sf).count() > 0


def test_cross_section_pairs_of_all_sizes(spark, sf):
    """Before, only chunks of one size were paired."""
    part = [(r.p_brand, r.p_type) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = {b: n for b in {b for b, _ in part} if (n := sum(x[0] == y[0] == b and x[1] != y[1] for x, y in combinations(part, 2)))}
    assert {r["doc_id"]: r["n"] for r in plans.QUERIES["cross_section_only"](spark, sf).collect()} == want
