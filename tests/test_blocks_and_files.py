"""Pairs by blocks of chunks, files written by tasks, and folds that hand on their rows in parts."""

from itertools import combinations

from docloom.operators import graph as G
from docloom.plans import source_queries as Q
from docloom.plans.registry import Tables
from docloom.streaming import requests as S


def test_section_pairs_by_blocks_are_all_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 4)
    rows = [("d", f"s{i % 3}", i) for i in range(30)] + [("e", "s", 1), ("e", "t", 2), ("e", None, 3), ("f", "s", 1)]
    pairs = G.section_pairs(spark.createDataFrame(rows, "doc_id string, big string, chunk_id long"))
    want = sorted((d, a, b) for (d, s, a), (e, t, b) in combinations(rows, 2) if d == e and s and t and s != t)
    assert sorted(map(tuple, pairs.collect())) == want
    assert pairs.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism  # not as few as the bytes ask for


def test_files_are_written_by_tasks(spark, sf):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", None)], "name string, text string")
    folder = Q.files_of(Tables(spark, sf), rows, ".md")
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()}
    assert got == {"a.md": b"x\ny\n", "b.md": b"\n"}


def test_candidates_leave_in_parts(monkeypatch):
    import pandas as pd

    seen = {}

    class State:
        exists, hasTimedOut = False, False

        def update(self, value):
            seen["state"] = value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            seen["until"] = at

    class Frame:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            return step

    monkeypatch.setattr(S, "_timed", lambda df, late: Frame())
    monkeypatch.setattr(S, "ROWS_AT_ONCE", 100)
    step = S.recent_candidates(None)
    n = 200
    x = pd.DataFrame({"request_id": range(n), "model": "m", "at": [float(i) for i in range(n)], "is_entry": True})
    parts = list(step(("m",), iter([x[100:], x[:100]]), State()))
    assert len(parts) > 5 and max(map(len, parts)) < 200
    whole = pd.concat(parts)
    assert whole[whole.request_id == 150].entry_id.tolist() == [149 - i for i in range(S.CANDIDATES)] and seen["until"] > 0
