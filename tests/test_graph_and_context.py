import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import context as K
from docloom.operators import evaluation as A
from docloom.operators import graph as G
from docloom.operators import lookup as L
from docloom.operators import retrieval as R


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_two_hop_chain(spark):
    rel = spark.createDataFrame([("sp2", "sp3", "CAUSES"), ("sp3", "sp4", "RESOLVED_BY")], "src string, dst string, rel_type string")
    paths = G.bfs_paths(spark.createDataFrame([(1, "sp2")], "query_id int, node string"), rel).withColumn("s", F.round(G.path_score(F.col("rel_type"), F.col("hops")), 4)).collect()
    assert sorted((r["dst"], r["hops"], r["s"]) for r in paths) == [("sp3", 1, 0.1425), ("sp4", 2, 0.1096)]
    grounded = spark.createDataFrame([("sp2", "c1"), ("sp3", "c2"), ("sp4", "c3"), ("sp1", "c1")], "point string, chunk_id string")
    seeds = spark.createDataFrame([(1, "c1", 1)], "query_id int, chunk_id string, rank int")
    got = {r["chunk_id"]: r["graph_score"] for r in G.point_expansion(seeds, grounded, rel).collect()}
    assert got == {"c2": 0.1425, "c3": 0.1096}
    assert {r["graph_score"] for r in G.point_expansion(seeds, grounded, rel, global_best=True).collect()} == {0.1425}


def test_expansion_takes_the_best_edge(spark):
    edges = spark.createDataFrame([("d", "a", "x", "SEMANTIC", 1.0), ("d", "b", "x", "CO_EVIDENCE", 0.5), ("d", "b", "a", "SEMANTIC", 1.0), ("d", "a", "y", "OTHER", 1.0), ("d", "b", "z", "CO_EVIDENCE", None)], "doc_id string, src string, dst string, edge_type string, weight double")
    seeds = spark.createDataFrame([(1, "a", 0.4), (1, "b", None)], "query_id int, chunk_id string, score double")
    got = {r["chunk_id"]: (round(r["graph_score"], 6), r["edge_type"], r["seed_chunk"]) for r in G.expand_hits(seeds, edges).collect()}
    assert got == {"x": (0.4, "SEMANTIC", "a"), "z": (0.25, "CO_EVIDENCE", "b")}


def test_extraction(spark):
    reply = json.dumps({"points": [{"id": "p1", "type": "Fault", "label": "E4", "description": "d"}, {"id": "p2", "type": "Fix", "label": "f", "description": ""}], "relations": [{"source": "p1", "target": "p2", "type": "RESOLVED_BY", "confidence": 0.9}, {"source": "p1", "target": "p9", "type": "CAUSES", "confidence": 1}]})
    points, rel = G.parse_extraction(spark.createDataFrame([("k", ["c1"], reply), ("bad", ["c2"], "{")], "pair_id string, chunk_ids array<string>, reply string"))
    assert {r["point"] for r in points.collect()} == {"k_p1", "k_p2"}
    assert [tuple(r) for r in rel.collect()] == [("k_p1", "k_p2", "RESOLVED_BY", 0.9)]
    assert G.drop_manual(spark.createDataFrame([("a",), ("b",)], "doc_id string"), "a").count() == 1


def test_expansion_by_questions_equals_the_written_links(spark):
    """A question of 300 chunks among small ones; classes count the links that the edges write out."""
    rng = random.Random(2)
    rows = [("d", 1, i) for i in range(300)] + [("d", q, rng.randrange(400)) for q in range(2, 80) for _ in range(4)] + [("e", 1, 900), ("e", 1, 901)]
    e = spark.createDataFrame(rows, "doc_id string, question_id int, chunk_id int")
    edges = G.co_evidence_edges(e)
    one = spark.createDataFrame([("d", 1, i) for i in range(6)], "doc_id string, question_id int, chunk_id int")
    assert G.co_evidence_edges(one).count() == G.co_evidence_classes(one).first()["n_links"] == 30
    frontier = spark.createDataFrame([(i,) for i in (0, 7, 250, 299, 350, 900, 999)], "src int")
    cols = ["src", "dst", "edge_type", "weight"]
    want = {tuple(r) for r in G.neighbours(frontier, edges).select(*cols).collect()}
    assert {tuple(r) for r in G.neighbours(frontier, edges.where("false"), evidence=e).select(*cols).collect()} == want and len(want) > 60


@pytest.mark.parametrize("most", [1, 7, 500])
def test_pairs_are_drawn_without_making_all(spark, most):
    rows = [("big", f"s{i % 5}", i) for i in range(40)] + [("one", "s", i) for i in range(5)] + [("none", None, 1)] + [("two", None, 1), ("two", "x", 2)]
    chunks = spark.createDataFrame(rows, "doc_id string, big string, chunk_id int")
    all_pairs = {(d, a, b) for d, s, a in rows for e, r, b in rows if d == e and a < b and s != r}
    got = [tuple(r) for r in G.pair_sample(chunks, most).collect()]
    assert len(got) == len(set(got)) == min(most, 640) + 1 and set(got) <= all_pairs
    assert sorted(got) == sorted(tuple(r) for r in G.pair_sample(chunks.repartition(5), most).collect())


def test_a_missing_rewritten_question_fails_its_check(spark):
    from docloom.operators import context as K

    turns = spark.createDataFrame([("d", 1, "short", None, ["指代消解"]), ("d", 2, "short", "who", ["指代消解"])], "dialogue string, turn int, answer string, rewritten string, checks array<string>")
    assert {r["turn"]: r["ok"] for r in K.dialogue_checks(turns).collect()} == {1: False, 2: True}


def test_interval_join_plan_and_rows(spark):
    import random

    rng = random.Random(4)
    spans = lambda n, w: [(rng.randrange(3), i, a, a + rng.randrange(w)) for i in range(n) for a in [rng.randrange(3000)]]
    ev, sp = spans(80, 900), spans(200, 300)
    got = L.evidence_to_chunks(spark.createDataFrame(ev, "doc_id int, ref_id int, start int, end int"), spark.createDataFrame(sp, "doc_id int, chunk_id int, start int, end int"), 128)
    want = {(d, i, j) for d, i, a, b in ev for e, j, c, f in sp if d == e and a <= f and c <= b}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as query_id", "id as chunk_id", "rand(1) as score")
    assert "WindowGroupLimit" in R.top_k(df, 5)._jdf.queryExecution().toString()


def test_fusion(spark):
    h = lambda *x: spark.createDataFrame(x, "query_id int, chunk_id string, rank int, score double")
    got = R.rrf_fuse({"dense": h((1, "a", 1, 0.9), (1, "b", 2, 0.8)), "bm25": h((1, "b", 1, 7.0), (1, "c", 2, 6.0))}, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert abs(got[0]["score"] - (0.65 / 62 + 0.35 / 61)) < 1e-12 and got[1]["bm25_rank"] is None
    other = R.rrf_fuse({"x": h((1, "a", 1, 1.0))}, 10).first()
    assert abs(other["score"] - 1 / 61) < 1e-12


def test_ann_recall(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = t.selectExpr("vec_id as chunk_id", "embedding as vector")
    q = v.where("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    exact = R.dense_topk(q, v, 10).select("query_id", "chunk_id")
    assert R.ann_topk(q, v, 10).select("query_id", "chunk_id").intersect(exact).count() >= 0.9 * exact.count()


def test_context_budget(spark):
    ev = spark.createDataFrame([(1, i, ("t" * 300, f"d{i}")) for i in range(1, 5)], "query_id int, rank int, item struct<text:string,doc:string>")
    for budget, items in ((60, 1), (40, 0), (200, 1), (600, 2), (5000, 4)):
        out = K.format_context(ev, budget).first()["context"]
        got = json.loads(out)["evidence"]
        assert len(got) == items and (len(out) <= budget or not items)
        if budget == 600:
            assert len(out) == 600 and got[-1]["text"].endswith("...") and got[0]["text"] == "t" * 300
    blocks = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y" * 20), (1, 3, "z")], "query_id int, rank int, block string")
    r = K.assemble_context(blocks, 10).first()
    assert r["shown"] == 1 and r["context"].startswith("x" * 50) and "仅展示前 1 个" in r["context"]


def test_small_tables(spark):
    tags = A.missing_tags(spark.createDataFrame([("a", "<x>..</x><y>")], "name string, text string"), spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")], "name string, tag string")).collect()
    assert sorted((r["name"], r["tag"], r["missing"], r["unclosed"]) for r in tags) == [("a", "y", False, True), ("a", "z", True, False), ("b", "x", True, False)]
    hits = spark.createDataFrame([(1, "c2", 2), (1, "c1", 1)], "query_id int, chunk_id string, rank int")
    rec = K.batch_records(spark.createDataFrame([(1,), (2,)], "query_id int"), hits, spark.createDataFrame([(1, "a", ["i"])], "query_id int, content string, images array<string>")).orderBy("query_id").collect()
    assert rec[0]["retrieved"] == ["c1", "c2"] and rec[0]["success"] and not rec[1]["success"] and rec[1]["retrieved"] == []


def test_dialogue_checks(spark):
    rows = [
        (1, "ok", "", ["路由到手册"], True), (2, "", "", ["检索到片段"], True), (3, "滤网要洗", "", ["不重复"], False), (4, "滤网要洗, 其他也要", "", ["不重复"], True), (5, "x" * 200 + "滤网", "", ["不重复"], True),
        (6, "短", "改写", ["指代消解"], True), (7, "短", "", ["消解"], False), (8, "长" * 51, "", ["指代"], True), (9, "PRESS it", "", ["按钮"], True), (10, "转动", "", ["模式"], False),
        (11, "can RETURN it", "", ["退货"], True), (12, "退款", "", ["通用问题"], False), (13, "y" * 21, "", ["其他检查"], True), (14, "y" * 20, "", ["别的"], False), (15, "按" + "y" * 20, "", ["按钮", "别的"], True), (16, "按", "", ["按钮", "别的"], False),
    ]
    d = spark.createDataFrame([(1, n, a, r, c) for n, a, r, c, _ in rows], "dialogue long, turn long, answer string, rewritten string, checks array<string>")
    assert [r["ok"] for r in K.dialogue_checks(d).orderBy("turn").collect()] == [ok for *_, ok in rows]
