import json

from pyspark.sql import functions as F

from docloom.functions import hooks as H
from docloom.sources import files as I


def test_manuals(spark, tmp_path):
    (tmp_path / "Bosch Oven.md").write_text("# A\ntext\n")
    (tmp_path / "skip.md").write_text("no")
    (tmp_path / "note.txt").write_text("no")
    got = I.read_manuals(spark, str(tmp_path), ["skip.md"]).collect()
    assert [(r["doc_name"], r["text"]) for r in got] == [("Bosch Oven", "# A\ntext\n")] and got[0]["doc_id"].startswith("Bosch_Oven_")


def test_jsonl_and_chunk_tables(spark, tmp_path):
    assert I.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    for n, text in (("a", "old"), ("b", "new")):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"chunk_id": "c", "text": text}) + "\n\n" + json.dumps({"chunk_id": n, "text": n}) + "\n")
    got = I.load_chunk_tables(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"), str(tmp_path / "gone.jsonl")])
    assert {r["chunk_id"]: r["text"] for r in got.collect()} == {"c": "new", "a": "a", "b": "b"}


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *x: spark.createDataFrame(x, "doc_id string, chunk_id string")
    I.write_chunks(rows(("a", "1"), ("b", "2")), path)
    I.write_chunks(rows(("a", "3")), path, "overwrite")
    assert sorted((r["doc_id"], r["chunk_id"]) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("b", "2")]
    I.write_chunks(rows(("c", "4")), path, "rebuild")
    assert spark.read.parquet(path).count() == 1


def test_qa_records(spark, tmp_path):
    q = {"id": 7, "question": "q", "content": "c", "status": "done", "images": ["i"], "evidence_refs": ["a/b.md:3-5", {"file": "c.md", "lines": "7"}, {"source": "d.md", "lines": [72, 76]}, {"file": "e.md", "lines": None}]}
    (tmp_path / "7.json").write_text(json.dumps(q))
    (tmp_path / "bad.json").write_text("{")
    records, refs = I.read_qa_records(spark, str(tmp_path))
    assert [tuple(r) for r in records.collect()] == [("7", "q", "c", "done", ["i"])]
    assert sorted((r["ref_no"], r["file"], r["start_line"], r["end_line"]) for r in refs.where("start_line is not null").collect()) == [(0, "a/b.md", 3, 5), (1, "c.md", 7, 7), (2, "d.md", 72, 72), (2, "d.md", 76, 76)]
    assert refs.where("file = 'e.md'").count() == 1
    legacy = I.read_qa_records(spark, str(tmp_path), legacy=True)[1].where("start_line is not null").collect()
    assert sorted((r["file"], r["start_line"]) for r in legacy) == [("c.md", 7), ("d.md", 72)]


def test_question_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿id,raw\n1,"a ""b"", c"\n', encoding="utf-8")
    got = I.read_question_csv(spark, str(tmp_path / "q.csv"))
    assert got.columns == ["id", "raw"] and got.first()["raw"] == 'a "b", c'


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(x, "user_id string, session_id string, version long, summary string")
    I.save_sessions(rows(("u", "s", 1, "a"), ("v", "t", 1, "b")), path)
    I.save_sessions(rows(("u", "s", 2, "c")), path)
    assert [r["summary"] for r in I.load_sessions(spark, path, "u").collect()] == ["c"] and I.load_sessions(spark, path).count() == 2


def test_reports_and_answers(spark, tmp_path):
    stats = spark.createDataFrame([("m1", 3), ("m2", None)], "manual string, n long")
    I.write_reports(stats, str(tmp_path), "Build")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part*")))
    assert text.startswith("# Build\n\n| manual | n |\n| --- | --- |") or "| m1 | 3 |" in text
    a = spark.createDataFrame([(1, 'say "hi"', ["x", "y"]), (2, "b", None)], "id long, content string, images array<string>")
    got = a.select(I.answer_ret(F.col("content"), F.col("images")).alias("r")).collect()
    assert [r["r"] for r in got] == ['"say \\"hi\\"",["x","y"]', '"b",[]']
    I.export_answers(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/jsonl")).count() == 2


def test_hooks(spark):
    df = spark.createDataFrame([(1, "Ab cd"), (2, None)], "id long, text string").coalesce(1)
    counted = df.select(H.token_counter(lambda ts: [len(t) for t in ts])(F.col("text")).alias("n"), H.word_segmenter(str.split)(F.col("text")).alias("w")).collect()
    assert [r["n"] for r in counted] == [5, 0] and counted[0]["w"] == ["ab", "cd"]
    good = H.embedder(lambda rows: [[float(r["id"])] for r in rows])(df).collect()
    assert [(r["vector"], r["attempts"], r["error"]) for r in good] == [([1.0], 1, None), ([2.0], 1, None)]

    def fails(rows):
        raise OSError("down")

    bad = H.rerank_scorer(fails)(df).collect()
    assert all(r["rerank_score"] is None and r["attempts"] == 3 and "down" in r["error"] for r in bad)
    H.register(spark)
    got = spark.sql("SELECT * FROM chunk_text('One two. Three four. Five.', 6)").collect()
    assert [(r["piece_no"], r["piece"]) for r in got] == [(0, "One two."), (1, "Three four."), (2, "Five.")]


def test_a_workspace_removes_what_was_written_in_it(spark):
    import os

    from docloom.store import new_folder, stored, workspace

    with workspace(spark) as root:
        assert stored(spark.range(3), "t").count() == 3 and new_folder(spark, "x").startswith(root)
        with workspace(spark) as inner:
            stored(spark.range(2), "u")
            there = inner.removeprefix("file://")
            assert os.path.isdir(there)
        assert not os.path.exists(there) and new_folder(spark, "x").startswith(root)
        assert os.path.isdir(root.removeprefix("file://"))
    assert not os.path.exists(root.removeprefix("file://")) and not new_folder(spark, "x").startswith(root)


def test_a_named_index_is_read_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from docloom.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"word{i % 7} and term{i % 3} here") for i in range(50)], "chunk_id long, text string")
    made = R.bm25_index(docs, R.tokenize(F.col("text")))
    R.save_bm25(made, str(tmp_path / "index"))
    asked = docs.limit(5).select(F.col("chunk_id").alias("query_id"), R.tokenize(F.col("text")).alias("tokens"))
    hits = lambda i: sorted(map(tuple, R.bm25_topk(asked, i, 3).select("query_id", "chunk_id", "rank", F.round("score", 9)).collect()))
    assert hits(R.read_bm25(spark, str(tmp_path / "index"))) == hits(made)
