from pyspark.sql import functions as F

from docloom.functions import text as X


def one(spark, *cols, data=None):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_normalize_and_ids(spark):
    r = one(spark, X.normalize_text(F.lit("﻿　 a \t b\n\n\n\nc 　")), X.safe_id(F.lit("  Air-Fryer 手册 ")), X.safe_id(F.lit("9 lives"), "doc"), X.truncate_ellipsis(F.lit("abcdef   xyz"), 10), X.truncate_ellipsis(F.lit("abcdef"), 2))
    assert r["c0"] == "a b\n\nc"
    assert r["c1"].startswith("Air_Fryer_") and len(r["c1"].rsplit("_", 1)[1]) == 12
    assert r["c2"].startswith("doc_") and r["c3"] == "abcdef..." and r["c4"] == "..."


def test_tokens_and_windows(spark):
    r = one(spark, X.approx_tokens(F.lit("")), X.approx_tokens(F.lit("a")), X.markdown_tokens(F.lit("ab ![x](a/b.png)")), X.overlap_windows(F.lit("abcdefghij"), 2, 1), X.overlap_windows(F.lit("  "), 2), X.image_refs(F.lit("![a](p/x.png) ![b]( q/x.png ) ![c](y.jpg)")))
    assert (r["c0"], r["c1"], r["c2"]) == (0, 1, 8 + 256)
    assert r["c3"] == ["abcd", "cdef", "efgh", "ghij"] and r["c4"] == [] and r["c5"] == ["x.png", "y.jpg"]


def test_sentences_and_ranges(spark):
    r = one(spark, X.split_sentences(F.lit("One. Two!  三。 four;five")), X.line_ranges(F.lit("[3, 5–7，9～12, x]")), X.line_ranges(F.lit("")))
    assert r["c0"] == ["One.", "Two!", "三。", "four;five"]
    assert [tuple(x) for x in r["c1"]] == [(3, 3), (5, 7), (9, 12)] and r["c2"] == []


def test_json_of_replies(spark):
    get = lambda s: F.to_json(X.extract_json(F.lit(s)))
    r = one(spark, get('```json\n{"a": 1}\n```'), get('Sure: {"a": {"b": 2}} done'), get("none"))
    assert r["c0"] == '{"a":1}' and r["c1"] == '{"a":{"b":2}}' and r["c2"] is None


def test_markers(spark):
    allowed = F.array(F.lit("Manual24_0.png"), F.lit("Manual24_1"))
    r = one(spark, X.repair_image_markers(F.lit("Press [图片:Manual24_0] now , then （图：Manual24_1.jpg）. Not [图片: Other_3]"), allowed))
    assert r["c0"] == "Press <PIC> now, then <PIC>. Not"


def test_pics(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    r = one(spark, X.align_pics(F.lit("a<PIC>b<PIC><PIC>c"), arr("x", "y", "z")), X.align_pics(F.lit("a<PIC>b<PIC>"), arr("x", "x")), X.align_pics(F.lit("a<PIC>"), arr("x", "y")), X.align_pics(F.lit("<PIC>"), arr("x")))
    assert tuple(r["c0"]) == ("a<PIC>b<PIC>c", ["x", "y"])
    assert tuple(r["c1"]) == ("a<PIC>b", ["x"]) and tuple(r["c2"]) == ("a<PIC>", ["x", "y"]) and tuple(r["c3"]) == ("", [])


def test_image_urls(spark):
    good = "data:image/png;base64,aGVsbG8="
    r = one(spark, X.image_url_ok(F.lit(good)), X.image_url_ok(F.lit(good), 3), X.image_url_ok(F.lit("data:image/gif;base64,aGVsbG8=")), X.render_answer(F.lit("a <PIC> b"), F.array(F.lit("i1"))))
    assert (r["c0"], r["c1"], r["c2"]) == (True, False, False) and r["c3"] == "a [i1] b"


def test_tokenize(spark):
    from docloom.operators.retrieval import multimodal_vector, tokenize

    r = one(spark, tokenize(F.lit(" E4 错误码 ")), tokenize(F.lit("!! ??")), tokenize(F.lit("  ")), tokenize(F.lit("A b"), words=F.array(F.lit("w"))), multimodal_vector(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.array(F.lit(3.0), F.lit(5.0)))))
    assert r["c0"] == ["e4", "错", "误", "码", "错误", "误码", "错误码"]
    assert r["c1"] == ["!! ??"] and r["c2"] == [] and r["c3"] == ["a", "b", "w"] and r["c4"] == [2.0, 4.0]
