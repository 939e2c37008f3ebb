"""Chunking writes no table that is read once, and no text twice."""

from pyspark.sql import functions as F

from docloom.operators import structure as S


def test_text_is_written_once(spark, monkeypatch):
    """Before, each entry carried its text beside its equal markdown, and the entries of the only level were written."""
    wrote, write = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, tag: wrote.setdefault(tag, write(df, tag)))
    body = "# T\n\nOne two. Three.\n\n- a\n- b\n\n" + "Long words here. " * 300
    elements = S.element_table(S.line_table(spark.createDataFrame([(1, body)], "doc_id long, md string")))
    big = S.chunk_tables(elements, levels=("big",))["big"].orderBy("chunk_id").collect()
    assert set(wrote) == {"elements", "big_parts"}
    assert all(df.where("text = markdown").count() == 0 for df in wrote.values())
    files = wrote["elements"].inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    whole = {r["chunk_id"]: r["text"] for r in S.chunk_tables(elements)["big"].collect()}
    assert {r["chunk_id"]: r["text"] for r in big} == whole and "One two. Three." in big[0]["text"] and big[0]["text"].startswith("T\n\n")
    assert not elements.where(F.col("text").isNull()).count()
