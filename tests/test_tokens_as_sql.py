"""Texts without words: the queries' tokens are those of their SQL, the library's those of the reference."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import plans
from docloom.operators import retrieval as R

TEXTS = ["", " ", "\t\n ", "É.", "ll bb", "... ---", "é\n\nè", "\xa0é\xa0è ", "\x0bé", "İ", "ΑΣ", "One two", "水火 water"[3:], "　", None]


@pytest.mark.parametrize("name", ["tokenize5", "tokenize_han", "bm25_index"])
def test_texts_without_words(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    want = c.execute(plans.SQL[name]).fetchall()
    assert sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_blank_text_has_no_tokens_in_the_library(spark):
    rows = spark.createDataFrame([("",), (" \xa0",), ("É \xa0È",), ("a",)], "t string").select(R.tokenize(F.col("t"))).collect()
    assert [r[0] for r in rows] == [[], [], ["é è"], ["a"]]
