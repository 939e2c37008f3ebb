"""Windows of long sentences that begin or end at a line's end."""

import duckdb

from docloom import plans


def test_windows_keep_line_ends_as_the_sql_does(spark, tmp_path):
    """A sentence of 1,700 characters has line ends just where windows of 300 and of 800 characters end; these were taken off before."""
    text = "".join("\n" if i in (299, 300, 799, 1200) else " " if i % 7 == 3 else "x" for i in range(1700))
    spark.createDataFrame([(1, text), (2, "Short. Text"), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("chunk_text", "split_element"):
        got = {(r["doc_id"], r["part_no"], r["md5"]) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(con.sql(plans.SQL[name]).fetchall())
