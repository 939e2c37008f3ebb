"""Queries of sources and sinks: the given tables written in each format to the shared folder, and read back."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.plans.registry import Tables, query
from docloom.plans.stream_queries import stream
from docloom.sources import files as I
from docloom.store import new_folder, spread
from docloom.streaming import requests as S


def files_of(t: Tables, rows: DataFrame, ending: str) -> str:
    """A folder with a file for each row of rows (name, text), written by the tasks; each file ends with a line end, and is there whole or not at all."""
    jvm = t.spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{new_folder(t.spark, 'files')}/files")
    fs = at.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    folder = fs.makeQualified(at).toString()
    uri = re.sub("^file:/+", "file:///", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(uri)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(f"{text or ''}\n".encode())
                files.move(part, f"{root}/{name}{ending}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    spread(rows.select("name", "text")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


@query(
    """SELECT 'Manual_' || doc_id || '_' || substr(md5('Manual_' || doc_id), 1, 12) AS doc_id, 'Manual_' || doc_id AS doc_name, 'Manual_' || doc_id || '.md' AS file, md5(text || chr(10)) AS md5
    FROM documents WHERE doc_id <> 3"""
)
def read_manuals(t: Tables) -> DataFrame:
    """Every document but one as a Markdown file."""
    folder = files_of(t, t.documents.select(F.concat(F.lit("Manual_"), "doc_id").alias("name"), "text"), ".md")
    return I.read_manuals(t.spark, folder, ["Manual_3.md"]).select("doc_id", "doc_name", X.path_name(F.col("source_path")).alias("file"), F.md5("text").alias("md5"))


@query("SELECT doc_id, lang, n_chars, md5(text) AS md5 FROM documents")
def read_jsonl(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "jsonl")
    t.documents.write.json(path)
    missing = I.read_jsonl(t.spark, f"{path}-missing", "doc_id long, lang string, n_chars long, text string")
    return I.read_jsonl(t.spark, path, "doc_id long, lang string, n_chars long, text string").unionByName(missing).select("doc_id", "lang", "n_chars", F.md5("text").alias("md5"))


@query("SELECT 'c' || doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS content_hash FROM documents")
def load_chunk_tables(t: Tables) -> DataFrame:
    """Two chunk files that share a third of their ids, and a path that is not there; the later file's rows stay."""
    base = new_folder(t.spark, "chunks")
    d = t.documents.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "text", "doc_id")
    d.select("chunk_id", "text", F.md5("text").alias("content_hash")).write.json(f"{base}/first")
    d.where("doc_id % 3 = 0").select("chunk_id", "text", F.md5(F.concat("text", F.lit("!"))).alias("content_hash")).write.json(f"{base}/second")
    return I.load_chunk_tables(t.spark, [f"{base}/first", f"{base}/none", f"{base}/second"]).select("chunk_id", "content_hash")


@query("SELECT p_brand AS doc_id, p_partkey AS chunk_id, CASE WHEN p_brand < 'Brand#2' THEN 'new' ELSE 'old' END AS version FROM part WHERE p_brand >= 'Brand#2' OR p_size > 10")
def write_chunks(t: Tables) -> DataFrame:
    """Chunks of all brands, of which some are then replaced."""
    path = new_folder(t.spark, "chunks")
    chunks = t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("chunk_id"), F.lit("old").alias("version"), "p_size")
    I.write_chunks(chunks.drop("p_size"), path)
    I.write_chunks(chunks.where("doc_id < 'Brand#2' AND p_size > 10").withColumn("version", F.lit("new")).drop("p_size"), path, "overwrite")
    return t.spark.read.parquet(path)


@query("SELECT p_brand AS doc_id, p_partkey AS chunk_id FROM part WHERE p_size <= 25 UNION ALL SELECT p_brand, -p_partkey FROM part WHERE p_size <= 25")
def write_mode(t: Tables) -> DataFrame:
    """A rebuild takes the place of all that was there, and an append adds to it."""
    path = new_folder(t.spark, "chunks")
    chunks = t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("chunk_id"), "p_size")
    some = chunks.where("p_size <= 25").drop("p_size")
    I.write_chunks(chunks.drop("p_size"), path)
    I.write_chunks(some, path, "rebuild")
    I.write_chunks(some.withColumn("chunk_id", -F.col("chunk_id")), path, "append")
    return t.spark.read.parquet(path)


@query(
    """SELECT 'q' || item_id AS question_id, ref_no::BIGINT AS ref_no, file, (item_id + a)::BIGINT AS start_line, (item_id + b)::BIGINT AS end_line, md5(text) AS md5
    FROM benchmark, (VALUES (0, 'a/b.md', 0, 2), (1, 'c.md', 10, 10), (2, 'd.md', 20, 20), (2, 'd.md', 24, 24)) v(ref_no, file, a, b)"""
)
def read_qa_records(t: Tables) -> DataFrame:
    """Every benchmark item as a file with references of three shapes."""
    n = F.col("item_id")
    as_json = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)
    refs = F.concat(F.lit('["a/b.md:'), n, F.lit("-"), n + 2, F.lit('",{"file":"c.md","lines":"'), n + 10, F.lit('"},{"source":"d.md","lines":['), n + 20, F.lit(","), n + 24, F.lit("]}]"))
    body = F.concat(F.lit('{"id":"q'), n, F.lit('","question":"?","content":'), as_json, F.lit(',"status":"done","images":[],"evidence_refs":'), refs, F.lit("}"))
    records, found = I.read_qa_records(t.spark, files_of(t, t.benchmark.select(F.concat(F.lit("q"), "item_id").alias("name"), body.alias("text")), ".json"))
    return found.join(records, "question_id").select("question_id", "file", F.md5("content").alias("md5"), *[F.col(c).cast("long").alias(c) for c in ("ref_no", "start_line", "end_line")])


@query("SELECT item_id, md5(text || ' \"x\", y') AS md5 FROM benchmark")
def read_question_csv(t: Tables) -> DataFrame:
    """Questions with quotes, commas and line ends in CSV under a header with a byte-order mark."""
    path = new_folder(t.spark, "csv")
    rows = t.benchmark.select(F.col("item_id").alias("﻿item_id"), F.concat("text", F.lit(' "x", y')).alias(" raw "))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = I.read_question_csv(t.spark, path)
    return got.select(F.col("item_id").cast("long").alias("item_id"), F.md5("raw").alias("md5"))


@query("SELECT '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source UNION ALL SELECT * FROM (VALUES ('# Build'), ('| source | n |'), ('| --- | --- |'))")
def write_reports(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "reports")
    I.write_reports(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), folder, "Build")
    return t.spark.read.text(f"{folder}/report").where("value <> ''").withColumnRenamed("value", "line")


@query("SELECT doc_id, k::BIGINT AS line_no, md5(l) AS md5, version FROM (SELECT *, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS l FROM (SELECT doc_id, string_split(text || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END, chr(10)) AS ls, doc_id % 2 AS version FROM documents))")
def incremental_ingest(t: Tables) -> DataFrame:
    """A stream of manuals in which every second one comes twice: the lines of the newer version are there."""
    base = new_folder(t.spark, "ingest")
    d = stream(t, "documents").select("doc_id", F.col("text").alias("md"))
    twice = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))
    versions = d.select("doc_id", "md", F.explode(twice).alias("v")).select("doc_id", F.when(F.col("v") == 2, F.concat("md", F.lit("!"))).otherwise(F.col("md")).alias("md"), F.col("v").alias("version"))
    lines = lambda b: b.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "line"), (F.col("doc_id") % 2).alias("version"))
    S.incremental_ingest(versions, f"{base}/table", f"{base}/checkpoint", lines, "version")
    return t.spark.read.parquet(f"{base}/table").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("md5"), "version")
