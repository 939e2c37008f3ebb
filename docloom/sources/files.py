"""Reading and writing of manuals, chunk tables, question records, sessions, reports and answers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

CHUNK_SCHEMA = "chunk_id string, chunk_type string, doc_id string, doc_name string, big_chunk_id string, mid_chunk_id string, section_title string, header_path array<string>, text string, markdown string, retrieval_text string, token_count long, image_paths array<string>, content_hash string"
LANGUAGES = ("zh", "en")


def read_manuals(spark: SparkSession, folder: str, excluded: list[str] | None = None) -> DataFrame:
    """Markdown files but the excluded names: doc_id, doc_name, source_path, text."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file_name"))
    name = X.path_stem(F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))))
    kept = raw if not excluded else raw.where(~F.col("file_name").isin(*excluded))
    return kept.select(X.safe_id(name, "doc").alias("doc_id"), name.alias("doc_name"), "source_path", F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, and a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def load_chunk_tables(spark: SparkSession, paths: list[str], schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Chunks of several manuals, in one scan; of an id that comes twice the last path's row stays. Missing paths are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    if not there:
        return spark.createDataFrame([], schema)
    bare = lambda p: re.sub(r"^[a-z0-9]+:/*|^/*", "/", p)  # noqa: E731  a path without scheme
    file = F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/*|^/*", "/")
    place = F.array_max(F.filter(F.transform(F.array(*[F.lit(bare(p)) for p in there]), lambda p, i: F.when(F.startswith(file, p), i)), lambda i: i.isNotNull()))
    rows = spark.read.schema(schema).json(there).withColumn("_file", place)
    w = Window.partitionBy("chunk_id").orderBy(F.desc("_file"), F.desc("content_hash"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """One folder per manual. mode `overwrite` replaces only the manuals in chunks; `rebuild` replaces all."""
    dynamic = "dynamic" if mode == "overwrite" else "static"
    w = chunks.write.partitionBy("doc_id").mode("overwrite" if mode == "rebuild" else mode).format(fmt)
    (w.option("partitionOverwriteMode", dynamic) if fmt == "parquet" else w).save(path)


def read_qa_records(spark: SparkSession, folder: str, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (question_id, question, content, status, images) and evidence (question_id, ref_no, file, start_line, end_line) of JSON
    files of mixed shapes: a reference is `path:lines` or an object with file or source and lines as text, list or null. legacy: the
    first of a list only, and no text references."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    v = raw.select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda p, t: F.try_variant_get("v", p, t)
    records = v.select(get("$.id", "string").alias("question_id"), get("$.question", "string").alias("question"), get("$.content", "string").alias("content"), get("$.status", "string").alias("status"), get("$.images", "array<string>").alias("images"))
    refs = v.select(get("$.id", "string").alias("question_id"), F.posexplode(get("$.evidence_refs", "array<variant>")).alias("ref_no", "ref"))
    return records, evidence_refs(refs, legacy)


def evidence_refs(refs: DataFrame, legacy: bool = False) -> DataFrame:
    """refs (question_id, ref_no, ref VARIANT) in one shape; elements of a list are single lines, text may hold ranges."""
    at = lambda p, t: F.try_variant_get("ref", p, t)
    as_text = F.when(F.schema_of_variant("ref") == "STRING", F.try_variant_get("ref", "$", "string"))
    file = F.coalesce(at("$.file", "string"), at("$.source", "string"), F.regexp_extract(as_text, r"^(.*?)(?::[\d\s,，–—～~-]+)?$", 1))
    many = at("$.lines", "array<string>")
    lines = F.when(many.isNotNull(), F.element_at(many, 1) if legacy else F.array_join(many, ",")).otherwise(F.coalesce(at("$.lines", "string"), F.regexp_extract(as_text, r":([\d\s,，–—～~-]+)$", 1)))
    x = refs.select("question_id", "ref_no", file.alias("file"), F.coalesce(lines, F.lit("")).alias("lines"), as_text.isNotNull().alias("is_text"))
    if legacy:
        x = x.where(~F.col("is_text"))
    return x.select("question_id", "ref_no", "file", F.inline_outer(X.line_ranges(F.col("lines"))))


def read_question_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and perhaps a byte-order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def build_vector_table(small: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
    return small.select("chunk_id", *columns).join(vectors.select("chunk_id", "vector"), "chunk_id")


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions (user_id, session_id, version, …) as one more version; readers take the last."""
    sessions.write.partitionBy("user_id").mode("append").parquet(path)


def load_sessions(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if user_id is None else df.where(F.col("user_id") == user_id)
    w = Window.partitionBy("user_id", "session_id").orderBy(F.desc("version"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_reports(stats: DataFrame, folder: str, title: str) -> None:
    """The statistics as JSON lines, and as a Markdown table."""
    cells = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    stats.coalesce(1).write.mode("overwrite").json(f"{folder}/index")
    rows = stats.select(cells(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stats.columns])).alias("value"), F.lit(1).alias("o"))
    spark = stats.sparkSession
    names = "| " + " | ".join(stats.columns) + " |"
    rule = "|" + " --- |" * len(stats.columns)
    head = spark.createDataFrame([(f"# {title}\n\n{names}\n{rule}", 0)], "value string, o int")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(f"{folder}/report")


def answer_ret(content: Column, images: Column) -> Column:
    """JSON of the content, a comma, JSON list of the images."""
    as_json = F.regexp_extract(F.to_json(F.struct(content.alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)
    return F.concat(as_json, F.lit(","), F.to_json(F.coalesce(images, F.array().cast("array<string>"))))


def export_answers(answers: DataFrame, folder: str) -> None:
    """answers (id, content, images): CSV of id and ret, and JSON lines."""
    answers.select("id", answer_ret(F.col("content"), F.col("images")).alias("ret")).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")
    answers.write.mode("overwrite").json(f"{folder}/jsonl")


