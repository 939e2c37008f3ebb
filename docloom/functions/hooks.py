"""Places for outer models. What is shipped is native or a table join; a hook runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import SENTENCE_END, SPACE


def token_counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A column function from a batch token counter; null counts 0."""

    @F.pandas_udf(T.LongType())
    def counted(s: pd.Series) -> pd.Series:
        return pd.Series(count(s.fillna("").tolist()), index=s.index)

    return counted


def word_segmenter(segment: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segmented(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [w.strip().lower() for w in segment(t) if w.strip()] if t else [])

    return segmented


def in_batches(df: DataFrame, call: Callable[[list[dict]], list], name: str, kind: str, attempts: int = 3) -> DataFrame:
    """df with a result column `name`, and the columns attempts and error. A batch that fails is tried again; after the last
    attempt its rows have no result and the error's text."""
    from pyspark.sql.types import _parse_datatype_string

    schema = T.StructType([*df.schema.fields, T.StructField(name, _parse_datatype_string(kind)), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow_kind = to_arrow_type(schema[name].dataType)
        for b in batches:
            rows, result, error, tries = b.to_pylist(), None, None, 0
            while result is None and tries < attempts:
                tries += 1
                try:
                    result, error = call(rows), None
                except Exception as e:  # noqa: BLE001  an outer service may fail in any way
                    error = f"{type(e).__name__}: {e}"
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result or [None] * n, arrow_kind), pa.array([tries] * n, pa.int32()), pa.array([error] * n, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def embedder(call: Callable[[list[dict]], list[list[float]]]) -> Callable[[DataFrame], DataFrame]:
    return lambda work: in_batches(work, call, "vector", "array<float>")


def rerank_scorer(call: Callable[[list[dict]], list[float]]) -> Callable[[DataFrame], DataFrame]:
    return lambda pairs: in_batches(pairs, call, "rerank_score", "double")


def relation_extractor(call: Callable[[list[dict]], list[str]]) -> Callable[[DataFrame], DataFrame]:
    return lambda pairs: in_batches(pairs, call, "reply", "string")


def text_model(call: Callable[[list[dict]], list[str]], name: str) -> Callable[[DataFrame], DataFrame]:
    """An answerer, router, rewriter or summariser."""
    return lambda prompts: in_batches(prompts, call, name, "string")


def normal(text: str) -> str:
    return strip_space(re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text.replace("\ufeff", ""))))


def strip_space(text: str) -> str:
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", text)


@F.udtf(returnType="piece_no int, piece string")
class ChunkText:
    """chunk_text(text, max_tokens) for SQL: the parts of a paragraph as split_paragraph makes them, streamed, so that SQL can have the limit in a column. A third
    argument has the characters that are taken off the windows of long sentences; all white space where it is left out."""

    def eval(self, text: str, most: int, edges: str | None = None):
        value, cur, tokens, no = normal(text or ""), "", 0, 0
        for s in [value] if len(value) // 2 <= most else map(strip_space, re.split(SENTENCE_END, value)):
            n = max(1, len(s) // 2) if s else 0
            if cur and (n > most or tokens + n > most):
                yield no, cur
                no, cur, tokens = no + 1, "", 0
            if n > most:
                for at in range(0, len(s), 2 * most):
                    if part := strip_space(s[at : at + 2 * most]) if edges is None else s[at : at + 2 * most].strip(edges):
                        yield no, part
                        no += 1
            elif s:
                cur, tokens = f"{cur} {s}" if cur else s, tokens + n
        if cur:
            yield no, cur


def register(spark) -> None:
    spark.udtf.register("chunk_text", ChunkText)
