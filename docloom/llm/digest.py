"""Quartile bucket digests of documents, and their bounded difference.

A window of five bytes slides over the text; six of its byte triplets are hashed
to one of 128 buckets and counted. A digest holds: a length class, the
ratios of the lower quartiles of the counts to the upper one, and for each bucket in
which quarter of the counts it lies (two bits). Two digests differ by at most
3 for each bucket, plus bounded terms for length and ratios; likeness is 1 less
the difference over its bound.

The edited text of a document takes its end from the next document's start, ids
descending. Rows are dealt by ranges of ids, as many as the session has shuffle partitions, and each range is read in order as a stream; the first
and the last row of each are written beside the results and meet those of the next range in a join, so there is no order over all rows.

Defined cases: null text counts as empty; texts under five bytes have counts
of zero; texts of any length are digested whole, in pieces; equal texts have equal digests; ids of any type that has an order; rows with equal ids stand in the order
of a hash of their texts and may lie in several ranges, unless the texts are equal too; null ids come last; a single row is its own next; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import saved

BUCKETS = 128
#: Triplets (places of their bytes in the window) and the salt of each.
TRIPLETS = ((0, 1, 2, 2), (0, 1, 3, 3), (0, 2, 3, 5), (0, 2, 4, 7), (0, 1, 4, 11), (0, 3, 4, 13))
#: Bounds of the difference: 3 for each bucket, 12 for length, 6 for each ratio.
LENGTH_MOST, RATIO_MOST = 12, 6
MOST = 3 * BUCKETS + LENGTH_MOST + 2 * RATIO_MOST
BYTES_AT_ONCE = 1 << 18


def bucket_counts(raw: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(raw) - 4), BYTES_AT_ONCE):
        x = np.frombuffer(raw, dtype=np.uint8, count=min(BYTES_AT_ONCE + 4, len(raw) - at), offset=at).astype(np.uint32)
        n = len(x) - 4
        first = x[:n] * np.uint32(0x9E3779B1)
        second = [x[i : n + i] * np.uint32(0x85EBCA77) for i in range(4)]
        third = [x[i : n + i] * np.uint32(0xC2B2AE3D) for i in range(5)]
        found = np.empty((len(TRIPLETS), n), dtype=np.uint32)
        for row, (_, j, k, salt) in zip(found, TRIPLETS, strict=True):
            h = first ^ (second[j] + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
            h += third[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.right_shift(h, np.uint32(25), out=row)
        out += np.bincount(found.ravel(), minlength=BUCKETS)
    return out


def digest(raw: bytes) -> np.ndarray:
    """35 numbers: length class, two ratios, 32 bytes of quarters."""
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[31, 63, 95]]
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quarter.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    length = min(255, int(math.log(len(raw), 1.2))) if raw else 0
    ratio = [int(16 * q // q3) if q3 else 0 for q in (q1, q2)]
    return np.concatenate([np.array([length, *ratio], dtype=np.uint8), packed.astype(np.uint8)])


_QUARTER_GAP = np.array([[sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], dtype=np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 to MOST."""
    head = min(LENGTH_MOST, abs(int(a[0]) - int(b[0]))) + sum(min(RATIO_MOST, abs(int(a[i]) - int(b[i]))) for i in (1, 2))
    return head + int(_QUARTER_GAP[a[3:], b[3:]].sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprint_hex(d: np.ndarray) -> str:
    return d.tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of following, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))
KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
#: What a row of the written table is: a result, or the first or last row of its range.
DONE, FIRST, LAST = 0, 1, 2


def raw_digest(text: str) -> np.ndarray:
    return digest(text.encode("utf-8", "surrogatepass"))


def result_of(text: str, own: np.ndarray, following: str, next_digest: np.ndarray) -> tuple:
    new = edited(text, following).encode("utf-8", "surrogatepass")
    d = digest(new)
    return len(text), hashlib.sha256(new).hexdigest(), fingerprint_hex(own), fingerprint_hex(d), likeness(own, d), likeness(own, next_digest)


def result_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(KINDS), KINDS, strict=True)]


def in_ranges(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (id, text): the results of all rows but the last of each range, and its first and last row with their texts."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), docs.schema["id"], T.StructField("text", T.StringType()), *[T.StructField(n, t) for n, t in RESULT]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def batch(kind: int, ids: pa.Array, texts: list[str | None], rows: list[tuple]) -> pa.RecordBatch:
            n = len(ids)
            fixed = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), ids, pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*fixed, *(result_columns(rows) if rows else [pa.nulls(n, k) for k in KINDS])], schema.names)

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, texts = b.column(0).slice(at, 1000), b.column(1).slice(at, 1000).to_pylist()
                if last is None:
                    yield batch(FIRST, ids.slice(0, 1), texts[:1], [])
                digests = [raw_digest(t) for t in texts]
                if last is not None:
                    ids, texts, digests = pa.concat_arrays([last[0], ids]), [last[1], *texts], [last[2], *digests]
                rows = [result_of(texts[i], digests[i], texts[i + 1], digests[i + 1]) for i in range(len(texts) - 1)]
                if rows:
                    yield batch(DONE, ids.slice(0, len(rows)), [None] * len(rows), rows)
                last = (ids.slice(len(rows), 1), texts[-1], digests[-1])
        if last is not None:
            yield batch(LAST, last[0], [last[1]], [])

    rows = docs.withColumn("hash", F.xxhash64("text"))
    order = (F.col("id").desc_nulls_last(), F.col("hash"))
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order, "text").select("id", "text").mapInArrow(run, schema)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: fingerprints of it and of its edited text, and their likeness."""
    names = [n for n, _ in RESULT]
    found = saved(in_ranges(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ranges), "digests")
    parts = sorted(r["part"] for r in found.where(F.col("kind") == FIRST).select("part").collect())  # one number for each range
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    last, first = found.where(F.col("kind") == LAST).select("part", "id", "text"), found.where(F.col("kind") == FIRST).select(F.col("part").alias("following"), F.col("text").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [result_of(t, raw_digest(t), n, raw_digest(n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *result_columns(rows)], ["id", *names])

    edges = last.join(F.broadcast(follows), "part").join(first, "following").select("id", "text", "next")
    edges = edges.mapInArrow(run, T.StructType([found.schema["id"], *[T.StructField(n, t) for n, t in RESULT]]))
    return found.where(F.col("kind") == DONE).select("id", *names).unionByName(edges).withColumnRenamed("id", id_col)
