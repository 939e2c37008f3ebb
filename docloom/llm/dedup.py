"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after lower-casing A-Z only. A fingerprint is the first bits of the SHA-256 of the normalised text, SPARE bits more than
the number of rows needs: enough to make most rows without a copy unique, few enough to code well.

1. Each part of the input (a sender: at most SENT rows) sorts its distinct fingerprints by owner, an owner being a range of fingerprints, and
   sends each owner its list as gaps in Golomb code (divisor a power of two, nearest to the mean gap's share).
2. An owner decodes the lists of its range and answers each with a bitmap: which of its fingerprints came from more than one sender.
3. A sender adds those that came up twice with itself, and has a bitmap of its suspect rows. Only their texts are shuffled, copies combined before,
   and compared byte by byte; classes are counted and named from rows without texts.

Texts are written once beside the fingerprints, and rows that are no suspects never move. Bitmaps are broadcast to the scan of the texts by slices of the
senders, each of at most twice SLICE rows by measure (a bit for each row); a larger slice is joined by a shuffle. A hot text makes a row
for each sender, not for each copy, before anything is grouped by text.

Defined cases: null text counts as empty; texts of any length are compared whole; of repeated rows of one id the first read is kept, the others are
dropped rows of its group; a null id is smaller than any other, and the group of null ids only has a null keep_id; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import saved, small_batches
from docloom.store import new_folder

#: Bits of a fingerprint beyond those that number the rows: a row without a copy is a suspect once in 2 ** SPARE.
SPARE = 10
#: Rows of a sender, fingerprints of an owner and owners at least, and rows whose bitmaps are broadcast at once.
SENT, OWNED, OWNERS, SLICE = 1 << 20, 1 << 22, 16, 1 << 28
BODY, SENT_LIST, PLACES = 0, 1, 2


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes know the case of A-Z only


def golomb(values: np.ndarray, base: int) -> tuple[int, bytes]:
    """Distinct values of at least base, in order, as gaps: the power of the divisor, then all quotients in unary and all remainders in binary."""
    gaps = np.diff(values, prepend=np.int64(base))
    gaps[1:] -= 1
    power = max(0, math.floor(math.log2(max(1.0, float(gaps.mean()) * math.log(2)))))
    quotients = gaps >> power
    unary = np.ones(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(power)) & 1).astype(np.uint8)
    return power, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def from_golomb(coded: bytes, n: int, power: int, base: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(coded, dtype=np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    start = -(-(int(ends[-1]) + 1) // 8) * 8
    rest = bits[start : start + n * power].reshape(n, power).astype(np.int64) @ (np.int64(1) << np.arange(power, dtype=np.int64))
    gaps = ((np.diff(ends, prepend=-1) - 1) << power) + rest
    gaps[1:] += 1
    return np.cumsum(gaps) + base


def bit_words(bits: np.ndarray) -> list[int]:
    """A bitmap as 64-bit integers, lowest bit first."""
    padded = np.zeros(-(-len(bits) // 64) * 64, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<i8").tolist()


def from_words(words: list[int], n: int) -> np.ndarray:
    return np.unpackbits(np.array(words, dtype="<i8").view(np.uint8), bitorder="little")[:n].astype(bool)


def bit(words: str, place: str) -> Column:
    return F.expr(f"(shiftrightunsigned({words}[cast({place} div 64 as int)], cast({place} % 64 as int)) & 1L) = 1L")


def owner_answers(table: pa.Table, shift: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of one owner's lists: (sender, owner, which fingerprints came from several senders)."""
    senders, owners, sizes, powers, lists = (table.column(c).to_pylist() for c in ("sender", "owner", "n", "power", "coded"))
    decoded = [from_golomb(c, n, k, o << shift) for c, n, k, o in zip(lists, sizes, powers, owners, strict=True)]
    everything = np.sort(np.concatenate(decoded))
    several = np.unique(everything[1:][everything[1:] == everything[:-1]])
    for s, o, d in zip(senders, owners, decoded, strict=True):
        yield s, o, np.isin(d, several, assume_unique=True)


def suspect_places(places: bytes, answers: list[dict], shift: int) -> np.ndarray:
    """Of a sender's rows, in their order: whether a row's fingerprint is known to have come up twice, with the sender itself or with another."""
    fps = np.frombuffer(places, dtype="<i8")
    values, at, times = np.unique(fps, return_inverse=True, return_counts=True)
    several = times > 1
    owners = values >> shift
    for a in answers:
        mine = np.flatnonzero(owners == a["owner"])
        several[mine] |= from_words(a["bits"], len(mine))
    return several[at]


def sent_rows(docs: DataFrame, id_col: str, text_col: str, bits: int, shift: int, slices: int) -> DataFrame:
    """Rows of three kinds: a text with its place; a coded list for an owner; a sender's fingerprints in the order of its rows."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("sender", T.LongType()), T.StructField("place", T.LongType()), T.StructField("id", kind),
                           T.StructField("sha", T.BinaryType()), T.StructField("body", T.BinaryType()), T.StructField("owner", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("power", T.IntegerType()), T.StructField("coded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, fps, types = TaskContext.get().partitionId(), 0, np.zeros(0, dtype=np.int64), None

        def rows(many: int, **given: pa.Array | list) -> pa.RecordBatch:
            fixed = {"slice": pa.array([(part + chunk) % slices] * many, pa.int32()), "sender": pa.array([(part << 20) + chunk] * many, pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x := (fixed | given).get(c), list) else pa.nulls(many, t) if x is None else x for c, t in types.items()], list(types))

        def lists() -> Iterator[pa.RecordBatch]:
            values = np.unique(fps)
            owners, starts = np.unique(values >> shift, return_index=True)
            for o, mine in zip(owners.tolist(), np.split(values, starts[1:]), strict=True):
                power, coded = golomb(mine, o << shift)
                yield rows(1, kind=[SENT_LIST], owner=[o], n=[len(mine)], power=[power], coded=[coded])
            yield rows(1, kind=[PLACES], n=[len(fps)], coded=[fps.astype("<i8").tobytes()])

        for b in batches:
            types = dict(zip(schema.names, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), b.column(0).type, pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True))
            bodies = [normalised(t) for t in b.column(1).to_pylist()]
            shas = [hashlib.sha256(x).digest() for x in bodies]
            if len(fps) + len(bodies) > SENT and len(fps):
                yield from lists()
                chunk, fps = chunk + 1, fps[:0]
            yield rows(len(bodies), kind=[BODY] * len(bodies), place=list(range(len(fps), len(fps) + len(bodies))), id=b.column(0), sha=shas, body=bodies)
            fps = np.append(fps, np.array([int.from_bytes(s[:8], "big") >> (64 - bits) for s in shas], dtype=np.int64))
        if len(fps):
            yield from lists()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id (largest id of its text), group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.count()
    owners = max(OWNERS, 1 << math.ceil(math.log2(max(1, total / OWNED))))
    bits = min(62, math.ceil(math.log2(total + 2)) + SPARE)
    shift, slices = bits - int(math.log2(owners)), -(-total // SLICE) or 1
    path, sent = new_folder(spark, "exact"), sent_rows(docs, id_col, text_col, bits, shift, slices)
    sent.write.partitionBy("kind", "slice").parquet(path)
    table = spark.read.schema(sent.schema).parquet(path)

    def answer(key: tuple, lists: pa.Table) -> pa.Table:
        found = [(s, o, bit_words(d)) for s, o, d in owner_answers(lists, shift)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["sender", "owner", "bits"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((one["slice"], pa.int32()), (one["sender"], pa.int64()), (one["n"], pa.int64()), (bit_words(suspect_places(one["coded"], one["answers"], shift)), pa.list_(pa.int64())))], ["slice", "sender", "n", "bits"])

    lists = table.where(F.col("kind") == SENT_LIST).select("sender", "owner", "n", "power", "coded")
    answers = lists.groupBy("owner").applyInArrow(answer, "sender long, owner int, bits array<long>").where(F.exists("bits", lambda w: w != 0))
    by_sender = answers.groupBy("sender").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))  # a bit for each fingerprint of a sender
    places = table.where(F.col("kind") == PLACES).select("slice", "sender", "n", "coded").join(by_sender, "sender", "left")
    marks = saved(places.withColumn("answers", F.coalesce("answers", F.from_json(F.lit("[]"), "array<struct<owner int, bits array<long>>>"))).select("slice", "sender", "n", "coded", "answers").mapInArrow(receive, "slice int, sender long, n long, bits array<long>"), "marks")

    body = table.where(F.col("kind") == BODY)
    large = {r["slice"] for r in marks.groupBy("slice").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * SLICE).collect()}  # a row for each slice
    marked = None
    for s in range(slices):
        mine = marks.where(F.col("slice") == s).select("sender", "bits")
        one = body.where(F.col("slice") == s).join(mine if s in large else F.broadcast(mine), "sender").withColumn("suspect", bit("bits", "place"))
        one = one.select("sender", F.expr("-shiftleft(sender, 20) - place").alias("order"), "id", "sha", "body", "suspect")
        marked = one if marked is None else marked.unionByName(one)

    suspects = marked.where("suspect")
    rows = suspects.select("sender", "order", "id", "sha")
    texts = suspects.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("n"))  # the comparison of bytes
    sizes = texts.groupBy("sha").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("bodies"))
    sizes = sizes.select("sha", F.when(F.col("bodies") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("long")).alias("group_size"))
    local = rows.groupBy("sender", "sha").agg(F.max(F.struct("id", "order")).alias("top"))
    classes = local.groupBy("sha").agg(F.max("top").alias("top")).join(sizes, "sha")
    known = local.select("sender", "sha").join(classes, "sha")
    copies = rows.join(known, ["sender", "sha"]).select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("order") == F.col("top.order")).alias("kept"), "sha")
    single = marked.where("NOT suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return copies.unionByName(single).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
