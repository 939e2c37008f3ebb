"""How filters interact: survivors of every subset of them, by truth-table words and positional popcounts.

Five filters are applied to whole texts (words are maximal runs without ASCII white space, case-sensitive); a document fails

A: with under 200 words; B: with 100 * distinct words < 50 * words; C: with 100 * characters A-Z > 3 * code points; D: if it holds any of #$%&*|;
E: if its text is that of any smaller id in the whole table, be that removed or not.

Of a document that fails the filters in mask m, bit S of its 32-bit word says whether it survives the subset S of filters: S and m have none in common. Words
of one part and label are added up bit by bit: carry-save adders turn three words of a weight into one of that weight and one of the double, until two are left of each. The 32 sums are
the survivors of all subsets, and whatever an order of the filters keeps or removes is a difference of two of them.

Texts are read once; copies are told by the SHA-256 of the whole text. A document passes E if it is the first of its text, which is found by a join on
text and id: a text that many share is dealt evenly over the tasks.

Defined cases: null text counts as empty, null lang as the empty string; rows without an id never fail E, and repeated rows of one id do not fail it by
each other; labels of one id given more than once count if any says so, those without an id not at all; an empty table gives no rows; an empty table of
labels gives zeros; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import saved, small_batches

# The filters, in order of their bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
SUBSETS = 1 << len(FILTERS)
#: Parts and labels whose sums a task holds before it hands them on.
HELD = 10_000
#: Of each failing mask: the word of the subsets that a document survives.
SURVIVED = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], dtype=np.uint32)


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * n_chars) << 2
        | (SIGNS.search(text) is not None) << 3
    )


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    weights = [words]
    counts = np.zeros(32, dtype=np.int64)
    for weight in range(64):
        if len(weights) == weight:
            break
        carries = []
        while len(now := weights[weight]) > 2:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            weights[weight] = np.concatenate([half ^ c, now[3 * third :]])
        for left in weights[weight].tolist():
            counts += ((left >> np.arange(32)) & 1) << weight
        if carries:
            weights.append(np.concatenate(carries))
    return counts


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row for each document: id, part, mask (of A to D), sha of the text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("sha", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, shas = [], []
            for t in b.column(2).to_pylist():
                data = (t or "").encode("utf-8", "surrogatepass")
                masks.append(int(text_mask(data, len(t or ""))))
                shas.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(shas, pa.binary())], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def survivors(rows: DataFrame) -> DataFrame:
    """rows (part, mask, good, toxic): rows (part, label, subset, n), label being 0 for all documents, 1 for good and 2 for toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (part, label), counts in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part] * SUBSETS, pa.string()), pa.array([label] * SUBSETS, pa.int32()), pa.array(np.arange(SUBSETS, dtype=np.int32)), pa.array(counts)], ["part", "label", "subset", "n"])
            sums.clear()

        for b in batches:
            words = SURVIVED[b.column(1).to_numpy()]
            codes = b.column(0).dictionary_encode()
            at, marks = codes.indices.to_numpy(), [np.ones(len(words), dtype=bool), *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
            for code, part in enumerate(codes.dictionary.to_pylist()):
                mine = at == code
                for label, mark in enumerate(marks):
                    sums[part, label] = sums.get((part, label), 0) + positional_counts(words[mine & mark])
            if len(sums) > HELD:
                yield from out()
        yield from out()

    return rows.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, label int, subset int, n long").groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def steps() -> Column:
    """All orders of the filters, an element for each step: order, step, filter's place, subsets before and after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "f": f, "before": done, "after": done | 1 << f})
            done |= 1 << f
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order string, step int, f int, before int, after int>>")


def shapley(f: int, of: Column) -> Column:
    """What filter f removes, added up over all orders."""
    total = F.lit(0).cast("long")
    for s in range(SUBSETS):
        if not s >> f & 1:
            total += F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) * (of[s] - of[s | 1 << f])
    return total


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    small_batches(docs.sparkSession)
    rows = saved(failures(docs, id_col, text_col, part_col), "failures")
    firsts = rows.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.join(firsts, ["sha", "id"], "left").join(marks, "id", "left")
    copied = F.col("first").isNull() & F.col("id").isNotNull()
    known = known.select("part", F.col("mask").bitwiseOR(F.when(copied, 1 << 4).otherwise(0)).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    sums = survivors(known).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("label") * SUBSETS + F.col("subset")).alias("at"), "n"))).alias("sums"))
    of = [F.transform(F.sequence(F.lit(label * SUBSETS), F.lit((label + 1) * SUBSETS - 1)), lambda i: F.coalesce(F.element_at("sums", i), F.lit(0).cast("long"))).alias(n) for label, n in enumerate(("every", "good", "toxic"))]
    parts = sums.select("part", *of).withColumn("shares", F.array(*[shapley(f, F.col("every")) for f in range(len(FILTERS))]))
    x = parts.select("*", F.explode(steps()).alias("s")).select("part", "every", "good", "toxic", "shares", "s.*")
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    bit = F.expr("shiftleft(1, f)")
    last = SUBSETS - 1
    return x.select(
        "part", "filter_order", "step", F.get("every", F.col("after")).alias("kept"), lost("every").alias("removed"),
        (F.get("every", F.lit(0)) - F.get("every", bit) - lost("every")).alias("redundant"),
        (F.get("every", F.lit(last) - bit) - F.get("every", F.lit(last))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"),
    )
