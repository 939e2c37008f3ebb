"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its words (A-Z lower-cased), joined by blanks and closed by one end symbol; all 256 bytes are symbols. A context of up to
`depth` symbols is retained if training texts hold it `least` times or more and its next-symbol distribution diverges from its suffix's, so
that it gains `gain` nats or more over all its occurrences; suffixes of retained contexts are retained too. Both limits are absolute, so the tree
grows with the corpus. Distributions are smoothed towards the suffix's, up to the uniform one. A symbol's probability comes from the longest suffix of what precedes it that is a
state of the tree.

A gram is a symbol with the `depth` symbols before it. The grams of all texts, with their
training counts, are a table; each shorter context's counts, distributions and divergences are joins and groups of such tables, in which a key has 256 rows at most from the next
longer ones. The last table has a probability for each gram. Up to FEW_GRAMS rows (36 MB) it is broadcast; a larger one never leaves the executors:
texts are dealt to buckets of about BUCKET characters by a hash, the different grams of a bucket are looked up by a join, and meet the bucket's texts
in a sorted partition. Both ways give the same scores.

Beside it stands the base score of single words. Counts of all training words are
a table; the most common of up to LONGEST bytes, `frequent` at most, are broadcast (20 MB at most), the others join by word.

Defined cases: null text counts as empty and consists of its end; texts of any length are scored whole, in pieces; rows with a null id are training
or held out as crc32 of an empty text says; repeated rows each get a row; words of equal count are common together or not; without training rows the
model is uniform over 256 symbols; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import saved, split_no

#: The end of a text; no other white space than blanks is left in it.
END = 0x0A
DEPTH = 5
#: Occurrences, and gain in nats over all of them, from which a context is retained.
LEAST, GAIN = 4, 4.0
#: Weight of the suffix's distribution, in counts for each different symbol that followed the context.
PRIOR = 4.0
#: Grams up to which their probabilities are broadcast, and characters of text in a bucket, about, beyond.
FEW_GRAMS = 3_000_000
BUCKET = 32_000_000
#: Different grams that a task holds before it hands them on.
HELD = 4_000_000
FREQUENT, LONGEST = 100_000, 64
CHUNK = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def codes_of(words: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """A text's grams, in arrays of bounded length: the symbol in the lowest byte, then those before it, latest first."""
    raw = bytes([END]) * depth + b" ".join(words) + bytes([END])
    for at in range(0, len(raw) - depth, CHUNK):
        x = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK + depth, len(raw) - at), offset=at).astype(np.int64)
        n = len(x) - depth
        code = x[depth:].copy()
        for d in range(1, depth + 1):
            code |= x[depth - d : depth - d + n] << (8 * d)
        yield code


def merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(counts, at)


def grams(docs: DataFrame, depth: int) -> DataFrame:
    """docs (p, held, text), each p in a row: (p, code, n) for the grams of each p in a task; n is a gram's count in training texts. Over HELD different grams
    a p's rows come in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        tables: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            for held, codes in waiting.items():
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    tables.append((code, n * (not held)))
                    codes.clear()
            if len(tables) > 1 and sum(len(t[0]) for t in tables[1:]) > len(tables[0][0]):
                tables[:] = [merged(tables)]

        def out() -> Iterator[pa.RecordBatch]:
            count()
            if tables:
                code, n = merged(tables)
                for at in range(0, len(code), 100_000):
                    c = code[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), now, np.int32)), pa.array(c), pa.array(n[at : at + 100_000])], ["p", "code", "n"])
                tables.clear()

        held_back = 0
        for b in batches:
            for p, held, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != now:
                    yield from out()
                    now = p
                for code in codes_of(words_of(text), depth):
                    waiting[held].append(code)
                    held_back += len(code)
                if held_back > CHUNK:
                    count()
                    held_back = 0
                    if len(tables[0][0]) > HELD:
                        yield from out()
        yield from out()

    return docs.select("p", "held", "text").mapInArrow(run, "p int, code long, n long")


def tree_scores(table: DataFrame, depth: int, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """table (code, n) of grams with their training counts: (code, p), p being the probability of the gram's symbol after the longest
    suffix of the others that the tree has."""
    below = lambda d: F.col("code").bitwiseAND((1 << 8 * d) - 1)
    levels = [saved(table, "grams")]
    for d in range(depth, 0, -1):
        levels.insert(0, saved(levels[0].groupBy(below(d).alias("code")).agg(F.sum("n").alias("n")), "grams"))
    whole = levels[0].agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    weight = PRIOR * max(1, whole["kinds"] or 0)
    scored = root = levels[0].select("code", ((F.col("n") + weight / 256) / ((whole["total"] or 0) + weight)).alias("q"))
    smooth, apart = [], []
    for d in range(1, depth + 1):
        x = levels[d].select("code", "n", F.shiftright("code", 8).alias("ctx"), below(d).alias("below"))
        totals = x.groupBy("ctx").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds"))
        weight = PRIOR * F.greatest("kinds", F.lit(1))
        x = x.join(totals, "ctx").join(scored.select(F.col("code").alias("below"), F.col("q").alias("prior")), "below")
        q = F.when(F.col("total") >= least, (F.col("n") + weight * F.col("prior")) / (F.col("total") + weight)).otherwise(F.col("prior"))
        smooth.append(saved(x.select("code", "ctx", "below", "n", "total", "prior", q.alias("q")), "tree"))
        scored = smooth[-1].select("code", "q")
        seen = smooth[-1].where((F.col("total") >= least) & (F.col("n") > 0))
        gains = seen.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("prior"))).alias("gain"))
        apart.append(gains.where(F.col("gain") >= gain).select("ctx"))
    states = [saved(apart[-1], "states")]
    for d in range(depth - 1, 0, -1):
        suffixes = states[0].select(F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("ctx"))
        states.insert(0, saved(apart[d - 1].unionByName(suffixes).distinct(), "states"))
    found = root.select("code", F.col("q").alias("p"))
    for x, kept in zip(smooth, states, strict=True):
        x = x.join(kept.withColumn("kept", F.lit(True)), "ctx", "left").join(found.select(F.col("code").alias("below"), F.col("p").alias("shorter")), "below")
        found = x.select("code", F.when(F.col("kept"), F.col("q")).otherwise(F.col("shorter")).alias("p"))
    return found


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """Rows (word, n); the end of a text is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "n"])
            seen.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > 700_000:
                    yield from out()
        yield from out()

    return train.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The words whose count is in the highest sixteenths of octaves, as many of these as hold `most` words together: no task sends more than its share."""
    grade = F.floor(F.log2("n") * 16)
    held, cut = 0, math.inf
    for r in sorted(vocab.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["grade"]):
        held += r["words"]
        if held > most:
            break
        cut = r["grade"]
    return vocab.where(grade >= F.lit(float(cut)))


class GramTable:
    """Logarithms by gram: a hash table with open addresses, looked up for whole arrays."""

    EMPTY = -1

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, dtype=np.int64)
        self.logs = np.zeros(1 << self.bits, dtype=np.float32)
        left, step = np.arange(len(codes)), 0
        while len(left):
            at = self.place(codes[left], step)
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            _, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            self.keys[at[chosen]], self.logs[at[chosen]] = codes[left[chosen]], logs[left[chosen]]
            left, step = np.delete(left, chosen), step + 1
        self.steps = step

    def place(self, codes: np.ndarray, step: int) -> np.ndarray:
        mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def total(self, codes: np.ndarray) -> float:
        """Sum over grams, all of which the table has."""
        at = self.place(codes, 0)
        found = self.keys[at] == codes
        out = float(self.logs[at[found]].sum(dtype=np.float64))
        left = codes[~found]
        for step in range(1, self.steps):
            if not len(left):
                return out
            at = self.place(left, step)
            found = self.keys[at] == left
            out += float(self.logs[at[found]].sum(dtype=np.float64))
            left = left[~found]
        if len(left):
            raise KeyError("a gram is not in the table")
        return out


#: The last broadcast table that a worker has laid out, by its name.
_TABLES: dict[str, GramTable] = {}


def score_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    held = split_no(F.col(id_col), 10) == 0
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    counted = grams(docs.withColumn("p", F.lit(0)), depth).groupBy("code").agg(F.sum("n").alias("n"))
    known = saved(tree_scores(counted, depth).select("code", F.log10("p").cast("float").alias("log")), "scores")
    few = known.count() <= FEW_GRAMS

    vocab = saved(word_counts(docs.where("not held"), "text"), "words")
    ends = docs.where("not held").count()
    row = vocab.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    v, n = row["v"] + (ends > 0), (row["n"] or 0) + ends
    base = n + 0.1 * (v + 1)
    log_of = lambda c: math.log10((c + 0.1) / base)
    frequent_words = most_frequent(vocab.where(F.length("word") <= LONGEST), frequent).collect()
    common = spark.sparkContext.broadcast({bytes(r["word"]): log_of(r["n"]) for r in frequent_words})
    end_log, end_known = log_of(ends), int(ends > 0)

    def scored_rows(texts: list[str | None], table: GramTable) -> list[tuple]:
        get, out = common.value.get, []
        for text in texts:
            words = words_of(text)
            mine = [get(w) for w in words]
            rare = [w for w, x in zip(words, mine, strict=True) if x is None]
            score = math.fsum(table.total(c) for c in codes_of(words, depth))
            out.append((len(words) + 1, len(words) - len(rare) + end_known, math.fsum(x for x in mine if x is not None) + end_log, score, rare))
        return out

    def result(ids: pa.Array, held: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([ids, held, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "held", "n_tokens", "known", "part", "score", "rare"])

    shape = f"id {id_type}, held boolean, n_tokens long, known long, part double, score double, rare array<binary>"
    if few:
        arrow = known.toArrow()
        name = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast((arrow.column("code").to_numpy(), arrow.column("log").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _TABLES:
                _TABLES.clear()
                _TABLES[name] = GramTable(*sent.value)
            for b in batches:
                yield result(b.column(0), b.column(2), scored_rows(b.column(1).to_pylist(), _TABLES[name]))

        scored = docs.select("id", "text", "held").mapInArrow(run, shape)
    else:
        scored = in_buckets(docs, known, depth, id_type, scored_rows, result, shape)
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    spread = scored.select("row", F.explode("rare").alias("word"))
    more = spread.join(vocab, "word", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(base))).alias("rest"), F.count("n").alias("more")
    )
    return scored.join(more, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def in_buckets(docs: DataFrame, known: DataFrame, depth: int, id_type: str, scored_rows: Callable, result: Callable, shape: str) -> DataFrame:
    """The scored texts, each bucket of which meets the part of the table known that it asks for."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET))
    docs = docs.withColumn("p", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))
    asked = grams(docs.repartition(buckets, "p").sortWithinPartitions("p"), depth).select("p", "code")
    found = asked.join(known, "code").select("p", "code", "log")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for b in batches:
            p, is_text = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((p[1:] != p[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if p[lo] != now:
                    now, parts = p[lo], []
                if not is_text[lo]:
                    parts.append((b.column(2).slice(lo, hi - lo).to_numpy(), b.column(3).slice(lo, hi - lo).to_numpy()))
                    continue
                if parts:
                    codes, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
                    codes, first = np.unique(codes, return_index=True)
                    table, parts = GramTable(codes, logs[first]), []
                yield result(b.column(4).slice(lo, hi - lo), b.column(6).slice(lo, hi - lo), scored_rows(b.column(5).slice(lo, hi - lo).to_pylist(), table))

    null = lambda kind: F.lit(None).cast(kind)
    tables = found.select("p", F.lit(False).alias("is_text"), "code", "log", null(id_type).alias("id"), null("string").alias("text"), null("boolean").alias("held"))
    texts = docs.select("p", F.lit(True).alias("is_text"), null("long").alias("code"), null("float").alias("log"), "id", "text", "held")
    meet = tables.unionByName(texts).repartition(buckets, "p").sortWithinPartitions("p", "is_text")
    return meet.mapInArrow(run, shape)
