"""Spelling variants of words, found by pivotal grams.

Words are counted over all whole texts; two are near if they differ by one inserted, deleted or replaced code point.

Candidates: a word's bigrams with their places are put in order of rarity over all words, rarest first. Its prefix is the first three, and, as far as the fifth place that the
third one has in the word, that one's other places. Of the first three, two that do not overlap are its pivots; dynamic programming over places takes the pair of least frequency. One edit spoils
one of two disjoint bigrams at most, so of two near words the one whose third bigram is the rarer (or as rare) has a pivot in the other's prefix. Its place is bounded:
equal in words of equal length, and up to one higher in the word that is longer by one. So bigram, length and place of the pivot are the
join key; keys with over SPLIT pivots are split into blocks of pivots, to each of which the prefixes go. Pairs are verified in the join itself: by
the letters they hold, as bits, then by their edit distance.

Rarer bigrams also bound what a key holds, and as there are at most 90 * 90 of them their order is broadcast. A word's form has at least twice its count, so
chains of forms are short; roots are found by doubling.

Defined cases: null and empty texts have no words; texts and words of any length are read whole; of forms with equal counts the first in code-point order
counts; repeated rows count as often as they stand there; a null id counts as an empty one in the rule that drops code points; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import saved, sized, small_batches

# What a word is, and which runs lose a code point.
RUN = re.compile("[a-zÀ-ÿ]+")  # of texts with A-Z lower-cased
DROP_EVERY, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 97, 5, 3, 2
#: Bigrams of a prefix, places of its last one, and pivots of a key that stay in one block.
PREFIX, PLACES, SPLIT = 3, 5, 1000
#: Different words that a task counts before it hands them on.
HELD = 200_000


def text_words(doc_id: str, text: str | None) -> Iterator[tuple[str, int]]:
    """The different words of a text with their counts."""
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes know the case of A-Z only
    for run, n in Counter(RUN.findall(lower)).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (word, n) of all words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in text_words(i, t):
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def pivots_of(grams: list[tuple[int, int, int]]) -> list[int]:
    """Of bigrams (rank, place, frequency): the places of two disjoint ones of least frequency, by dynamic programming over places."""
    best: list[list[tuple[int, list[int]]]] = [[(0, [])], [], []]  # by how many are taken: (frequency, places)
    for _, place, frequency in sorted(grams, key=lambda g: g[1]):
        for taken in (1, 0):
            free = [x for x in best[taken] if not x[1] or x[1][-1] + 2 <= place]
            if free:
                least = min(free)
                best[taken + 1].append((least[0] + frequency, [*least[1], place]))
    return min(best[2])[1]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """Rank of the prefix's last bigram, pivots and prefix as (bigram, place)."""
    grams = sorted((order[word[p : p + 2]][0], p, order[word[p : p + 2]][1]) for p in range(len(word) - 1))
    last = grams[PREFIX - 1][0]
    first = grams[:PREFIX]
    more = [g for g in grams if g[0] == last][:PLACES]
    prefix = first + [g for g in more if g not in first]
    return last, [(word[p : p + 2], p) for p in pivots_of(first)], [(word[p : p + 2], p) for _, p, _ in prefix]


def letter_mark(word: str) -> int:
    """64 bits: which letters a word holds, and which of them an odd number of times. One edit changes two bits of either half at most."""
    odd = held = 0
    for c in word:
        b = 1 << (ord(c) & 31)
        odd ^= b
        held |= b
    return (held << 32 | odd) - (held >> 31 << 64)


def index_rows(words: DataFrame) -> DataFrame:
    """Rows (pivot, gram, len, place, last, mark, word, n): of a pivot its own key, of a prefix's bigram each key that a near word's pivot can have."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("gram")).groupBy("gram").count()
    order = {r["gram"]: (rank, r["count"]) for rank, r in enumerate(grams.orderBy("count", "gram").collect())}  # at most 90 * 90
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            out: list[tuple] = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                last, pivots, prefix = signature(word, order)
                size, mark = len(word), letter_mark(word)
                out += [(True, g, size, p, last, mark, word, n) for g, p in pivots]
                out += [(False, g, size + more, p + by, last, mark, word, n) for g, p in prefix for more, by in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)) if p + by >= 0]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types.values(), strict=True)], list(types))

    types = {"pivot": pa.bool_(), "gram": pa.string(), "len": pa.int32(), "place": pa.int32(), "last": pa.int32(), "mark": pa.int64(), "word": pa.string(), "n": pa.int64()}
    return words.mapInArrow(run, "pivot boolean, gram string, len int, place int, last int, mark long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, na, b, nb): all near words of a table of words (word, n), both ways."""
    key = ["gram", "len", "place"]
    rows = saved(index_rows(words), "grams")
    sizes = saved(rows.where("pivot").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("blocks")), "keys")
    rows = rows.join(sized(sizes), key)
    left = rows.where("pivot").select(*key, F.expr("cast(pmod(xxhash64(word), blocks) as int)").alias("block"), F.col("last").alias("la"), F.col("mark").alias("ma"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.where("NOT pivot").select(*key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("last").alias("lb"), F.col("mark").alias("mb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, [*key, "block"]).where("la <= lb AND a <> b AND bit_count((ma ^ mb) & 4294967295L) <= 2 AND bit_count(shiftrightunsigned(ma ^ mb, 32)) <= 2 AND levenshtein(a, b, 1) = 1")
    pairs = met.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    once = saved(pairs.distinct(), "near")
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), without cycles: rows (word, root) with the last form that a word leads to."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = saved(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    small_batches(docs.sparkSession)
    words = saved(word_counts(docs, id_col, text_col), "words")
    near = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("form"))).alias("best"))
    all_words = words.join(near, "word", "left").withColumn("is_form", -F.col("best.n") >= FORM_TIMES * F.col("n"))
    known = saved(all_words.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.n")).alias("form_n")), "forms")
    out = known.join(roots(known.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
