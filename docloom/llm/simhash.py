"""SimHash near-duplicates, with candidates pruned by a ring of segments.

A document's fingerprint has a bit set where over half of its shingles' XXH64
values have it. Two fingerprints link when at most `max_bits` bits differ.

Candidates: 64 bits form a ring of `segments` segments. If the differences of
all segments sum to max_bits or less, some rotation exists in which the first
l segments differ in at most l * max_bits / segments bits, for every l. As long
as that budget is below 1 the segments must be equal, so those leading segments
are the join key; the longer chains are tested on the joined pair, then comes
the full Hamming distance.

Groups of over `pair_limit` fingerprints behind one key make no pairs. Their
members meet exactly in another way: two fingerprints differ in at most two bits
if and only if they have a common neighbour within one bit, so each member
is sent to its 65 neighbours and joins the least member found there.

Defined cases: null text counts as empty; a text without words has fingerprint
zero, linked like any other; one or two words are one shingle; texts of any length are hashed whole, in pieces; a bit set in just half of the
hashes is 0; repeated rows
each get a row; rows with a null id are linked, and a component with null ids
only has a null component id; an empty table gives no rows; other columns are ignored, whatever their names.

Join keys are 28 bits of the default ring: of n fingerprints spread at random, about n / 2^28 share one, so 10^10 make some 40 a key, 6,400 pairs a
fingerprint over 16 rotations before the chain tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import give_back, saved, sized

SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in arrays of bounded length; nothing for a text without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    if len(tokens) <= words:
        shingles: list[bytes] = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(x) for x in zip(*(tokens[i:] for i in range(words)), strict=False)]
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        yield np.fromiter((hash64(s, 42) for s in part), dtype="<u8", count=len(part))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each bit: in how many of the hashes it is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        ones += majority(h)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


#: Texts whose shingles tell which are common, how many of these are known, and in how many of the texts they are at least.
SAMPLE, COMMON, OFTEN = 10_000, 200_000, 4
#: Rows of a shingle's group that are dealt to one block; rows from which a shingle of prefixes goes to the end of the order, and how many of these are known.
WIDE, MANY, KNOWN = 2048, 16, 500_000
#: Rounds in which open groups meet some rows of their most frequent component, at most so many, before all that is open meets.
TURNS, CENTRES = 2, 32


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def set_hash(h: np.ndarray) -> int:
    """XXH64 of a shingle set: texts of one set are one node."""
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a shingle set, those that come first by (count in the sample, hash), so many that two sets of that similarity share one of them."""
    n = len(h)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[: n - math.ceil(similarity * n - 1e-9) + 1] if n else h


def with_known(common: np.ndarray, counts: np.ndarray, known: np.ndarray, n: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of the sample, their counts scaled to all texts, and those found to be frequent in prefixes."""
    both, at = np.unique(np.concatenate([common, known]), return_inverse=True)
    out = np.zeros(len(both))
    np.maximum.at(out, at, np.concatenate([counts * scale, n]))
    return both, out


def fronts_again(texts: DataFrame, words: int, common: np.ndarray, counts: np.ndarray, similarity: float) -> DataFrame:
    """texts (fp, size, text): (fp, size, front), prefixes by the given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fronts = [prefix(shingle_set(t, words), common, counts, similarity).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fronts, pa.list_(pa.int64()))], ["fp", "size", "front"])

    return texts.select("fp", "size", "text").mapInArrow(run, "fp long, size long, front array<long>")


def parity_bits(h: np.ndarray) -> bytes:
    """Parity of the hashes by their low bits, in at least twice as many bits as hashes (a power of two). Two sets differ in at
    least as many members as their parities in bits; halves of a parity combined by XOR give that of half the size."""
    m = max(256, 1 << max(0, 2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(sizes: np.ndarray, other: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, with at least `differ` members in one of them only, can be that similar."""
    return (np.minimum(sizes, other) >= similarity * np.maximum(sizes, other) - 1e-9) & (differ * (1 + similarity) <= (1 - similarity) * (sizes + other) + 1e-6)


def filtered_pairs(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may link by size and parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, x, y in zip(*(t.column(i).to_pylist() for i in range(2, 6)), strict=True):
                left, right = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                w = min(len(left), len(right))
                differ = np.bitwise_count(folded(left, w) ^ folded(right, w)).sum(dtype=np.int64)
                keep.append(bool(may_link(na, nb, differ, similarity)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: features.select(F.col("fp").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    close = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    return close.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def reachable(a: str, b: str, similarity: float) -> str:
    """SQL: whether rows (size, pos) of one shingle, a no larger than b, can be of linked sets, if it is the first in order that both have: what is left of both, the
    shingle included, must hold the overlap that the similarity asks for."""
    share = similarity / (1 + similarity)
    return f"{a}_size <= {b}_size AND {a}_size >= {similarity} * {b}_size - 1e-9 AND least({a}_size - {a}_pos, {b}_size - {b}_pos) >= {share} * ({a}_size + {b}_size) - 1e-6"


def shared_tokens(fronts: DataFrame) -> DataFrame:
    """fronts (fp, size, front): (token, fp, size, pos, prev, prev2) of each place whose token another prefix holds, too, with the two tokens before it. Only tokens and
    places are dealt by token; those that are shared go back to their prefixes."""
    held = fronts.select("fp", F.posexplode("front").alias("pos", "token"))
    shared = held.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1").groupBy("fp").agg(F.collect_list("pos").alias("places"))
    of = F.transform("places", lambda i: F.struct(F.get("front", i).alias("token"), i.cast("long").alias("pos"), F.get("front", i - 1).alias("prev"), F.get("front", i - 2).alias("prev2")))
    return fronts.join(shared, "fp").select("fp", "size", F.explode(of).alias("of")).select("of.token", "fp", "size", "of.pos", "of.prev", "of.prev2")


def star_pairs(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """rows (fp, size, pos, ...): each with the least row of its keys' group, if they may link. As many pairs as rows at most."""
    centre = rows.groupBy(*keys).agg(F.min(F.struct("fp", "size", "pos")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.col("c.fp").alias("c_fp"), F.col("c.size").alias("c_size"), F.col("c.pos").alias("c_pos"))
    met = rows.select(*keys, "fp", F.col("size").alias("r_size"), F.col("pos").alias("r_pos")).join(centre, keys).where("fp <> c_fp")
    return met.where(f"({reachable('c', 'r', similarity)}) OR ({reachable('r', 'c', similarity)})").select(F.least("fp", "c_fp").alias("a"), F.greatest("fp", "c_fp").alias("b"))


def open_stars(rows: DataFrame, roots: DataFrame, similarity: float, turn: int) -> DataFrame:
    """rows (token, fp, size, pos, ...): of a shingle's group within a class of size, each row that is not in the most frequent component, with up to CENTRES rows of
    that component (one for each 16 of its rows), if they may link. Which ones changes with each turn, and classes lie half a class apart. As many pairs as CENTRES times the rows at most."""
    base = math.log(1 / similarity) * 1.001
    key = ["token", "class"]
    ours = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).withColumn("class", F.floor(F.log("size") / base + turn / 2).cast("int"))
    main = ours.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    main = main.select(*key, F.col("most.root").alias("main"), F.least(F.ceil(F.col("most.n") / 16), F.lit(CENTRES)).cast("int").alias("centres"))
    ours = saved(ours.join(main, key).select(*key, "root", "main", "centres", "fp", "size", "pos"), "open")
    by = F.xxhash64("fp", F.lit(turn))
    centre = ours.where("root = main").groupBy(*key, F.expr(f"pmod(xxhash64({turn}, fp), centres)").alias("at")).agg(F.min(F.struct(by.alias("by"), "fp", "size", "pos")).alias("c"))
    centre = centre.select(*key, F.col("c.fp").alias("c_fp"), F.col("c.size").alias("c_size"), F.col("c.pos").alias("c_pos"))
    met = ours.where("root <> main").select(*key, "fp", F.col("size").alias("r_size"), F.col("pos").alias("r_pos")).join(centre, key)
    return met.where(f"({reachable('c', 'r', similarity)}) OR ({reachable('r', 'c', similarity)})").select(F.least("fp", "c_fp").alias("a"), F.greatest("fp", "c_fp").alias("b")).distinct()


def open_pairs(rows: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """rows (token, fp, size, pos, prev, prev2): all pairs of a shingle's group that are not yet in one component and may link.

    Of two such sets the smaller has a common shingle in its first ninth (at 0.8; an index row), the larger one in its first fifth (all rows). Groups are keyed by
    classes of size as well, in which partners are neighbours. A class whose rows are in one component makes no pairs; in others the rows of its
    most frequent component meet only those of the rest. Index rows are dealt to blocks, each of which the others go to. A pair with a common shingle among
    the two before is left to an earlier group: the first that both are in, to which the bounds of places refer, has none."""
    base = math.log(1 / similarity) * 1.001
    ours = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).withColumn("class", F.floor(F.log("size") / base).cast("int"))
    index = F.col("pos") < F.col("size") - F.ceil(2 * similarity / (1 + similarity) * F.col("size") - 1e-6) + 1
    left = ours.where(index)
    right = ours.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    counted = left.select("token", "class", "root", F.lit(1).alias("i")).unionByName(right.select("token", "class", "root", F.lit(0).alias("i"))).groupBy("token", "class", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("i"))
    groups = counted.groupBy("token", "class").agg(F.count(F.lit(1)).alias("roots"), F.sum("i").alias("i"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1 AND i > 0")
    groups = saved(groups.select("token", "class", F.col("most.root").alias("main"), F.ceil(F.col("i") / WIDE).cast("int").alias("blocks")), "open")
    key = ["token", "class"]
    l = left.join(groups, key).select(*key, F.expr("cast(pmod(xxhash64(fp, 1), blocks) as int)").alias("block"), (F.col("root") != F.col("main")).alias("l_stray"), F.col("fp").alias("l_fp"), F.col("root").alias("l_root"), F.col("size").alias("l_size"), F.col("pos").alias("l_pos"), F.col("prev").alias("l_prev"), F.col("prev2").alias("l_prev2"))  # noqa: E741
    r = right.join(groups, key).select(*key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), (F.col("root") != F.col("main")).alias("stray"), F.col("fp").alias("r_fp"), F.col("root").alias("r_root"), F.col("size").alias("r_size"), F.col("pos").alias("r_pos"), F.col("prev").alias("r_prev"), F.col("prev2").alias("r_prev2"))
    # strays meet all rows; rows of the main component meet strays
    l = l.withColumn("stray", F.explode(F.when(F.col("l_stray"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))  # noqa: E741
    met_before = "coalesce(l_prev = r_prev, false) OR coalesce(l_prev = r_prev2, false) OR coalesce(l_prev2 = r_prev, false) OR coalesce(l_prev2 = r_prev2, false)"
    met = l.join(r, [*key, "block", "stray"]).where(f"l_root <> r_root AND {reachable('l', 'r', similarity)} AND NOT ({met_before})")
    return met.select(F.least("l_fp", "r_fp").alias("a"), F.greatest("l_fp", "r_fp").alias("b")).distinct()


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """docs with a column `name` (long: the fingerprint's bits) added, replacing one of that name."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t, words) for t in b.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def ring_keys(fps: DataFrame, max_bits: int, segments: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows (fp, turn, key) for each rotation of the ring, and the chain tests (bits, budget) that a pair must pass."""
    width = 64 // segments
    lead = max(n for n in range(1, segments) if n * max_bits // segments == 0)
    tests = [
        (n * width, n * max_bits // segments)
        for n in range(lead + 1, segments + 1)
        if n == segments or (n + 1) * max_bits // segments > n * max_bits // segments
    ]
    turns = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("turn")
    keys = fps.select("fp", turns).select("fp", "turn", F.expr(f"{rotated('fp', 'turn', width)} & {(1 << (lead * width)) - 1}L").alias("key"))
    return keys, tests


def rotated(fp: str, turn: str, width: int) -> str:
    return f"(shiftrightunsigned({fp}, {turn} * {width}) | CASE WHEN {turn} = 0 THEN 0L ELSE shiftleft({fp}, 64 - {turn} * {width}) END)"


def close_pairs(fps: DataFrame, max_bits: int = 2, segments: int = 16, pair_limit: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: their components are those of all links of max_bits or less."""
    if max_bits > 2:
        pair_limit = 1 << 62  # the common-neighbour form is exact for two bits at most
    width = 64 // segments
    keys, tests = ring_keys(fps, max_bits, segments)
    sizes = keys.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = saved(keys.join(sizes, ["turn", "key"]), "ring")
    small = grouped.where(F.col("n") <= pair_limit)
    left = small.select("turn", "key", F.col("fp").alias("a"), F.expr(rotated("fp", "turn", width)).alias("ra"))
    right = small.select("turn", "key", F.col("fp").alias("b"), F.expr(rotated("fp", "turn", width)).alias("rb"))
    chain = [
        F.expr(f"bit_count((ra ^ rb) & {(1 << bits) - 1}L) <= {budget}" if bits < 64 else f"bit_count(ra ^ rb) <= {budget}")
        for bits, budget in tests
    ]
    pairs = left.join(right, ["turn", "key"]).where("a < b")
    for test in chain:
        pairs = pairs.where(test)
    pairs = pairs.select("a", "b")
    if max_bits > 2:
        return pairs.distinct()
    crowd = grouped.where(F.col("n") > pair_limit).select("fp").distinct()
    balls = crowd.select("fp", F.explode(F.expr("concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))")).alias("flip")).select("fp", F.expr("fp ^ flip").alias("near"))
    least = balls.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("near", "a")
    stars = balls.join(least, "near").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the least node of the connected component. Nodes without an edge have no row.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its least neighbour, then its smaller ones and itself.
    """
    now = saved(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END as u", "m as v").unionByName(lows.selectExpr("u", "m as v")).where("u <> v").distinct()
        now = saved(small, "cc")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("xxhash64(u, v) % 1000000007")).alias("h")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.selectExpr("u as node", "v as root")


def linked(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 2, segments: int = 16) -> DataFrame:
    """For rows (id, fp): one row (fp, component_id) for each distinct fp."""
    nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    roots = components(close_pairs(nodes.select("fp"), max_bits, segments))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return member.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, segments: int = 16) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id that links reach)."""
    prints = saved(with_fingerprint(docs.select(F.col(id_col), F.col(text_col)), text_col, words).select(id_col, "fp"), "prints")
    out = prints.join(linked(prints, id_col, max_bits, segments), "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def verified_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs (a, b) and texts (fp, text): the pairs whose whole shingle sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for b in batches:
            a, other = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for x, ta, tb in zip(a, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last is None or last[0] != x:
                    last = (x, shingle_set(ta, words))
                t = shingle_set(tb, words)
                both = len(np.intersect1d(last[1], t, assume_unique=True))
                keep.append(both >= similarity * (len(last[1]) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), texts.select(F.col("fp").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def common_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the commonest shingles of a bounded sample of different texts. They only order the shingles:
    any order gives the same links, and one with the common shingles last gives small groups."""
    share = SAMPLE / max(1, docs.count())
    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """docs without the documents that a chain of links leads to a kept one: of each component the row with the least id stays.

    Texts of equal shingle sets are one node; two nodes link if their whole shingle sets have at least `similarity`. Candidates come in
    rounds: fingerprints within max_bits, by the ring of segments; then, as that similarity allows for more bits
    than any ring can prune by, nodes that share a shingle of their prefixes, the rarest fifth of each, which two such sets always do: first those that share two
    shingles in a row, or one, each with the least of its group; then all that are not yet in one component, by places and sizes (open_pairs). Pairs that sizes or
    parities rule out are left out; all others are verified. Shingles' groups hold numbers only; parities are looked up for each pair that is left.

    A crowd of texts that share most of their shingles, but less than links need, makes no pairs where these shingles are known to be common: they come last in order,
    past the places that can link. Known are those of a sample, and those that MANY prefixes hold: these prefixes are made again, with such shingles last. The order changes no
    result; beyond the KNOWN most frequent of them, a shingle's texts can make the square of their number, in blocks.

    Null and empty texts have the empty set and are one node; rows with equal ids go by their place; a component with null ids only keeps its first row;
    columns of docs may have any names."""
    columns = docs.columns
    at = columns.index(text_col)
    mine = lambda name: next(n for i in range(len(columns) + 1) if (n := f"__{name}{i or ''}") not in {c.lower() for c in columns})
    node, size, bits, front, mark, row = map(mine, ("node", "size", "bits", "front", "mark", "row"))
    own = ((node, T.LongType()), (size, T.LongType()), (bits, T.BinaryType()), (front, T.ArrayType(T.LongType())), (mark, T.LongType()))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in own]])
    common, counts = common_shingles(docs, text_col, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, marks = [], []
            for t in b.column(at).to_pylist():
                parts = list(shingle_hashes(t, words))
                ones = sum(map(majority, parts), np.zeros(64, dtype=np.int64))
                marks.append(np.packbits(ones * 2 > sum(map(len, parts)), bitorder="little").view("<i8")[0])
                sets.append(np.unique(np.concatenate([np.zeros(0, "<u8"), *parts])))
            fps = pa.array(np.array([set_hash(h) for h in sets], dtype=np.uint64).view(np.int64))
            fronts = pa.array([prefix(h, common, counts, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            added = [fps, pa.array([len(h) for h in sets], pa.int64()), pa.array([parity_bits(h) for h in sets], pa.binary()), fronts, pa.array(np.array(marks, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], schema.names)
        give_back()

    marked = saved(docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "marked")
    prints = marked.select(F.col(f"`{id_col}`").alias("id"), F.col(node).alias("fp"), F.col(mark).alias("mark"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = saved(prints.groupBy("fp").agg(first, F.min(F.struct("row", "mark")).alias("of")).select("fp", "first", "of.row", "of.mark"), "nodes")
    more = saved(prints.join(nodes.select("fp", F.col("row").alias("kept")), "fp").where("row <> kept").select("row"), "more")
    whole = without(marked, row, more)
    features = whole.select(F.col(node).alias("fp"), F.col(size).alias("size"), F.col(bits).alias("bits"))
    fronts = whole.select(F.col(node).alias("fp"), F.col(size).alias("size"), F.col(front).alias("front"))
    held = fronts.select("fp", F.explode("front").alias("token"))
    frequent = saved(held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY).orderBy(F.desc("n"), "token").limit(KNOWN), "frequent")
    known = frequent.toArrow()  # at most KNOWN numbers
    if len(known):
        # prefixes without a frequent shingle are the same in the new order
        affected = sized(saved(held.join(sized(frequent.select("token")), "token").select("fp").distinct(), "affected"))
        order = with_known(common, counts, known.column("token").to_numpy().view(np.uint64), known.column("n").to_numpy(), max(1.0, marked.count() / SAMPLE))
        texts = whole.select(F.col(node).alias("fp"), F.col(size).alias("size"), F.col(f"`{text_col}`").alias("text")).join(affected, "fp", "left_semi")
        fronts = saved(fronts.join(affected, "fp", "left_anti").unionByName(fronts_again(texts, words, *order, similarity)), "fronts")
    groups = saved(shared_tokens(fronts), "groups")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs, "pairs")
        wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "row"), "fp"), "wanted")
        texts = saved(marked.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")).join(sized(wanted), "row").select("fp", "text"), "texts")
        return saved(verified_pairs(pairs, texts, words, similarity), "links")

    one = nodes.groupBy("mark").agg(F.min("fp").alias("a"))
    equal = nodes.join(one, "mark").where("a <> fp").select("a", F.col("fp").alias("b"))
    ring = close_pairs(one.select(F.col("mark").alias("fp")), max_bits)
    for c in ("a", "b"):
        ring = ring.join(one.select(F.col("mark").alias(c), F.col("a").alias(f"node_{c}")), c)
    near = saved(equal.unionByName(ring.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))), "near")
    in_pairs = groups.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    features = saved(features.join(in_pairs, "fp"), "features")
    links = verified(filtered_pairs(near, features, similarity))

    def still_open(pairs: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "fp")
        for c in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        return pairs.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b").distinct()

    stars = star_pairs(groups.where("prev IS NOT NULL"), ["token", "prev"], similarity).unionByName(star_pairs(groups, ["token"], similarity))
    links = links.unionByName(verified(filtered_pairs(still_open(stars), features, similarity)))
    for turn in range(TURNS):
        roots = components(links).withColumnRenamed("node", "fp")
        links = links.unionByName(verified(filtered_pairs(open_stars(groups, roots, similarity, turn), features, similarity)))
    roots = components(links).withColumnRenamed("node", "fp")
    links = links.unionByName(verified(filtered_pairs(open_pairs(groups, roots, similarity), features, similarity)))
    roots = components(links).withColumnRenamed("node", "fp")
    member = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    stays = member.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.row").alias("kept"))
    dropped = saved(prints.join(member.select("fp", "root"), "fp").join(stays, "root").where("row <> kept").select("row"), "dropped")
    return without(marked, row, dropped).select(*[F.col(f"`{c}`") for c in columns])


def without(df: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """df without the rows whose key is in the written table rows (row)."""
    return df.join(sized(rows.withColumnRenamed("row", key)), key, "left_anti")
