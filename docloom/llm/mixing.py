"""Mixing sources to target weights.

Targets: a total (a share of all words) is divided among the sources by weight;
no source gets more than `epochs` times its words, and what is above goes to the
others by weight, until none is above.

Drawing: a source's documents are dealt to blocks by a hash of their content. The
blocks stand in a permuted order of the source. Whole rounds take every
block; the rest of the target takes the blocks that fit, in order, and then, one
by one, documents of the other blocks that fit, as many as can fill it; the last few are chosen so that their sum comes nearest
to what is left, above or below. So every source has a
quota of block draws. A splitting tree deals the quotas to output shards:
each node divides its quotas among its two halves by a multivariate
hypergeometric draw, so leaves have exact, disjoint quotas, filled with the permuted
blocks in turn. There is a shard for each SHARD_WORDS words of the mix, 16 at least and `max_blocks` / 8 at most; beyond, a
shard is dealt over several partitions. Within a partition, a shard's rows are ordered by a hash.

What the driver holds: one row per source (over `max_sources` of them are refused with a ValueError: sources are collections, no hosts or
authors), and one per block (at most `max_blocks` plus one for each source). Single documents drawn are broadcast only if few.

Defined cases: a null text has size 0; null is a source of its own and stands
last; documents of size 0 are drawn with their block at no cost; equal rows (same id, same text) are
drawn alike; a null id is allowed; a very long document is drawn whole or not at all; documents with one hash stand in the order of their blocks; the last words of a source's target are sought in one task, among some LAST_DOCS documents; an empty table gives an empty result; all
columns of the input are kept in mixed(), and the operator's own columns
replace any of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WORD, saved, sized

WEIGHTS = (5, 2, 1)
#: Documents beyond the whole blocks, of each source, at least, among which the last words are sought.
LAST_DOCS = 4_000
#: Documents at least that are not drawn with their block, where a source has as many.
LEAST_DOCS = 64
#: Words of the mix in a shard, about.
SHARD_WORDS = 2_000_000
#: Documents among which an exact sum is sought, at the very end of a source's target.
REFINE = 256


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> list[float]:
    """Words wanted of each source; weights repeat."""
    want, left = [0.0] * len(sizes), share * sum(sizes)
    weigh = {i: weights[i % len(weights)] for i in range(len(sizes)) if sizes[i] > 0}
    while weigh:
        unit = left / sum(weigh.values())
        above = [i for i, w in weigh.items() if unit * w > epochs * sizes[i]]
        for i in above or weigh:
            want[i] = epochs * sizes[i] if above else unit * weigh[i]
        if not above:
            break
        for i in above:
            left -= want[i]
            del weigh[i]
    return want


def _order(*key: object) -> bytes:
    return hashlib.blake2b("/".join(map(str, key)).encode(), digest_size=8).digest()


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows: shards; columns: sources. Each node of the tree divides its quotas hypergeometrically."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid, total = (lo + hi) // 2, int(quota.sum())
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, total * (mid - lo) // (hi - lo), method="marginals") if total else quota
        node(lo, mid, draw)
        node(mid, hi, quota - draw)

    node(0, shards, quotas.astype(np.int64))
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"),
    )


def _last(rows: list[tuple[int, int]], room: int) -> list[int]:
    """Keys of the rows taken: all that fit, in order; then the set of the last few of these and the first REFINE
    others whose sizes add up nearest to what is left, of two as near the lesser."""
    taken, others = [], []
    for r in rows:
        if r[1] <= room:
            taken.append(r)
            room -= r[1]
        else:
            others.append(r)
    back = taken[-REFINE // 16 :]
    taken = taken[: len(taken) - len(back)]
    room += sum(n for _, n in back)
    pool = [r for r in back if r[1]] + [r for r in others if r[1] <= 2 * room][:REFINE]
    taken += [r for r in back if not r[1]]
    sums, steps = 1, []
    for _, n in pool:  # bit s of sums: s can be reached
        steps.append(sums)
        sums |= (sums << n) & ((1 << (2 * room + 1)) - 1)
    best = (sums & ((1 << (room + 1)) - 1)).bit_length() - 1
    if above := sums >> (room + 1):
        over = room + (above & -above).bit_length()
        best = over if over - room < room - best else best
    for (key, n), before in zip(reversed(pool), reversed(steps), strict=True):
        if not before >> best & 1:
            taken.append((key, n))
            best -= n
    return [key for key, _ in taken]


def plan(docs: DataFrame, weights=WEIGHTS, share=1.5, epochs=2.0, shards=None, seed=17, max_blocks=1 << 16, max_sources=100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: sources (src, sid, blocks, source_size, target, shards), block draws (sid, block, draws: shard
    and round of each), both of bounded size, and single documents drawn (sid, rk, shard, round)."""
    spark: SparkSession = docs.sparkSession
    by_source = docs.groupBy("src").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    found = [(r["src"], r["n"], r["docs"]) for r in by_source.limit(max_sources + 1).collect()]
    if len(found) > max_sources:
        raise ValueError(f"over {max_sources} sources: give coarser ones or raise max_sources")
    found.sort(key=lambda r: (r[0] is None, r[0] if r[0] is None else str(r[0]).encode("utf-32-be")))
    sizes = [n for _, n, _ in found]
    want = targets(sizes, weights, share, epochs)
    total = max(1, sum(sizes))
    shards = shards or min(max(16, round(sum(want) / SHARD_WORDS)), max(16, max_blocks // 8))
    blocks = [max(1, min(held // 4, round(max_blocks * n / total))) for _, n, held in found]
    src_type = docs.schema["src"].dataType.simpleString()
    sources = spark.createDataFrame(
        [(s, i, blocks[i], sizes[i], want[i], shards) for i, (s, _, _) in enumerate(found)], f"src {src_type}, sid int, blocks int, source_size long, target double, shards int"
    )
    dealt = in_blocks(docs, sources, seed)
    words: list[dict[int, tuple[int, int]]] = [{} for _ in found]
    for r in dealt.groupBy("sid", "block").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).toLocalIterator():
        words[r["sid"]][r["block"]] = (r["n"], r["docs"])

    units: list[list[tuple[int, int]]] = []
    edges: list[tuple[int, int, list[int]]] = []  # sid, room, blocks not taken, in order
    for i, w in enumerate(words):
        rounds = int(want[i] // sizes[i]) if sizes[i] else 0
        mine = [(b, e) for e in range(rounds) for b in sorted(w, key=lambda b: _order(seed, i, e, b))]
        room, n_back = round(want[i] - rounds * sizes[i]), 0
        ordered = sorted(w, key=lambda b: _order(seed, i, rounds, b)) if room > 0 else []
        taken, left, back = [], [], []
        for b in ordered:
            if w[b][0] <= room:
                taken.append(b)
                room -= w[b][0]
            else:
                left.append(b)
        while taken and n_back < LEAST_DOCS:  # the edge gets some blocks back, to have documents to choose from
            back.insert(0, taken.pop())
            room += w[back[0]][0]
            n_back += w[back[0]][1]
        mine += [(b, rounds) for b in taken]
        edges.append((i, room, back + left))
        units.append(mine)
    quotas = split_quotas(np.array([len(u) for u in units], dtype=np.int64), shards, seed) if units else np.zeros((shards, 0), dtype=np.int64)
    draws: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, mine in enumerate(units):
        shard_of = np.repeat(np.arange(shards), quotas[:, i])
        for (b, e), s in zip(mine, shard_of.tolist(), strict=True):
            draws.setdefault((i, b), []).append((int(s), e))
    block_draws = spark.createDataFrame([(i, b, d) for (i, b), d in sorted(draws.items())], "sid int, block int, draws array<struct<shard:int,round:int>>")

    room_of = {i: room for i, room, _ in edges}
    rooms = F.broadcast(spark.createDataFrame(sorted(room_of.items()), "sid int, room long"))
    fitting = dealt.join(rooms, "sid").where("size <= room")
    fits = {(r["sid"], r["block"]): (r["n"], r["docs"]) for r in fitting.groupBy("sid", "block").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).toLocalIterator()}
    rest: list[tuple[int, int, int]] = []  # sid, block, place in order: until their fitting documents can fill the room
    for i, room, open_blocks in edges:
        found_words = n_docs = 0
        for place, b in enumerate(open_blocks):
            if found_words >= room and n_docs >= LAST_DOCS:
                break
            n, d = fits.get((i, b), (0, 0))
            if d:
                rest.append((i, b, place))
                found_words, n_docs = found_words + n, n_docs + d
    round_of = {i: int(want[i] // sizes[i]) for i in room_of}

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        i = key[0].as_py()
        t = t.sort_by([("place", "ascending"), ("turn", "ascending"), ("rk", "ascending")])
        taken = _last(list(zip(t.column("rk").to_pylist(), t.column("size").to_pylist(), strict=True)), room_of[i])
        return pa.table({"sid": pa.array([i] * len(taken), pa.int32()), "rk": pa.array(taken, pa.int64())})

    edge = spark.createDataFrame(rest, "sid int, block int, place int")
    open_ = spark.createDataFrame([(i, b) for i, _, more in edges for b in more], "sid int, block int")
    above = dealt.join(rooms, "sid").where("size > room and size < 2 * room").join(F.broadcast(open_), ["sid", "block"])
    least_above = above.groupBy("sid").agg(F.min(F.struct("size", "rk")).alias("least")).selectExpr("sid", f"{len(rest)} as place", "least.rk as rk", "0L as turn", "least.size as size")
    at_edge = fitting.join(F.broadcast(edge), ["sid", "block"]).withColumn("turn", F.xxhash64(F.lit(seed), "rk"))
    alike = at_edge.groupBy("sid", "place", "rk", "turn").agg(F.sum("size").alias("size")).unionByName(least_above)
    rounds = spark.createDataFrame(sorted(round_of.items()), "sid int, round int")
    singles = saved(alike.groupBy("sid").applyInArrow(fill, "sid int, rk long"), "singles")
    singles = singles.join(F.broadcast(rounds), "sid").select("sid", "rk", F.pmod(F.xxhash64(F.lit(seed + 1), "rk"), F.lit(shards)).cast("int").alias("shard"), "round")
    return sources, block_draws, singles


def in_blocks(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    return sized.join(F.broadcast(sources.select(F.col("src").alias("src_"), "sid", "blocks")), F.col("src").eqNullSafe(F.col("src_"))).select(
        "*", F.expr(f"cast(pmod(xxhash64({seed}, rk), blocks) as int)").alias("block")
    ).drop("src_", "blocks")


def with_draws(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (as _sized makes them) with source_size, target and draws (shard and round of each time that the mix takes the row)."""
    seed = how.get("seed", 17)
    sources, blocks, singles = plan(docs, **how)
    one = sized(saved(singles.groupBy("sid", "rk").agg(F.collect_list(F.struct("shard", "round")).alias("more")), "one"))
    none = F.expr("cast(array() as array<struct<shard:int,round:int>>)")
    return (
        in_blocks(docs, sources, seed)
        .join(F.broadcast(sources.select("sid", "source_size", "target")), "sid")
        .join(F.broadcast(blocks), ["sid", "block"], "left")
        .join(one, ["sid", "rk"], "left")
        .withColumn("draws", F.concat(F.coalesce("draws", none), F.coalesce("more", none)))
        .drop("more", "sid", "block")
    )


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    return with_draws(saved(_sized(docs, id_col, text_col, source_col), "sized"), **how).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mix itself: docs' rows as often as they are drawn, with columns mix_shard and mix_round, a shard's rows
    in one partition (in several beyond SHARD_WORDS words) and locally shuffled."""
    own = {"mix_shard", "mix_round"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    known = saved(_sized(docs, id_col, text_col, source_col), "sized")
    seed = how.get("seed", 17)
    sources, blocks, singles = plan(known, **how)
    singles = sized(saved(singles, "singles"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("src"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"))
    placed = in_blocks(rows, sources, seed)
    whole = placed.join(F.broadcast(blocks), ["sid", "block"]).select("doc", "rk", F.inline("draws").alias("mix_shard", "mix_round"))
    extra = placed.join(singles, ["sid", "rk"]).selectExpr("doc", "rk", "shard as mix_shard", "round as mix_round")
    out = whole.unionByName(extra).withColumn("turn", F.xxhash64(F.lit(seed + 2), "rk", "mix_round"))
    words, shards = sources.agg(F.sum("target"), F.max("shards")).first()
    slices = max(1, round((words or 0) / SHARD_WORDS / max(1, shards or 1)))
    out = out.withColumn("slice", F.pmod("turn", F.lit(slices)))
    return out.repartition("mix_shard", "slice").sortWithinPartitions("mix_shard", "turn", "rk").select("doc.*", "mix_shard", "mix_round")
