"""The evidence graph: nodes, edges, expansion and path scores, as joins.

Nodes are (doc_id, label, id), edges (doc_id, src, dst, edge_type, weight, descr).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.store import stored

# Weights of edge types, of relations in paths, and the limits of expansion.
CO_WEIGHT, SEMANTIC_WEIGHT = 0.5, 1.0
TYPE_WEIGHTS = {"SEMANTIC": 1.0, "CO_EVIDENCE": 0.5}
RELATION_WEIGHTS = {"REQUIRES": 1.0, "CAUSES": 0.95, "RESOLVED_BY": 0.95, "AFFECTS": 0.85, "NEXT_STEP": 0.8, "RELATED_TO": 0.4}
UNKNOWN_RELATION, HOP_DECAY, BONUS = 0.3, 0.3, 0.15
NEIGHBOURS, EXPANDED, MAX_HOPS = 20, 8, 2
TEXT_MOST = 2000
#: Chunks of a document that are dealt to one block of pairs, on average.
PAIR_BLOCK = 2048
#: The same where pairs are only summed up, and rows (fewer than 256) and columns of pairs that are held at once.
SUM_BLOCK, PAIRS_AT_ONCE = 1 << 15, (1 << 7, 1 << 10)


def graph_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """Nodes of labelled chunk tables (doc_id, id, text): text cut, one node for each label and id."""
    out = None
    for label, df in tables.items():
        one = df.select("doc_id", F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), F.left("text", F.lit(TEXT_MOST)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("label", "id").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))


def hierarchy_edges(chunks: DataFrame, parent: str, child: str, edge_type: str) -> DataFrame:
    return chunks.select("doc_id", F.col(parent).alias("src"), F.col(child).alias("dst"), F.lit(edge_type).alias("edge_type")).distinct()


def question_edges(evidence: DataFrame) -> DataFrame:
    """evidence (doc_id, question_id, chunk_id): ANSWERS edges."""
    return evidence.select("doc_id", F.col("question_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("ANSWERS").alias("edge_type"), F.lit(CO_WEIGHT).alias("weight")).distinct()


def co_evidence_classes(evidence: DataFrame) -> DataFrame:
    """evidence (doc_id, question_id, chunk_id): a row for each question with the number of its chunks and of the links between them. With the evidence itself, this is
    the co-evidence graph in linear size: the chunks of a question are all linked with each other."""
    n = evidence.select("doc_id", "question_id", "chunk_id").distinct().groupBy("doc_id", "question_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return n.withColumn("n_links", F.col("n_chunks") * (F.col("n_chunks") - 1))


def co_evidence_edges(evidence: DataFrame) -> DataFrame:
    """All links written out, both directions: the square of a question's chunks. Expansion goes by the questions instead (co_neighbours)."""
    e = evidence.select("doc_id", "question_id", "chunk_id").distinct()
    a, b = e.withColumnRenamed("chunk_id", "src"), e.withColumnRenamed("chunk_id", "dst")
    pairs = a.join(b, ["doc_id", "question_id"]).where("src <> dst").select("doc_id", "src", "dst").distinct()
    return pairs.withColumn("edge_type", F.lit("CO_EVIDENCE")).withColumn("weight", F.lit(CO_WEIGHT))


def co_neighbours(frontier: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """Of each chunk of frontier (src) its first `most` partners by id: (src, dst, edge_type, weight). They are among the first `most` + 1 chunks of its
    questions, so a question hands on no more, whatever it has."""
    e = evidence.select("doc_id", "question_id", "chunk_id").distinct()
    asked = e.join(frontier.select(F.col("src").alias("chunk_id")).distinct(), "chunk_id").select("doc_id", "question_id", F.col("chunk_id").alias("src"))
    members = e.join(asked.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_semi")
    within = Window.partitionBy("doc_id", "question_id").orderBy("chunk_id")
    first = members.withColumn("n", F.row_number().over(within)).where(F.col("n") <= most + 1).select("doc_id", "question_id", F.col("chunk_id").alias("dst"))
    pairs = asked.join(first, ["doc_id", "question_id"]).where("src <> dst").select("src", "dst").distinct()
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= most).select("src", "dst", F.lit("CO_EVIDENCE").alias("edge_type"), F.lit(CO_WEIGHT).alias("weight"))


def semantic_edges(confirmed: DataFrame) -> DataFrame:
    """confirmed (doc_id, src, dst, descr): one edge for each pair, with the least description."""
    return confirmed.groupBy("doc_id", "src", "dst").agg(F.min("descr").alias("descr")).withColumn("edge_type", F.lit("SEMANTIC")).withColumn("weight", F.lit(SEMANTIC_WEIGHT))


def section_pairs(chunks: DataFrame) -> DataFrame:
    """Unordered pairs of chunks (doc_id, big, chunk_id) of one document and different big chunks.

    A document's chunks are dealt to blocks of about PAIR_BLOCK, and every two of its blocks meet once, so its pairs are shared by many tasks, each of which holds one block.
    The number of partitions is given, as that of the bytes that are dealt says nothing of the pairs."""
    blocks = chunks.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    dealt = chunks.select("doc_id", "big", "chunk_id").join(blocks, "doc_id").withColumn("own", F.expr("cast(pmod(xxhash64(chunk_id), blocks) as int)"))
    dealt = stored(dealt, "sections")
    tasks, key = 4 * chunks.sparkSession.sparkContext.defaultParallelism, ["doc_id", "i", "j"]
    a = dealt.select("doc_id", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), F.col("big").alias("big_a"), F.col("chunk_id").alias("x"))
    b = dealt.select("doc_id", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("big").alias("big_b"), F.col("chunk_id").alias("y"))
    met = a.repartition(tasks, *key).hint("merge").join(b.repartition(tasks, *key), key).where("big_a <> big_b AND x <> y AND (i < j OR x < y)")
    return met.select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pair_sums(chunks: DataFrame, processed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (doc_id, n_pairs, sum_a, sum_b): the number of section_pairs of each document and the sums of their lesser and greater ids, which are integers.

    `processed` says which of the pairs (a, b) are done, the lesser ids first, of arrays that are broadcast; these are left out. Every two blocks of a document meet once, in
    one of many tasks; there each pair is compared, PAIRS_AT_ONCE at a time, and no pair leaves it, so only chunks are dealt, each to as many tasks as its document has blocks."""
    c = chunks.select("doc_id", F.col("big").cast("string").alias("big"), F.col("chunk_id").cast("long").alias("chunk_id")).where("doc_id IS NOT NULL AND big IS NOT NULL AND chunk_id IS NOT NULL")
    blocks = c.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / SUM_BLOCK).cast("int").alias("blocks"))
    dealt = stored(c.join(blocks, "doc_id").withColumn("own", F.expr("cast(pmod(xxhash64(chunk_id), blocks) as int)")), "sections")
    met = blocks.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1
    tasks, key = int(min(met, 16 * chunks.sparkSession.sparkContext.defaultParallelism)), ["doc_id", "i", "j"]
    a = dealt.select("doc_id", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), F.col("big").alias("big_a"), F.col("chunk_id").alias("x"))
    b = dealt.select("doc_id", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("big").alias("big_b"), F.col("chunk_id").alias("y"))

    def fold(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(3, dtype=np.int64)  # pairs, lesser ids, greater ids
        left, right, own = left.sort_by("x"), right.sort_by("y"), key[1].as_py() == key[2].as_py()
        codes = pa.chunked_array([*left.column("big_a").chunks, *right.column("big_b").chunks], pa.string()).combine_chunks().dictionary_encode()
        codes = codes.indices.to_numpy().astype(np.uint8 if len(codes.dictionary) < 256 else np.int32)
        big_x, big_y, x, y = codes[: len(left), None], codes[len(left) :], left.column("x").to_numpy()[:, None], right.column("y").to_numpy()
        rows, columns = PAIRS_AT_ONCE
        for at in range(0, len(x), rows):
            mine, big = x[at : at + rows], big_x[at : at + rows]
            lo, hi = int(np.searchsorted(y, mine[0, 0], "left")), int(np.searchsorted(y, mine[-1, 0], "right"))  # before and after these the order of all pairs is known
            for begin, end, mixed in ((0 if not own else lo, lo, False), (lo, hi, True), (hi, len(y), False)):
                for c in range(begin, end, columns):
                    of = slice(c, min(c + columns, end))
                    kept, yours = big != big_y[of], y[of]
                    one, two = (np.minimum(mine, yours), np.maximum(mine, yours)) if mixed else (mine, yours) if c >= hi else (yours, mine)
                    if mixed:
                        kept &= mine < yours if own else mine != yours
                    if processed is not None:
                        kept &= ~processed(one, two)
                    if mixed:
                        total += np.count_nonzero(kept), (one * kept).sum(), (two * kept).sum()
                    else:
                        by_row, by_column = np.count_nonzero(kept, axis=1), kept.sum(axis=0, dtype=np.uint8)
                        sums = [by_row @ mine[:, 0], by_column.astype(np.int64) @ yours]
                        total += by_row.sum(), *(sums if c >= hi else sums[::-1])
        return pa.table([pa.array([key[0].as_py()], key[0].type), *(pa.array([v], pa.int64()) for v in total)], ["doc_id", "n_pairs", "sum_a", "sum_b"])

    parts = a.repartition(tasks, *key).groupBy(*key).cogroup(b.repartition(tasks, *key).groupBy(*key))
    doc_type = c.schema["doc_id"].dataType.simpleString()
    found = parts.applyInArrow(fold, f"doc_id {doc_type}, n_pairs long, sum_a long, sum_b long")
    return found.groupBy("doc_id").agg(*[F.sum(v).alias(v) for v in ("n_pairs", "sum_a", "sum_b")]).where("n_pairs > 0")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def pair_sample(chunks: DataFrame, most: int = 3000, seed: int = 42) -> DataFrame:
    """chunks (doc_id, big, chunk_id): `most` pairs of each document, or all it has, as section_pairs makes them, but only these are made.

    Pairs are numbered: chunks stand in order of section and id, and each is paired with all of later sections. The numbers are cut into `most` equal runs
    and one of each is drawn by hash; it is turned back into two places by the running number of pairs. A null section is one of its own."""
    own = Window.partitionBy("doc_id").orderBy("big", "chunk_id")
    c = chunks.select("doc_id", F.coalesce(F.col("big").cast("string"), F.lit("")).alias("big"), "chunk_id").distinct()
    c = c.withColumn("pos", F.row_number().over(own) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    later = F.col("n") - F.max("pos").over(Window.partitionBy("doc_id", "big")) - 1  # chunks of later sections
    c = stored(c.withColumn("later", later).withColumn("start", F.sum("later").over(Window.partitionBy("doc_id").orderBy("pos")) - F.col("later")), "places")
    totals = c.groupBy("doc_id").agg(F.sum("later").alias("pairs"))
    bound = lambda i: F.expr(f"({i}) * (pairs div {most}) + least({i}, pairs % {most})")
    few = totals.where("pairs > 0").select("doc_id", "pairs", F.explode(F.sequence(F.lit(0), F.least(F.col("pairs"), F.lit(most)).cast("int") - 1)).alias("i"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), "i", F.lit(seed))), 1, 12), 16, 10).cast("long")
    drawn = few.select("doc_id", F.when(F.col("pairs") <= most, F.col("i")).otherwise(bound("i") + F.pmod(draw, bound("i + 1") - bound("i"))).cast("long").alias("number"))
    # each number goes to the last chunk that starts at or before it
    at = c.where("later > 0").select("doc_id", F.col("start").alias("number"), F.lit(0).alias("asks"), F.struct("chunk_id", "start", (F.col("n") - F.col("later")).alias("first")).alias("chunk"))
    both = at.unionByName(drawn.select("doc_id", "number", F.lit(1).alias("asks"), F.lit(None).cast(at.schema["chunk"].dataType).alias("chunk")))
    w = Window.partitionBy("doc_id").orderBy("number", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("chunk", F.last("chunk", ignorenulls=True).over(w)).where("asks = 1").select("doc_id", F.col("chunk.chunk_id").alias("x"), (F.col("chunk.first") + F.col("number") - F.col("chunk.start")).alias("pos"))
    return found.join(c.select("doc_id", "pos", F.col("chunk_id").alias("y")), ["doc_id", "pos"]).select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def unprocessed_pairs(pairs: DataFrame, processed: DataFrame) -> DataFrame:
    return pairs.withColumn("key", pair_key(F.col("a"), F.col("b"))).join(processed.select(pair_key(F.col("a"), F.col("b")).alias("key")), "key", "left_anti").drop("key")


def neighbours(frontier: DataFrame, edges: DataFrame, most: int = NEIGHBOURS, evidence: DataFrame | None = None) -> DataFrame:
    """Out-neighbours of frontier (…, src) by edge type, the `most` heaviest of each; ties by id. Co-evidence comes with the edges, or from evidence."""
    w = Window.partitionBy("src", "edge_type").orderBy(F.desc("weight"), "dst")
    top = edges.select("src", "dst", "edge_type", F.coalesce("weight", F.lit(0.5)).alias("weight")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
    if evidence is not None:
        top = top.unionByName(co_neighbours(frontier, evidence, most))
    return frontier.join(top, "src")


def expand_hits(seeds: DataFrame, edges: DataFrame, limit: int = EXPANDED, evidence: DataFrame | None = None) -> DataFrame:
    """One hop from seeds (query_id, chunk_id, score): the best score of each new neighbour, at most `limit` a query. Co-evidence comes with
    the edges, or from evidence."""
    start = seeds.select("query_id", F.col("chunk_id").alias("src"), F.coalesce("score", F.lit(1.0)).alias("seed_score"))
    weight = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(v)) for k, v in TYPE_WEIGHTS.items()])
    only = edges.where(F.col("edge_type").isin(*TYPE_WEIGHTS))
    wanted = only.join(start.select("src").distinct(), "src", "left_semi")
    found = neighbours(start, wanted, evidence=evidence).withColumn("graph_score", F.col("weight") * F.col("seed_score") * weight)
    best = found.groupBy("query_id", F.col("dst").alias("chunk_id")).agg(
        F.max("graph_score").alias("graph_score"), F.min_by(F.struct("edge_type", F.col("src").alias("seed_chunk")), F.struct(-F.round("graph_score", 9), F.col("src"), F.col("edge_type"))).alias("by")
    )
    new = best.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.round("graph_score", 9).desc(), "chunk_id")
    return new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank", "graph_score", "by.edge_type", "by.seed_chunk")


def bfs_paths(seeds: DataFrame, relations: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """seeds (query_id, node); relations (src, dst, rel_type). All edges out of each frontier with their hop; only unseen targets go on."""
    frontier = seeds.select("query_id", "node").distinct()
    visited, out = frontier, None
    for hop in range(1, max_hops + 1):
        step = frontier.join(relations, frontier.node == F.col("src")).select("query_id", "src", "dst", "rel_type", F.lit(hop).alias("hops")).distinct()
        if hop < max_hops:
            step = step.checkpoint()
        out = step if out is None else out.unionByName(step)
        frontier = step.select("query_id", F.col("dst").alias("node")).distinct().join(visited, ["query_id", "node"], "left_anti")
        visited = visited.unionByName(frontier)
    return out


def path_score(relation: Column, hops: Column, bonus: float = BONUS) -> Column:
    weight = F.coalesce(*[F.when(relation == k, F.lit(v)) for k, v in RELATION_WEIGHTS.items()], F.lit(UNKNOWN_RELATION))
    return weight / (1.0 + HOP_DECAY * (hops - 1)) * bonus


def point_expansion(seeds: DataFrame, grounded: DataFrame, relations: DataFrame, seed_count: int = 3, limit: int = EXPANDED, global_best: bool = False) -> DataFrame:
    """Seeds (query_id, chunk_id, rank) to points, to points in reach, back to chunks (grounded: point, chunk_id). The
    score is the best of the paths that lead to the chunk, or of all the query's paths."""
    first = seeds.where(F.col("rank") <= seed_count).select("query_id", "chunk_id")
    points = first.join(grounded, "chunk_id").select("query_id", F.col("point").alias("node")).distinct()
    paths = bfs_paths(points, relations).join(points.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_anti").withColumn("score", path_score(F.col("rel_type"), F.col("hops")))
    if global_best:
        paths = paths.withColumn("score", F.max("score").over(Window.partitionBy("query_id")))
    chunks = paths.join(grounded, F.col("dst") == F.col("point")).groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), 4).alias("graph_score"))
    new = chunks.join(first, ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("graph_score"), "chunk_id")
    return new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def point_links(points: DataFrame) -> DataFrame:
    """points (point, chunk_id), or (point, source_chunk_ids): MENTIONS from chunk to point and GROUNDED_IN back."""
    rows = points if "chunk_id" in points.columns else points.select("point", F.explode("source_chunk_ids").alias("chunk_id"))
    pairs = rows.select("point", "chunk_id").distinct()
    there = pairs.select(F.col("chunk_id").cast("string").alias("src"), F.col("point").cast("string").alias("dst"), F.lit("MENTIONS").alias("edge_type"))
    return there.unionByName(pairs.select(F.col("point").cast("string").alias("src"), F.col("chunk_id").cast("string").alias("dst"), F.lit("GROUNDED_IN").alias("edge_type")))


def parse_extraction(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies (pair_id, chunk_ids, reply JSON): points with global ids, and relations of which both ends are known. Both are joined by merging,
    as they grow with the replies and their size is not known beforehand."""
    shape = "points array<struct<id:string,type:string,label:string,description:string>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"
    parsed = replies.withColumn("r", F.from_json("reply", shape))
    points = parsed.select("pair_id", "chunk_ids", F.inline("r.points")).select(
        F.concat_ws("_", "pair_id", "id").alias("point"), "pair_id", F.col("id").alias("local_id"), "type", "label", "description", F.col("chunk_ids").alias("source_chunk_ids")
    ).where("local_id IS NOT NULL").dropDuplicates(["point"])
    rel = parsed.select("pair_id", F.inline("r.relations"))
    known = points.select("pair_id", F.col("local_id"), "point")
    ends = rel.join(known.select("pair_id", F.col("local_id").alias("source"), F.col("point").alias("src")).hint("merge"), ["pair_id", "source"]).join(
        known.select("pair_id", F.col("local_id").alias("target"), F.col("point").alias("dst")).hint("merge"), ["pair_id", "target"]
    )
    return points.drop("local_id"), ends.select("src", "dst", F.col("type").alias("rel_type"), "confidence")


def two_hop_evidence(evidence: DataFrame) -> DataFrame:
    """Chunk to question to another chunk: (doc_id, src, via, dst)."""
    a = evidence.select("doc_id", F.col("chunk_id").alias("src"), F.col("question_id").alias("via"))
    b = evidence.select("doc_id", F.col("chunk_id").alias("dst"), F.col("question_id").alias("via"))
    return a.join(b, ["doc_id", "via"]).where("src <> dst").select("doc_id", "src", "via", "dst").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", F.concat(F.lit("node:"), "label").alias("what")).count().unionByName(edges.groupBy("doc_id", F.concat(F.lit("edge:"), "edge_type").alias("what")).count()).withColumnRenamed("count", "n")


def drop_manual(table: DataFrame, doc_id) -> DataFrame:
    return table.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def graph_integrity(nodes: DataFrame, small_chunks: DataFrame) -> DataFrame:
    """Per document: one manual node, some small nodes, and as many as its chunk table has."""
    have = nodes.groupBy("doc_id").agg(F.count_if(F.col("label") == "Manual").alias("manuals"), F.count_if(F.col("label") == "Small").alias("smalls"))
    want = small_chunks.groupBy("doc_id").agg(F.countDistinct("id").alias("chunks"))
    joined = want.join(have, "doc_id", "full")
    held = {"one_manual": F.col("manuals") == 1, "has_small": F.col("smalls") > 0, "counts_agree": F.coalesce("smalls", F.lit(0)) == F.coalesce("chunks", F.lit(0))}
    return joined.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in held.items()])
