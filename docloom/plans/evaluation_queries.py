"""Queries of evaluation, contexts, conversations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import chat as C
from docloom.operators import context as K
from docloom.operators import evaluation as A
from docloom.plans.fixtures import TURNS
from docloom.plans.graph_queries import contained
from docloom.plans.registry import Tables, query
from docloom.plans.retrieval_queries import BM25, RERANKED, asked, bm25_hits, dense_hits, index, outer_scores
from docloom.operators import retrieval as R
from docloom.store import stored

GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id, lang FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def gold(t: Tables) -> DataFrame:
    return contained(t).select(F.col("ref_id").alias("query_id"), F.col("doc_id").alias("chunk_id")).distinct()


@query(
    """WITH s AS (SELECT source, length(text) // 2 AS v, row_number() OVER (PARTITION BY source ORDER BY length(text) // 2) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, max(n) AS n, min(v) AS least, max(v) AS most, round(avg(v), 2) AS mean, max(v) FILTER (k = n // 2) AS p50, max(v) FILTER (k = floor((n - 1) * 0.9)::BIGINT) AS p90 FROM s GROUP BY source"""
)
def token_stats(t: Tables) -> DataFrame:
    return A.token_stats(t.documents.withColumn("tokens", F.expr("length(text) div 2")), "source", "tokens")


@query("SELECT source AS manual, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, count(DISTINCT lang) AS n_langs, count(l.doc_id) AS n_labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def manual_manifest(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id", F.lit(1).alias("x")), "doc_id", "left").groupBy(F.col("source").alias("manual")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("lang").alias("n_langs"), F.count("x").alias("n_labelled")
    )


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(*) < 5 AS anomaly FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_totals(t: Tables) -> DataFrame:
    return t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")).withColumn("anomaly", F.col("n") < 5)


HIT = "round(100 * avg((coalesce(best, 99) <= {k})::INT), 2) AS hit_at_{k}"


@query(
    f"""WITH {BM25}, {GOLD}, b AS (SELECT g.query_id, min(rank) AS best FROM gold g LEFT JOIN bm25 h ON h.query_id = g.query_id AND h.chunk_id = g.chunk_id GROUP BY 1)
    SELECT count(*) AS questions, {', '.join(HIT.format(k=k) for k in (5, 10, 20))} FROM b"""
)
def hit_at_k(t: Tables) -> DataFrame:
    return A.hit_at_k(gold(t), bm25_hits(t))


@query(f"WITH {GOLD} SELECT item_id AS query_id, item_id IN (SELECT query_id FROM gold) AS mapped FROM benchmark")
def mapped_questions(t: Tables) -> DataFrame:
    return A.mapped_questions(t.benchmark.select(F.col("item_id").alias("query_id")), gold(t))


@query(
    f"""WITH {BM25}, {GOLD}, x AS (SELECT g.query_id, bool_or(h.rank <= 5) AS a, bool_or(h.rank <= 1) AS b FROM gold g LEFT JOIN bm25 h ON h.query_id = g.query_id AND h.chunk_id = g.chunk_id GROUP BY 1)
    SELECT count(*) FILTER (a) AS hits_a, count(*) FILTER (b) AS hits_b, count(*) FILTER (a AND NOT coalesce(b, false)) AS only_a, count(*) FILTER (b AND NOT coalesce(a, false)) AS only_b FROM x"""
)
def ablation_diff(t: Tables) -> DataFrame:
    found = bm25_hits(t)
    return A.ablation_diff(gold(t), found, found.where("rank <= 1"))


@query(f"WITH {BM25}, {GOLD} SELECT h.query_id, h.chunk_id FROM (SELECT query_id, chunk_id FROM bm25) h INTERSECT SELECT query_id, chunk_id FROM gold")
def hit_overlap(t: Tables) -> DataFrame:
    return bm25_hits(t).select("query_id", "chunk_id").intersect(gold(t))


@query(f"WITH {BM25}, {GOLD} SELECT query_id, chunk_id FROM gold EXCEPT SELECT query_id, chunk_id FROM bm25")
def new_chunks(t: Tables) -> DataFrame:
    return missed(gold(t), bm25_hits(t))


def missed(known: DataFrame, found: DataFrame) -> DataFrame:
    return known.join(found, ["query_id", "chunk_id"], "left_anti").distinct()


@query(
    f"""WITH {BM25}, {GOLD}, n AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, chunk_id FROM gold EXCEPT SELECT query_id, chunk_id FROM bm25) GROUP BY 1)
    SELECT round(avg((coalesce(n, 0) > 0)::INT), 6) AS share_gaining, round(avg(coalesce(n, 0)), 6) AS mean_gain FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN n USING (query_id)"""
)
def expansion_effect(t: Tables) -> DataFrame:
    known = stored(gold(t), "gold")
    n = missed(known, bm25_hits(t)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    got = F.coalesce("n", F.lit(0))
    return known.select("query_id").distinct().join(n, "query_id", "left").agg(F.round(F.avg((got > 0).cast("double")), 6).alias("share_gaining"), F.round(F.avg(got), 6).alias("mean_gain"))


@query("SELECT l.toxic AS label, count(*) AS n, round(avg((l.toxic = (lang = 'en')::INT)::INT), 6) AS accuracy FROM labels l JOIN documents USING (doc_id) GROUP BY ROLLUP (l.toxic)")
def class_accuracy(t: Tables) -> DataFrame:
    x = t.labels.join(t.documents, "doc_id").select(F.col("toxic").alias("label"), (F.col("lang") == "en").cast(t.labels.schema["toxic"].dataType).alias("predicted"))
    return A.class_accuracy(x, "label", "predicted")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS ok, bool_and(value >= 0) AS all_ok FROM events GROUP BY event_type")
def check_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.bool_and(F.col("value") >= 0).alias("all_ok"))


@query("SELECT user_id % 4 AS scenario, count(*) AS n, count(*) FILTER (event_type <> 'error') AS passed FROM events GROUP BY 1")
def scenario_summary(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 4).alias("scenario")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("passed"))


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 403 ELSE 404 END::BIGINT AS status, count(*) AS n FROM supplier GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return probes(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def probes(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.concat(F.lit("up"), "s_suppkey").alias("name"), (F.col("s_acctbal") > 0).alias("ok"), F.expr("cast(CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 403 ELSE 404 END as bigint)").alias("status"), (F.col("s_suppkey") / 100).alias("elapsed")
    )


@query(
    """SELECT 'up' || s_suppkey AS name, round(CASE WHEN s_acctbal > 0 THEN 100 + greatest(0, 20 - 5 * s_suppkey / 100) WHEN s_suppkey % 3 = 1 THEN 30 WHEN s_suppkey % 3 = 2 THEN 10 ELSE 0 END, 2)::DOUBLE AS score FROM supplier"""
)
def upstream_scoreboard(t: Tables) -> DataFrame:
    return A.upstream_scoreboard(probes(t)).select("name", "score")


@query("SELECT 'up' || s_suppkey AS name, row_number() OVER (ORDER BY s_suppkey / 100, 'up' || s_suppkey) AS place FROM supplier WHERE s_acctbal > 0")
def usable_upstreams(t: Tables) -> DataFrame:
    return probes(t).where("ok").select("name", F.row_number().over(Window.orderBy("elapsed", "name")).cast("long").alias("place"))


@query("SELECT count(*) AS requests, count(*) FILTER (event_type IN ('click', 'view')) AS hits, count(*) FILTER (event_type NOT IN ('click', 'view')) AS misses, count(*) FILTER (event_type = 'click') AS exact, count(*) FILTER (event_type = 'view') AS semantic FROM events")
def cache_counters(t: Tables) -> DataFrame:
    return A.cache_counters(t.events, F.when(F.col("event_type") == "click", "exact").when(F.col("event_type") == "view", "semantic"))


@query(f"WITH {TURNS} SELECT conv_id, count(*) AS turns, round(avg(length(assistant_message)), 6) AS answer_chars, count(*) FILTER (assistant_message <> '') AS answered FROM turns GROUP BY conv_id")
def dialogue_metrics(t: Tables) -> DataFrame:
    return C.pair_turns(t.conversations).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg(F.length("assistant_message")), 6).alias("answer_chars"), F.count_if(F.col("assistant_message") != "").alias("answered"))


@query("SELECT lang, count(*) AS total, count(l.doc_id) AS done, round(count(l.doc_id) / count(*), 6) AS rate FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def completion_rate(t: Tables) -> DataFrame:
    x = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("done")), "doc_id", "left")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("done"), F.round(F.count("done") / F.count(F.lit(1)), 6).alias("rate"))


@query(f"WITH {TURNS} SELECT conv_id, turn, user_message, assistant_message FROM turns")
def pair_turns(t: Tables) -> DataFrame:
    return C.pair_turns(t.conversations)


PAIR = "'用户: ' || user_message || chr(10) || '客服: ' || assistant_message"


@query(f"WITH {TURNS} SELECT conv_id, string_agg({PAIR}, chr(10) ORDER BY turn) AS transcript FROM turns GROUP BY conv_id")
def format_turns(t: Tables) -> DataFrame:
    from docloom.functions.text import format_turns as f

    pair = F.struct("turn", F.col("user_message").alias("user"), F.col("assistant_message").alias("assistant"))
    return C.pair_turns(t.conversations).groupBy("conv_id").agg(f(F.sort_array(F.collect_list(pair))).alias("transcript"))


@query(f"WITH {TURNS} SELECT conv_id, turn, count(*) OVER w AS n, string_agg({PAIR}, chr(10)) OVER w AS recent FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def sliding_turns(t: Tables) -> DataFrame:
    from docloom.functions.text import format_turns as f

    return C.sliding_turns(C.pair_turns(t.conversations), 3).select("conv_id", "turn", F.size("recent").cast("long").alias("n"), f(F.col("recent")).alias("recent"))


SUMMARY = "sm AS (SELECT DISTINCT conv_id, 'sum ' || conv_id AS summary FROM conversations WHERE conv_id % 2 = 0)"


def summaries(t: Tables) -> DataFrame:
    return t.conversations.where("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("sum "), "conv_id").alias("summary")).distinct()


@query(
    f"""WITH {TURNS}, {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns), g AS (SELECT conv_id, count(*) AS n, string_agg({PAIR}, chr(10) ORDER BY turn) AS txt FROM r WHERE back <= 5 GROUP BY 1)
    SELECT c.conv_id, CASE WHEN n IS NULL THEN '' ELSE CASE WHEN summary IS NULL THEN '' ELSE '历史摘要: ' || summary || chr(10) || chr(10) END || '最近 ' || n || ' 轮对话:' || chr(10) || txt END AS context,
      coalesce(n, 0) AS turns_used, n IS NOT NULL AND summary IS NOT NULL AS summary_used FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id) LEFT JOIN sm USING (conv_id)"""
)
def history_context(t: Tables) -> DataFrame:
    return C.history_context(t.conversations, C.pair_turns(t.conversations), summaries(t))


@query(
    f"""WITH {TURNS}, {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns), g AS (SELECT conv_id, count(*) AS n FROM r WHERE back <= 5 GROUP BY 1)
    SELECT sum(n)::BIGINT AS turns_used, count(*) FILTER (summary IS NOT NULL) AS with_summary FROM g LEFT JOIN sm USING (conv_id)"""
)
def memory_usage_stats(t: Tables) -> DataFrame:
    return history_context(t).agg(F.sum("turns_used").alias("turns_used"), F.count_if("summary_used").alias("with_summary"))


@query(f"WITH {TURNS}, {SUMMARY} SELECT conv_id, count(*) >= 3 AS due, CASE WHEN count(*) >= 3 THEN 'new' ELSE any_value(summary) END AS summary FROM turns LEFT JOIN sm USING (conv_id) GROUP BY conv_id")
def summary_due(t: Tables) -> DataFrame:
    new = t.conversations.select("conv_id", F.lit("new").alias("summary")).distinct()
    return C.summary_due(C.pair_turns(t.conversations), summaries(t), new, trigger=3)


@query(f"WITH {TURNS} SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) >= 3 AS due FROM turns")
def rolling_summary_flag(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return C.pair_turns(t.conversations).select("conv_id", "turn", (F.count(F.lit(1)).over(w) >= 3).alias("due"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 OR item_id % 4 = 0 THEN text ELSE 'rewritten ' || item_id END AS standalone FROM benchmark")
def standalone_query(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.expr("CASE WHEN item_id % 3 = 0 THEN '' ELSE 'h' END").alias("history"))
    r = t.benchmark.select(F.col("item_id").alias("query_id"), F.expr("CASE WHEN item_id % 4 = 0 THEN '  ' ELSE concat(' rewritten ', item_id) END").alias("text"))
    return C.standalone_query(q, r)


BLOCKS = f"""{BM25}, blocks AS (SELECT query_id, rank, '[' || source || '] ' || lang || ' (小块: ' || chunk_id || ')' || chr(10) || '  来源：hybrid' || chr(10) || '  内容：' || chr(10) || text AS block FROM bm25 JOIN documents ON doc_id = chunk_id),
  sized AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS upto, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM blocks)"""


def blocks(t: Tables) -> DataFrame:
    x = bm25_hits(t).join(t.documents, F.col("doc_id") == F.col("chunk_id")).withColumn("src", F.lit("hybrid"))
    return x.select("query_id", "rank", K.format_block("source", "lang", "chunk_id", "text", "src").alias("block"))


@query(
    f"""WITH {BLOCKS}, g AS (SELECT query_id, any_value(n) AS found, count(*) FILTER (upto <= 9000 OR i = 1) AS shown, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (upto <= 9000 OR i = 1) AS c FROM sized GROUP BY 1)
    SELECT query_id, found, shown, md5(c || CASE WHEN shown < found THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || chr(10) || '... (截断，共 ' || found || ' 个结果，仅展示前 ' || shown || ' 个)' ELSE '' END) AS context_md5 FROM g"""
)
def assemble_context(t: Tables) -> DataFrame:
    return K.assemble_context(blocks(t), 3000).select("query_id", "found", "shown", F.md5("context").alias("context_md5"))


@query(f"WITH {BLOCKS} SELECT query_id, rank::BIGINT AS rank, upto::BIGINT AS chars_upto, upto <= 9000 OR i = 1 AS fits FROM sized")
def running_budget(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    upto = F.sum(F.length("block")).over(w)
    return blocks(t).select("query_id", F.col("rank").cast("long").alias("rank"), upto.alias("chars_upto"), ((upto <= 9000) | (F.row_number().over(w) == 1)).alias("fits"))


IMAGES = "unnest(['img' || (chunk_id % 7), 'img' || (chunk_id % 11), 'img' || (chunk_id % 7)])"


@query(
    f"""WITH {BM25}, x AS (SELECT query_id, rank, {IMAGES} AS image, unnest([0, 1, 2]) AS pos FROM bm25), f AS (SELECT query_id, image, min(rank * 10 + pos) AS place FROM x GROUP BY query_id, image)
    SELECT query_id, image_no::BIGINT AS image_no, image FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, image) AS image_no FROM f) WHERE image_no <= 5"""
)
def collect_images(t: Tables) -> DataFrame:
    h = bm25_hits(t).withColumn("images", F.expr("transform(array(chunk_id % 7, chunk_id % 11, chunk_id % 7), x -> concat('img', x))"))
    return K.collect_images(h, 5).withColumn("image_no", F.col("image_no").cast("long"))


@query(f"WITH {BM25} SELECT query_id, string_agg('- doc' || chunk_id, chr(10) ORDER BY rank) AS manifest FROM bm25 WHERE rank <= 3 GROUP BY query_id")
def image_manifest(t: Tables) -> DataFrame:
    return K.image_manifest(bm25_hits(t).where("rank <= 3").select("query_id", F.col("rank").alias("image_no"), F.concat(F.lit("doc"), "chunk_id").alias("image")))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'mid' ELSE 'small' END AS level, CASE WHEN item_id % 3 = 0 THEN 'm' ELSE 's' END || item_id AS content FROM benchmark")
def ensemble_merge(t: Tables) -> DataFrame:
    levels = F.expr("inline(array(struct('big', concat('b', item_id)), struct('mid', concat('m', item_id)), struct('small', CASE WHEN item_id % 3 = 0 THEN ' ' ELSE concat('s', item_id) END)))")
    return K.ensemble_merge(t.benchmark.select(F.col("item_id").alias("query_id"), levels.alias("level", "content")))


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 OR l.doc_id IS NULL OR l.toxic = 0 THEN 'manual' ELSE 'general' END AS route FROM documents d LEFT JOIN labels l USING (doc_id)")
def route_queries(t: Tables) -> DataFrame:
    q = t.documents.select(F.col("doc_id").alias("query_id"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END").alias("n_images"))
    return K.route_queries(q, t.labels.select(F.col("doc_id").alias("query_id"), F.expr("CASE WHEN toxic = 1 THEN 'general' ELSE 'manual' END").alias("label")))


@query(
    """SELECT conv_id, turn, text <> '' AS not_empty, length(text) BETWEEN 10 AND 5000 AS length_ok, contains(text, 'the') AS keyword_found, true AS pics_match, NOT regexp_matches(text, '图片[：:]') AS no_marker,
    NOT regexp_matches(text, '^\\s*[{\\[]') AS no_json FROM conversations WHERE role = 'assistant'"""
)
def sanity_checks(t: Tables) -> DataFrame:
    a = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("content"), F.expr("cast(array() as array<string>)").alias("images"), F.array(F.lit("the")).alias("keywords"))
    return K.sanity_checks(a).drop("content", "images", "keywords", "all_ok")


@query(f"WITH {BM25} SELECT query_id, chunk_id, rank::BIGINT AS rank FROM bm25 WHERE rank <= 3")
def topk_per_query(t: Tables) -> DataFrame:
    return R.bm25_topk(asked(t), index(t), 3).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, source || '_' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR, 4, '0') AS chunk_id FROM documents")
def position_in_parent(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return t.documents.select("doc_id", F.concat_ws("_", "source", F.lpad((F.row_number().over(w) - 1).cast("string"), 4, "0")).alias("chunk_id"))


@query("SELECT md5(text) AS content_hash, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def first_occurrence(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("first_doc"))


@query(f"WITH {BM25} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS ordered FROM bm25 GROUP BY query_id")
def ordered_hits(t: Tables) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"].cast("string"))
    return bm25_hits(t).groupBy("query_id").agg(F.array_join(ids, ",").alias("ordered"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE lang IN ('en', 'fr')) WHERE n <= 50")
def head_by_language(t: Tables) -> DataFrame:
    return R.top_k(t.documents.where("lang IN ('en', 'fr')"), 50, [F.col("doc_id")], key="lang").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20")
def sample_rows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").orderBy("doc_id").limit(20)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 8")
def limit_expanded(t: Tables) -> DataFrame:
    return R.top_k(t.documents.withColumn("score", F.col("n_chars")), 8, key="source", tie="doc_id").select("source", "doc_id")


@query(
    """SELECT doc_id, level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE level WHEN 'small' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END) AS n FROM (
      SELECT doc_id, 'small' AS level FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'mid' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'big' FROM documents)) WHERE n = 1"""
)
def merge_levels(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    parts = [d.where(c).withColumn("level", F.lit(n)).withColumn("order", F.lit(i)) for i, (n, c) in enumerate((("small", "doc_id % 3 = 0"), ("mid", "doc_id % 2 = 0"), ("big", "true")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(F.min_by("level", "order").alias("level"))


@query("SELECT doc_id, len(string_split(text, ' ')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS bag_size FROM documents")
def token_bag_union(t: Tables) -> DataFrame:
    bag = F.concat(F.split("text", " "), F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))
    return t.documents.select("doc_id", F.size(bag).cast("long").alias("bag_size"))


@query("SELECT DISTINCT user_id FROM events")
def list_users(t: Tables) -> DataFrame:
    return t.events.select("user_id").distinct().orderBy("user_id")


@query("SELECT DISTINCT conv_id FROM conversations")
def list_sessions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().orderBy("conv_id")


@query("SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def load_session(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text"))


@query("SELECT vec_id AS chunk_id, source, lang, n_chars, label FROM documents JOIN embeddings ON doc_id = vec_id")
def build_vector_table(t: Tables) -> DataFrame:
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("chunk_id"), "source", "lang", "n_chars", "label")


@query(f"WITH {BM25} SELECT query_id, chunk_id, source, lang FROM bm25 JOIN documents ON doc_id = chunk_id")
def hydrate_hits(t: Tables) -> DataFrame:
    return bm25_hits(t).join(t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "lang"), "chunk_id").select("query_id", "chunk_id", "source", "lang")


@query(f"WITH {BM25} SELECT DISTINCT query_id, chunk_id // 5 AS mid_id FROM bm25")
def lift_to_parent(t: Tables) -> DataFrame:
    mids = t.documents.select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 5").alias("mid_id"))
    return bm25_hits(t).join(mids, "chunk_id").select("query_id", "mid_id").distinct()


@query("SELECT doc_id, url FROM (SELECT doc_id, 'p' || doc_id % 300 AS name FROM documents) LEFT JOIN (SELECT 'p' || page_id AS name, url FROM pages) USING (name)")
def file_to_manual(t: Tables) -> DataFrame:
    lookup = t.pages.select(F.concat(F.lit("p"), "page_id").alias("name"), "url")
    return t.documents.select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 300).alias("name")).join(lookup, "name", "left").select("doc_id", "url")


#: Characters of the tight contexts.
BUDGETS = (2000, 5000, 10000)


@query(
    f"""WITH {RERANKED}, found AS (SELECT 'normal' AS scenario, query_id, chunk_id, rank FROM reranked UNION ALL SELECT 'rerank_failure', query_id, chunk_id, rank FROM fused WHERE rank <= 10
      UNION ALL SELECT 'both_failure', query_id, chunk_id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'dense_failure', query_id, chunk_id, rank FROM (SELECT f.query_id, f.chunk_id,
        row_number() OVER (PARTITION BY f.query_id ORDER BY round(l.quality + 1.0 / (1 + f.rank), 9) DESC NULLS LAST, f.rank) AS rank FROM bm25 f LEFT JOIN labels l ON l.doc_id = f.chunk_id) WHERE rank <= 10),
    per AS (SELECT scenario, query_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS best FROM found GROUP BY ALL),
    its AS (SELECT query_id, rank, '{{"text":' || to_json(text)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || '}}' AS item, ',"source":' || to_json(source)::VARCHAR || '}}' AS rest FROM reranked JOIN documents ON doc_id = chunk_id),
    run AS (SELECT *, 31 + sum(length(item) + 1) OVER (PARTITION BY budget, query_id ORDER BY rank) - 1 AS upto FROM its, (SELECT unnest({list(BUDGETS)}) AS budget)),
    first AS (SELECT budget, query_id, min(rank) AS rank FROM run WHERE upto > budget GROUP BY ALL),
    kept AS (SELECT budget, query_id FROM run WHERE upto <= budget UNION ALL SELECT budget, query_id FROM run JOIN first USING (budget, query_id, rank) WHERE budget - (upto - length(item)) - 8 - length(rest) - 2 - 3 >= 0),
    contexts AS (SELECT budget, query_id, count(*) AS n FROM kept GROUP BY ALL)
    SELECT p.scenario, count(*) AS queries, sum(p.n)::BIGINT AS hits, count(*) FILTER (p.best = u.best) AS same_top3, true AS ok FROM per p LEFT JOIN per u ON u.scenario = 'normal' AND u.query_id = p.query_id GROUP BY p.scenario
    UNION ALL SELECT 'context_' || budget, count(*), sum(c.n)::BIGINT, count(*) FILTER (c.n >= least(3, i.n)), true FROM contexts c JOIN (SELECT query_id, count(*) AS n FROM its GROUP BY 1) i USING (query_id) GROUP BY budget"""
)
def degradation_report(t: Tables) -> DataFrame:
    """The normal search; the same queries without dense search, without reranking and without both; and the normal evidence in tight contexts.
    Of each: queries with hits, hits, queries that keep their three best hits in order, and whether there are hits (and no context is over its budget)."""
    bm25, dense = bm25_hits(t), dense_hits(t)

    def search(name: str, dense: DataFrame, reranks: bool) -> DataFrame:
        fused = R.hybrid_topk(bm25, dense)
        scores = outer_scores(t, fused)
        return R.rerank_hits(fused, scores if reranks else scores.where("false"), R.SMALL_TOP).select(F.lit(name).alias("scenario"), "query_id", "chunk_id", "rank")

    normal = stored(search("normal", dense, True), "small_hits")
    found = normal
    for name, channel, reranks in (("dense_failure", dense.where("false"), True), ("rerank_failure", dense, False), ("both_failure", dense.where("false"), False)):
        found = found.unionByName(search(name, channel, reranks))
    three = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "chunk_id")))), lambda h: h["chunk_id"])
    per = stored(found.groupBy("scenario", "query_id").agg(F.count(F.lit(1)).alias("n"), three.alias("best")), "scenarios")
    usual = per.where("scenario = 'normal'").select("query_id", F.col("best").alias("usual"))
    out = per.join(usual, "query_id", "left").select("scenario", "n", (F.col("best") == F.col("usual")).alias("same"), F.lit(True).alias("fits"))
    evidence = stored(normal.join(t.documents, F.col("doc_id") == F.col("chunk_id")).select("query_id", "rank", F.struct("text", "source").alias("item")), "evidence")
    all_of = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    for budget in BUDGETS:
        c = K.format_context(evidence, budget).withColumn("n", F.expr("cast(json_array_length(get_json_object(context, '$.evidence')) as bigint)")).where("n > 0")
        out = out.unionByName(c.join(all_of, "query_id").select(F.lit(f"context_{budget}").alias("scenario"), "n", (F.col("n") >= F.least(F.lit(3), F.col("all"))).alias("same"), (F.length("context") <= budget).alias("fits")))
    sums = out.groupBy("scenario").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("hits"), F.count_if("same").alias("same_top3"), F.bool_and("fits").alias("fits"))
    return sums.select("scenario", "queries", "hits", "same_top3", (F.col("fits") & (F.col("hits") > 0)).alias("ok"))
