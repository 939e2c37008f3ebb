"""Queries of answers, replies, renderings and small set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import chat as C
from docloom.operators import context as K
from docloom.operators import evaluation as A
from docloom.operators import graph as G
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.store import new_folder
from docloom.plans.fixtures import md_lines
from docloom.plans.graph_queries import chunks
from docloom.plans.registry import Tables, query
from docloom.plans.retrieval_queries import BM25, bm25_hits
from docloom.plans.structure_queries import LINES
from docloom.sources import files as I


@query("SELECT event_id, (doc->>'$.u')::BIGINT AS user_id, doc->>'$.t' AS event_type FROM (SELECT event_id, json_object('u', user_id, 't', event_type) AS doc FROM events WHERE event_id % 5 <> 0) UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 5 = 0")
def extract_json(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")))
    reply = F.expr("CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END")
    text = F.when(reply == 0, F.lit("no json at all")).when(reply == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(reply == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done."))).otherwise(body)
    v = t.events.select("event_id", X.extract_json(text).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.u", "bigint").alias("user_id"), F.try_variant_get("v", "$.t", "string").alias("event_type"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '. ', '. ' || CASE WHEN length(text) % 2 = 0 THEN '<PIC>' ELSE '' END || '  '), '[ \t]{2,}', ' ', 'g'), '\s+([，。；、,.!?！？])', '\1', 'g'), ' ' || chr(10))) AS content_md5 FROM documents"""
)
def repair_image_markers(t: Tables) -> DataFrame:
    """A marker after each sentence; texts of even length allow its image."""
    text = F.replace("text", F.lit(". "), F.concat(F.lit(". [图片:D"), F.col("doc_id").cast("string"), F.lit("_0]  ")))
    allowed = F.when(F.length("text") % 2 == 0, F.array(F.concat(F.lit("D"), "doc_id", F.lit("_0.png")))).otherwise(F.array(F.lit("none.png")))
    return t.documents.select("doc_id", F.md5(X.repair_image_markers(text, allowed)).alias("content_md5"))


@query(
    """SELECT doc_id, md5(trim(array_to_string(list_transform(parts, lambda p, i: CASE WHEN i BETWEEN 2 AND 4 THEN '<PIC>' || p ELSE p END), ''), ' ' || chr(10))) AS content_md5, ['', 'x0', 'x0,x1', 'x0,x1,x2'][least(len(parts), 4)] AS images
    FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)"""
)
def align_pics(t: Tables) -> DataFrame:
    """A placeholder for each end of a sentence, with three images in turn: each is kept once."""
    parts = F.split("text", "\\. ")
    images = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.concat(F.lit("x"), (i % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    a = X.align_pics(F.array_join(parts, X.PIC), images)
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", F.md5("a.text").alias("content_md5"), F.array_join("a.images", ",").alias("images"))


@query("SELECT doc_id, length(text) % 3 < 2 AND strlen(text) <= 2000 AS ok FROM documents")
def validate_image_urls(t: Tables) -> DataFrame:
    """Each text stands in for an image's bytes; its length tells the kind."""
    kind = F.expr("CASE length(text) % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'gif' END")
    url = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""))
    return t.documents.select("doc_id", X.image_url_ok(url, 2000).alias("ok"))


@query(
    f"""WITH {BM25} SELECT query_id, chunk_id, rank::BIGINT AS rank, source || ' > ' || lang AS path, lang AS title, CASE WHEN length(text) <= 100 THEN text ELSE rtrim(substr(text, 1, 97), ' ' || chr(10)) || '...' END AS text, 'D' || chunk_id AS images
    FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 5"""
)
def chunk_to_evidence(t: Tables) -> DataFrame:
    x = bm25_hits(t).where("rank <= 5").join(t.documents, F.col("doc_id") == F.col("chunk_id"))
    e = K.chunk_to_evidence(F.col("rank").cast("long"), F.col("source"), F.array("source", "lang"), F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string"), F.array(F.concat(F.lit("img/D"), "chunk_id", F.lit(".png"))), 100)
    return x.select("query_id", "chunk_id", e.alias("e")).select("query_id", "chunk_id", "e.rank", "e.path", "e.title", "e.text", F.array_join("e.images", ",").alias("images"))


@query("SELECT x.p_brand AS doc_id, count(*) AS n FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey AND x.p_type <> y.p_type GROUP BY 1")
def cross_section_only(t: Tables) -> DataFrame:
    return G.pair_sums(chunks(t)).select("doc_id", F.col("n_pairs").alias("n"))


@query("SELECT a.vec_id, round((a.embedding[1]::DOUBLE + b.embedding[1]::DOUBLE) / 2, 6) AS first, round((a.embedding[64]::DOUBLE + b.embedding[64]::DOUBLE) / 2, 6) AS last FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def multimodal_query(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.array("embedding").alias("images"))
    v = R.multimodal_vector(F.col("embedding"), F.col("images"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"))


@query("SELECT p_brand AS doc_id, count(*) AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1")
def drop_manual(t: Tables) -> DataFrame:
    return G.drop_manual(t.part.select(F.col("p_brand").alias("doc_id")), "Brand#11").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id <> 3 GROUP BY 1")
def reset_session(t: Tables) -> DataFrame:
    return C.reset_session(t.conversations, 3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, coalesce(t1, t2) AS h1, CASE WHEN p2 > p1 THEN t2 END AS h2 FROM pathed")
def header_carry(t: Tables) -> DataFrame:
    x = S.structured_lines(md_lines(t))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.try_element_at("header_path", F.lit(1)).alias("h1"), F.try_element_at("header_path", F.lit(2)).alias("h2"))


@query("SELECT doc_id AS name, tag, NOT contains(lower(text), tag) AS missing, contains(lower(text), tag) AS unclosed FROM documents, (VALUES ('the'), ('licensed')) v(tag)")
def missing_tags(t: Tables) -> DataFrame:
    bare = F.lower("text")
    tags = F.array(F.lit("the"), F.lit("licensed"))
    marked = F.aggregate(tags, bare, lambda s, x: F.replace(s, x, F.concat(F.lit("<"), x, F.lit(">"))))
    return A.missing_tags(t.documents.select(F.col("doc_id").alias("name"), marked.alias("text")), t.documents.select(F.col("doc_id").alias("name"), F.explode(tags).alias("tag")))


@query(f"WITH {BM25} SELECT item_id AS query_id, item_id % 2 = 0 AS success, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS retrieved FROM benchmark LEFT JOIN bm25 ON query_id = item_id GROUP BY item_id")
def batch_records(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("query_id"))
    a = t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.lit("a").alias("content"), F.array(F.lit("i")).alias("images"))
    got = K.batch_records(q, bm25_hits(t), a)
    return got.select("query_id", "success", F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


@query("SELECT conv_id AS session_id, max(turn) AS version, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id")
def save_sessions(t: Tables) -> DataFrame:
    """Sessions written version by version to the shared folder, and the last of each read back."""
    path = new_folder(t.spark, "sessions")
    rows = t.conversations.select((F.col("conv_id") % 8).alias("user_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("version"), F.col("text").alias("summary"))
    I.save_sessions(rows, path)
    return I.load_sessions(t.spark, path).select("session_id", "version", "summary")


@query("SELECT item_id AS id, to_json(text)::VARCHAR || ',[\"i' || item_id || '\"]' AS ret FROM benchmark")
def export_answers(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("id"), I.answer_ret(F.col("text"), F.array(F.concat(F.lit("i"), "item_id"))).alias("ret"))


@query("SELECT doc_id AS question_id, k::BIGINT AS ref_no, source || CASE k WHEN 0 THEN '_a.md' WHEN 1 THEN '_b.md' ELSE '_c.md' END AS file, (length(text) + k)::BIGINT AS start_line, (length(text) + k + CASE k WHEN 0 THEN instr(text, ' ') ELSE 0 END)::BIGINT AS end_line FROM documents, range(0, 3) r(k)")
def normalize_evidence_ref(t: Tables) -> DataFrame:
    """Files are the documents' sources; lines are their lengths and places in them."""
    n, s = F.length("text"), F.col("source")
    one = F.concat(F.lit('"'), s, F.lit("_a.md:"), n.cast("string"), F.lit("-"), (n + F.instr("text", " ")).cast("string"), F.lit('"'))
    two = F.concat(F.lit('{"file":"'), s, F.lit('_b.md","lines":"'), (n + 1).cast("string"), F.lit('"}'))
    three = F.concat(F.lit('{"source":"'), s, F.lit('_c.md","lines":['), (n + 2).cast("string"), F.lit("]}"))
    refs = t.documents.select(F.col("doc_id").alias("question_id"), F.posexplode(F.array(one, two, three)).alias("ref_no", "j")).select("question_id", "ref_no", F.parse_json("j").alias("ref"))
    return I.evidence_refs(refs).select("question_id", "file", *[F.col(c).cast("long").alias(c) for c in ("ref_no", "start_line", "end_line")])


@query(
    f"""WITH {BM25}, its AS (SELECT query_id, rank, text, '{{"text":' || to_json(text)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || '}}' AS item, ',"source":' || to_json(source)::VARCHAR || '}}' AS rest
      FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
    run AS (SELECT *, 31 + sum(length(item) + 1) OVER (PARTITION BY query_id ORDER BY rank) - 1 AS upto FROM its),
    first AS (SELECT query_id, min(rank) AS rank FROM run WHERE upto > 3000 GROUP BY query_id),
    last AS (SELECT query_id, rank, text, rest, 3000 - (upto - length(item)) - 8 - length(rest) - 2 - 3 AS room FROM run JOIN first USING (query_id, rank)),
    chars AS (SELECT query_id, room, m, c, sum(CASE WHEN c IN ('"', chr(92), chr(10), chr(13), chr(9), chr(8), chr(12)) THEN 2 WHEN c < ' ' THEN 6 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY m) AS wide
      FROM (SELECT query_id, room, generate_subscripts(cs, 1) AS m, unnest(cs) AS c FROM (SELECT query_id, room, string_split(text, '') AS cs FROM last))),
    cut AS (SELECT query_id, max(m) AS m FROM (SELECT query_id, m, room, max(CASE WHEN c <> ' ' THEN wide ELSE 0 END) OVER (PARTITION BY query_id ORDER BY m) AS w FROM chars) JOIN last l USING (query_id) WHERE w <= l.room AND m <= length(text) - 4 GROUP BY query_id),
    kept AS (SELECT query_id, rank, item FROM run WHERE upto <= 3000 UNION ALL
      SELECT query_id, rank, '{{"text":' || to_json(rtrim(substr(text, 1, coalesce(m, 0)), ' ') || '...')::VARCHAR || rest FROM last LEFT JOIN cut USING (query_id) WHERE room >= 0)
    SELECT query_id, '{{"language":"en","evidence":[' || coalesce(string_agg(item, ',' ORDER BY rank), '') || ']}}' AS context FROM (SELECT DISTINCT query_id FROM its) LEFT JOIN kept USING (query_id) GROUP BY query_id"""
)
def format_context(t: Tables) -> DataFrame:
    x = bm25_hits(t).where("rank <= 5").join(t.documents, F.col("doc_id") == F.col("chunk_id"))
    return K.format_context(x.select("query_id", "rank", F.struct("text", "source").alias("item")), 3000)


CHECKS = "array('路由正确', '检索有结果', '不重复上文', '指代消解', '说明按钮', '退货政策', '其他', '通用问题')"
TAIL = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Press it' WHEN 2 THEN ' to RETURN' ELSE ' 其他' END"


@query(
    f"""SELECT conv_id AS dialogue, turn, CASE c % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN NOT contains(substr(a, 1, 200), '滤网') OR contains(a, '其他') WHEN 3 THEN r > 0 OR length(a) > 50
      WHEN 4 THEN contains(lower(a), 'press') OR contains(lower(a), 'mode') OR contains(lower(a), 'button') WHEN 5 THEN contains(lower(a), 'return') WHEN 6 THEN length(a) > 20 ELSE contains(lower(a), 'return') END AS ok, 1::BIGINT AS checks
    FROM (SELECT *, conv_id + turn AS c, CASE WHEN turn % 2 = 0 THEN '滤网 ' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN 'short' ELSE text END || {TAIL} AS a, turn % 3 AS r FROM conversations)"""
)
def dialogue_checks(t: Tables) -> DataFrame:
    answer = F.expr(f"concat(CASE WHEN turn % 2 = 0 THEN '滤网 ' ELSE '' END, CASE WHEN conv_id % 3 = 0 THEN 'short' ELSE text END, {TAIL})")
    x = t.conversations.select(F.col("conv_id").alias("dialogue"), "turn", answer.alias("answer"), F.expr("nullif(repeat('r', turn % 3), '')").alias("rewritten"), F.expr(f"array({CHECKS}[(conv_id + turn) % 8])").alias("checks"))
    return K.dialogue_checks(x)
