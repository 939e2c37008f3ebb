"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.plans.fixtures import MD_DOCS, MD_LINES, md_docs, md_lines
from docloom.plans.registry import Tables, query

#: The same class of white space, in the SQL engine's regular expressions.
W = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NORM = rf"regexp_replace(regexp_replace(regexp_replace(replace({{0}}, chr(65279), ''), '[ \t]+', ' ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^{W.replace('{', '{{').replace('}', '}}')}+|{W.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"


def norm(c: str) -> str:
    return NORM.format(c)


NOISY = "concat(chr(65279), chr(12288), '  ', replace(text, '. ', '.  '), ' ', chr(9), chr(10), chr(10), chr(10), chr(10), lang, ' ')"


@query(f"SELECT doc_id, md5({norm(NOISY)}) AS norm_md5, length({norm(NOISY)}) AS n_chars FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    noisy = F.expr(NOISY.replace("chr(65279)", "'\\ufeff'").replace("chr(12288)", "'\\u3000'"))
    n = X.normalize_text(noisy)
    return t.documents.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("n_chars"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(slug, '^[A-Za-z]') THEN substr(slug, 1, 80) || '_' || substr(md5(v), 1, 12) ELSE 'doc_' || substr(md5(v), 1, 12) END AS safe_id
    FROM (SELECT doc_id, v, regexp_replace(regexp_replace(trim(v), '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
          FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' || doc_id ELSE text END AS v FROM documents))"""
)
def safe_id(t: Tables) -> DataFrame:
    v = F.expr("CASE WHEN doc_id % 3 = 0 THEN string(doc_id) ELSE text END")
    return t.documents.select("doc_id", X.safe_id(v, "doc").alias("safe_id"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT event_id, 'cache:exact:' || sha256(to_json({'event_type': event_type, 'props': props, 'user_id': user_id})) AS exact_key FROM events")
def exact_key(t: Tables) -> DataFrame:
    fields = {c: F.col(c) for c in ("user_id", "props", "event_type")}
    return t.events.select("event_id", X.exact_key(fields, "cache:exact:").alias("exact_key"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END::BIGINT AS tokens FROM documents")
def approx_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


IMG = r"!\[[^\]]*\]\(([^)]+)\)"
TOKENS = f"CASE WHEN length(m) = 0 THEN 0 ELSE greatest(1, length(m) // 2) + 256 * len(regexp_extract_all(m, '{IMG}')) END"


@query(f"WITH {MD_LINES} SELECT doc_id, line_no::BIGINT AS line_no, ({TOKENS})::BIGINT AS tokens FROM (SELECT *, regexp_replace(md, '^{W}+|{W}+$', '', 'g') AS m FROM md_lines)")
def markdown_tokens(t: Tables) -> DataFrame:
    return md_lines(t).select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.markdown_tokens(F.col("md")).alias("tokens"))


@query(
    rf"""WITH {MD_DOCS} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(md, '{IMG}', 1), lambda x: regexp_extract(x, '[^/]+$')), ',') AS images,
    len(regexp_extract_all(md, '{IMG}'))::BIGINT AS n_images FROM md_docs"""
)
def image_refs(t: Tables) -> DataFrame:
    found = X.image_refs(F.col("md"))
    return md_docs(t).select("doc_id", F.array_join(found, ",").alias("images"), F.size(found).cast("long").alias("n_images"))


@query(
    rf"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS sentence_no, s AS sentence FROM (
      SELECT doc_id, generate_subscripts(parts, 1) AS k, trim(unnest(parts)) AS s FROM (
        SELECT doc_id, string_split(regexp_replace({norm('text')}, '([.!?。！？;；])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE s <> ''"""
)
def split_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode_outer(X.split_sentences(F.col("text"))).alias("k", "sentence")).where("k IS NOT NULL").select(
        "doc_id", F.col("k").cast("long").alias("sentence_no"), "sentence"
    )


@query(
    """WITH d AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS v FROM documents),
    w AS (SELECT doc_id, v, unnest(generate_series(0, greatest(0, ceil((length(v) - 400) / 360.0)::INT))) AS i FROM d WHERE v <> '')
    SELECT doc_id, i::BIGINT AS piece_no, md5(trim(substr(v, i * 360 + 1, 400))) AS piece_md5 FROM w"""
)
def overlap_windows(t: Tables) -> DataFrame:
    v = F.replace("text", F.lit("\n"), F.lit(" "))
    return t.documents.select("doc_id", F.posexplode_outer(X.overlap_windows(v, 200, 20)).alias("i", "piece")).where("i IS NOT NULL").select(
        "doc_id", F.col("i").cast("long").alias("piece_no"), F.md5("piece").alias("piece_md5")
    )


KIND = rf"""CASE WHEN regexp_matches(md, '^\s*$') THEN 'blank' WHEN regexp_matches(md, '^ {{0,3}}#{{1,6}}(\s|$)') THEN 'heading'
  WHEN regexp_matches(md, '^ {{0,3}}(```+|~~~+)') THEN 'fence' WHEN regexp_matches(md, '^(\s*)([-+*]|\d+[.)])\s+') THEN 'list'
  WHEN regexp_matches(md, '^\s*\|') THEN 'table' WHEN regexp_matches(md, '{IMG}') THEN 'image' WHEN regexp_matches(md, '^\s*>') THEN 'block' ELSE 'paragraph' END"""


@query(f"WITH {MD_LINES} SELECT doc_id, line_no::BIGINT AS line_no, {KIND} AS kind FROM md_lines")
def classify_line(t: Tables) -> DataFrame:
    return md_lines(t).select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.line_kind(F.col("md")).alias("kind"))


PATH = "array(source, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE lang END, string(doc_id))"


@query("SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' > ' || lang END || ' > ' || doc_id AS breadcrumb FROM documents")
def breadcrumb(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.breadcrumb(F.expr(PATH)).alias("breadcrumb"))


@query(
    """SELECT doc_id, '手册：' || source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || '章节：' || lang || ' > ' || doc_id END || chr(10) || '大块：b' || doc_id || chr(10) || '中块：m' || doc_id AS prefix
    FROM documents"""
)
def retrieval_prefix(t: Tables) -> DataFrame:
    path = F.expr("CASE WHEN doc_id % 5 = 0 THEN cast(array() as array<string>) ELSE array(lang, string(doc_id)) END")
    return t.documents.select("doc_id", X.retrieval_prefix(F.col("source"), path, F.expr("concat('b', doc_id)"), F.expr("concat('m', doc_id)")).alias("prefix"))


@query("SELECT doc_id, replace(source || '手册' || lang, '手册', '') AS product_name FROM documents")
def product_name(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.product_name(F.expr("concat(source, '手册', lang)")).alias("product_name"))


@query(
    """SELECT doc_id, string_agg(w, ',' ORDER BY k) AS words FROM (SELECT doc_id, w, min(k) AS k FROM (
      SELECT doc_id, trim(unnest(string_split(text, ' '))) AS w, generate_subscripts(string_split(text, ' '), 1) AS k
      FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)) WHERE w <> '' GROUP BY doc_id, w) GROUP BY doc_id"""
)
def ordered_unique(t: Tables) -> DataFrame:
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return t.documents.select("doc_id", F.array_join(X.ordered_unique(words), ",").alias("words"))


@query(
    r"""SELECT page_id, regexp_extract(u, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(u, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem
    FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages)"""
)
def path_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.path_name(F.col("url")).alias("name"), X.path_stem(F.col("url")).alias("stem"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE regexp_replace(substr(text, 1, 47), '{W}+$', '') || '...' END AS short FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate_ellipsis(F.col("text"), 50).alias("short"))


#: Ranges by places in the text: of its first blank and its first full stop, and its length.
REFS = "concat('[', instr(text, ' ') + 1, '-', instr(text, ' ') + length(text), ', ', instr(text, '.') + 100, CASE WHEN length(text) % 2 = 0 THEN concat(',', left(text, 1)) ELSE '，' END, length(text), '～', length(text) + instr(text, '.'), ']')"


@query(
    f"""SELECT doc_id, k::BIGINT AS ref_no, string_split(p, '-')[1]::BIGINT AS start_line, string_split(p, '-')[-1]::BIGINT AS end_line FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS k, p FROM (
        SELECT doc_id, generate_subscripts(a, 1) AS j, unnest(a) AS p FROM (
          SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace({REFS}, '[\\[\\]()\\s]', '', 'g'), '[–—～~]', '-', 'g'), '[，、]', ',', 'g'), ',') AS a FROM documents))
      WHERE regexp_matches(p, '^\\d+(-\\d+)?$'))"""
)
def parse_line_ranges(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.line_ranges(F.expr(REFS))).alias("k", "r")).select(
        "doc_id", F.col("k").cast("long").alias("ref_no"), F.col("r.start_line").cast("long").alias("start_line"), F.col("r.end_line").cast("long").alias("end_line")
    )


@query(
    """SELECT conv_id, substr(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 1, 4000) AS summary FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id"""
)
def summarize_messages(t: Tables) -> DataFrame:
    last = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return t.conversations.groupBy("conv_id").agg(last.alias("m")).select("conv_id", X.summarize_messages(F.col("m")).alias("summary"))


@query("SELECT item_id, replace(replace('Q: {q} | lang {l}', '{q}', substr(text, 1, 1500)), '{l}', 'en') AS prompt FROM benchmark")
def build_prompts(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.fill_template("Q: {q} | lang {l}", {"q": F.substring("text", 1, 1500), "l": F.lit("en")}).alias("prompt"))


@query("SELECT item_id, 'find the passage' || chr(10) || text AS embed_text FROM benchmark")
def embed_text(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.embed_text("find the passage", F.col("text")).alias("embed_text"))


@query(rf"WITH {MD_DOCS} SELECT doc_id, md5(md) AS text_md5, regexp_extract_all(md, '{IMG}', 1)[1] AS image FROM md_docs")
def embedding_payload(t: Tables) -> DataFrame:
    images = F.regexp_extract_all("md", F.lit(X.IMAGE), F.lit(1))
    return md_docs(t).select("doc_id", X.embedding_payload(F.col("md"), images).alias("p")).select("doc_id", F.md5("p.text").alias("text_md5"), "p.image")


@query(
    """SELECT doc_id, md5(array_to_string(list_transform(string_split(text, '. '), lambda p, i: CASE WHEN i = 1 THEN p ELSE '[' || coalesce(['a' || doc_id, 'b'][i - 1], 'missing image') || ']' || p END), '')) AS answer_md5 FROM documents"""
)
def render_answer(t: Tables) -> DataFrame:
    """A placeholder for each end of a sentence, and two images."""
    answer = X.render_answer(F.replace("text", F.lit(". "), F.lit(X.PIC)), F.array(F.concat(F.lit("a"), "doc_id"), F.lit("b")))
    return t.documents.select("doc_id", F.md5(answer).alias("answer_md5"))
