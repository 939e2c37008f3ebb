"""Queries of the document structure and chunking jobs, over the markdown view of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import structure as S
from docloom.plans.fixtures import MD_LINES, md_lines
from docloom.plans.registry import Tables, query
from docloom.plans.text_queries import IMG, KIND, norm
from docloom.store import spread, stored

LINES = f"""{MD_LINES},
  own AS (SELECT *, {KIND} AS own FROM md_lines),
  kinds AS (SELECT *, CASE WHEN own IN ('paragraph', 'image') THEN
      CASE WHEN last_value(CASE WHEN own NOT IN ('paragraph', 'image') THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) IN ('list', 'block') THEN 'list' ELSE 'paragraph' END
      ELSE own END AS kind FROM own),
  heads AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(md, '^\\s*(#+)', 1)) END AS level,
      CASE WHEN kind = 'heading' THEN trim(regexp_replace(md, '^\\s*#+\\s*|\\s+#+\\s*$', '', 'g')) END AS title FROM kinds),
  lines AS (SELECT *, sum((kind = 'heading')::INT) OVER w AS section_no,
      last_value(CASE WHEN level = 1 THEN line_no END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1,
      last_value(CASE WHEN level = 2 THEN line_no END IGNORE NULLS) OVER w AS p2, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2,
      lag(kind) OVER w AS before FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  pathed AS (SELECT *, concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END) AS path,
      sum((kind = 'heading' OR kind <> coalesce(before, ''))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM lines)"""
ELEMENTS = rf"""{LINES},
  blocks AS (SELECT doc_id, section_no, block_no, max(kind) AS kind, min(line_no) AS line_start, max(line_no) + 1 AS line_end, max(title) AS title,
      trim(string_agg(md, chr(10) ORDER BY line_no), ' ' || chr(10)) AS markdown FROM pathed WHERE kind <> 'blank' GROUP BY ALL),
  elements AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS element_no, line_start, line_end, title, markdown,
      CASE WHEN kind = 'paragraph' AND regexp_matches(markdown, '{IMG}') THEN 'image' ELSE kind END AS kind, len(regexp_extract_all(markdown, '{IMG}')) AS n_images,
      CASE WHEN length(markdown) = 0 THEN 0 ELSE greatest(1, length(markdown) // 2) + 256 * len(regexp_extract_all(markdown, '{IMG}')) END AS tokens FROM blocks)"""


def elements(t: Tables) -> DataFrame:
    return S.element_table(md_lines(t))


@query(
    f"""WITH {LINES} SELECT doc_id, section_no::BIGINT AS section_no, max(level)::BIGINT AS level, max(title) AS heading, coalesce(max(CASE WHEN kind = 'heading' THEN path END), '') AS header_path,
    min(line_no)::BIGINT AS line_start, (max(CASE WHEN kind <> 'blank' THEN line_no END) + 1)::BIGINT AS line_end FROM pathed GROUP BY doc_id, section_no"""
)
def section_table(t: Tables) -> DataFrame:
    whole = ("section_no", "level", "line_start", "line_end")
    return S.section_table(md_lines(t)).select("doc_id", "heading", X.breadcrumb(F.col("header_path")).alias("header_path"), *[F.col(c).cast("long").alias(c) for c in whole])


@query(f"WITH {ELEMENTS} SELECT doc_id, section_no::BIGINT AS section_no, element_no::BIGINT AS element_no, kind, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, tokens::BIGINT AS tokens, md5(markdown) AS md5 FROM elements")
def element_table(t: Tables) -> DataFrame:
    whole = ("section_no", "element_no", "line_start", "line_end", "tokens")
    return elements(t).select("doc_id", "kind", F.md5("markdown").alias("md5"), *[F.col(c).cast("long").alias(c) for c in whole])


PACK = """body AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY element_no) AS k FROM elements WHERE kind <> 'heading'),
  packed AS (SELECT doc_id, section_no, element_no, k, tokens AS cur, 0 AS group_no FROM body WHERE k = 1 UNION ALL
    SELECT b.doc_id, b.section_no, b.element_no, b.k, CASE WHEN o THEN b.tokens ELSE p.cur + b.tokens END, CASE WHEN o THEN p.group_no + 1 ELSE p.group_no END
    FROM packed p JOIN (SELECT * FROM body) b ON b.doc_id = p.doc_id AND b.section_no = p.section_no AND b.k = p.k + 1,
      LATERAL (SELECT b.kind <> 'image' AND (p.cur >= {0} OR p.cur + 1 + b.tokens > {1}) AS o))"""


@query(f"WITH RECURSIVE {ELEMENTS}, {PACK.format(300, 400)} SELECT doc_id, section_no::BIGINT AS section_no, element_no::BIGINT AS element_no, group_no::BIGINT AS group_no FROM packed")
def pack_elements(t: Tables) -> DataFrame:
    rows = S.pack_groups(stored(elements(t), "elements").where("kind <> 'heading'"), ["doc_id", "section_no"], ["element_no"], 300, 400)
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("section_no", "element_no", "group_no")])


ENTRIES = """packed AS (SELECT doc_id, element_no AS k, tokens AS cur, n_images AS pics, 0 AS group_no FROM elements WHERE element_no = 0 UNION ALL
    SELECT b.doc_id, b.element_no, CASE WHEN o THEN b.tokens ELSE p.cur + 1 + b.tokens END, CASE WHEN o THEN b.n_images ELSE p.pics + b.n_images END, CASE WHEN o THEN p.group_no + 1 ELSE p.group_no END
    FROM packed p JOIN (SELECT * FROM elements) b ON b.doc_id = p.doc_id AND b.element_no = p.k + 1,
      LATERAL (SELECT p.pics + b.n_images > 1 OR (p.cur >= 220 AND b.kind <> 'image') OR p.cur + 1 + b.tokens > 320 AS o))"""


@query(f"WITH RECURSIVE {ELEMENTS}, {ENTRIES} SELECT doc_id, k::BIGINT AS element_no, group_no::BIGINT AS group_no FROM packed")
def pack_entries(t: Tables) -> DataFrame:
    rows = S.pack_entries(stored(elements(t), "elements"), ["doc_id"], ["element_no"], *S.SMALL, S.SMALL_IMAGES)
    return rows.select("doc_id", F.col("element_no").cast("long").alias("element_no"), F.col("group_no").cast("long").alias("group_no"))


@query(
    f"""WITH {ELEMENTS} SELECT doc_id, section_no::BIGINT AS section_no, md5(string_agg(markdown, chr(10) || chr(10) ORDER BY element_no)) AS md5, min(line_start)::BIGINT + 1 AS start_line,
    max(line_end)::BIGINT AS end_line, sum(n_images)::BIGINT AS n_images FROM elements GROUP BY doc_id, section_no"""
)
def chunk_rollup(t: Tables) -> DataFrame:
    r = S.roll(elements(t), ["doc_id", "section_no"], ["element_no"])
    return r.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.md5("markdown").alias("md5"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.size("images").cast("long").alias("n_images"))


TOKENS_OF = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 2) END"


def cut_sql(name: str, source: str, when: str, most: int) -> str:
    """Common tables that end in `name`: the rows of `source` (eid, kind, markdown, tokens, text, ...), those of `when` split by their kind, with part_no, whole and part. Sentences of paragraphs
    and items of lists are packed greedily; longer ones, and images' text, are cut into windows."""
    lines = f"list_transform(string_split(markdown, chr(10)), lambda l: CASE WHEN regexp_matches(rtrim(l), '^\\s*([-+*]|\\d+[.)])\\s+') THEN chr(1) || rtrim(l) ELSE rtrim(l) END)"
    return rf"""{name}_dear AS (SELECT *, {norm('text')} AS v FROM {source} WHERE {when}),
  {name}_items AS (SELECT eid, row_number() OVER (PARTITION BY eid ORDER BY k) - 1 AS k, s, sep, greatest(1, length(s) // 2) AS n FROM (
      SELECT eid, 0 AS sep, generate_subscripts(ps, 1) AS k, trim(unnest(ps)) AS s FROM (
        SELECT eid, CASE WHEN length(v) // 2 > {most} THEN string_split(regexp_replace(v, '([.!?。！？;；])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [v] END AS ps FROM {name}_dear WHERE kind = 'paragraph')
      UNION ALL SELECT eid, 1, generate_subscripts(ps, 1), trim(unnest(ps), ' ' || chr(10) || chr(9)) FROM (SELECT eid, string_split(array_to_string({lines}, chr(10)), chr(1)) AS ps FROM {name}_dear WHERE kind = 'list')
      UNION ALL SELECT eid, 1, 1, markdown FROM {name}_dear WHERE kind NOT IN ('paragraph', 'list')) WHERE s <> ''),
  {name}_fold AS (SELECT eid, k, s, sep, n AS cur, 0 AS g, n > {most} AS long FROM {name}_items WHERE k = 0 UNION ALL
    SELECT b.eid, b.k, b.s, b.sep, CASE WHEN o THEN b.n ELSE f.cur + b.sep + b.n END, CASE WHEN o THEN f.g + 1 ELSE f.g END, b.n > {most}
    FROM {name}_fold f JOIN (SELECT * FROM {name}_items) b ON b.eid = f.eid AND b.k = f.k + 1, LATERAL (SELECT b.n > {most} OR f.long OR f.cur + b.sep + b.n > {most} AS o)),
  {name}_groups AS (SELECT eid, g, bool_or(long) AS long, CASE WHEN max(sep) = 0 THEN string_agg(s, ' ' ORDER BY k) ELSE string_agg(s, chr(10) ORDER BY k) END AS v FROM {name}_fold GROUP BY eid, g),
  {name}_windows AS (SELECT eid, g, unnest(generate_series(0, CASE WHEN long THEN ceil((length(v) - 2 * {most}) / (2.0 * {most}))::INT ELSE 0 END)) AS i, long, v FROM {name}_groups),
  {name}_parts AS (SELECT * FROM (SELECT eid, g, i, CASE WHEN NOT long THEN v ELSE trim(substr(v, i * 2 * {most} + 1, 2 * {most}), ' ' || chr(10)) END AS part FROM {name}_windows) WHERE part <> ''),
  {name} AS (SELECT s.* EXCLUDE (markdown, text, tokens), CASE WHEN p.eid IS NULL THEN s.markdown ELSE part END AS markdown, coalesce(g, 0) AS g, coalesce(i, 0) AS i,
      CASE WHEN count(p.eid) OVER (PARTITION BY s.eid) > 1 THEN part ELSE s.text END AS text,
      CASE WHEN p.eid IS NULL THEN s.tokens ELSE {TOKENS_OF.format('part')} + 256 * len(regexp_extract_all(part, '{IMG}')) END AS tokens FROM {source} s LEFT JOIN {name}_parts p ON p.eid = s.eid)"""


def packed_sql(name: str, source: str, keys: list[str], start: str, opens: str, step: str = "CASE WHEN o THEN b.tokens ELSE p.cur + 1 + b.tokens END", pics: str = "CASE WHEN o THEN b.n_images ELSE p.pics + b.n_images END") -> str:
    """Common table `name`: rows of `source` (keys, k from 1, tokens, ...) with group_no, by a walk over each key's rows."""
    same = " AND ".join(f"b.{k} = p.{k}" for k in keys)
    listed = ", ".join(keys)
    return f"""{name}_walk AS (SELECT {listed}, k, {start} AS cur, n_images AS pics, 0 AS group_no FROM {source} WHERE k = 1 UNION ALL
    SELECT {', '.join(f'b.{k}' for k in keys)}, b.k, {step}, {pics}, CASE WHEN o THEN p.group_no + 1 ELSE p.group_no END
    FROM {name}_walk p JOIN (SELECT * FROM {source}) b ON {same} AND b.k = p.k + 1, LATERAL (SELECT {opens} AS o)),
  {name} AS (SELECT s.*, group_no FROM {source} s JOIN {name}_walk w ON {' AND '.join(f'w.{k} = s.{k}' for k in keys)} AND w.k = s.k)"""


def level_sql(name: str, source: str, keys: list[str], target: int, most: int, quota: str = "") -> str:
    """A level below: entries of `source` (keys, at, ...) split and packed into `name`, with group_no and its own order `place`."""
    opens = f"{quota}(p.cur >= {target} AND b.kind <> 'image') OR p.cur + 1 + b.tokens > {most}"
    listed = ", ".join(keys)
    return f"""{name}_src AS (SELECT *, row_number() OVER (ORDER BY {listed}, place) AS eid FROM {source}),
  {cut_sql(f'{name}_cut', f'{name}_src', f'NOT tokens BETWEEN 1 AND {most}', most)},
  {name}_rows AS (SELECT *, row_number() OVER (PARTITION BY {listed} ORDER BY place, g, i) AS k FROM {name}_cut),
  {packed_sql(f'{name}_packed', f'{name}_rows', keys, 'tokens', opens)},
  {name} AS (SELECT * EXCLUDE (eid, g, i, k, place), k AS place FROM {name}_packed)"""


WALK_BIG = f"""{ELEMENTS.replace("max(title) AS title,", "max(title) AS title, arg_min(path, line_no) AS path,").replace("line_end, title, markdown,", "line_end, title, path, markdown,", 1)},
  told AS (SELECT doc_id, section_no, element_no, kind, path, markdown, coalesce(title, {norm('markdown')}) AS text, tokens, n_images, line_start, line_end FROM elements),
  body AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY element_no) AS k FROM told WHERE kind <> 'heading'),
  {packed_sql('coarse', 'body', ['doc_id', 'section_no'], 'tokens', f"b.kind <> 'image' AND (p.cur >= {S.BIG[0]} OR p.cur + 1 + b.tokens > {S.BIG[1]})", 'CASE WHEN o THEN b.tokens ELSE p.cur + b.tokens END')},
  both_ AS (SELECT * EXCLUDE (k) RENAME (group_no AS coarse_no) FROM coarse UNION ALL BY NAME SELECT *, 0 AS coarse_no FROM told WHERE kind = 'heading'),
  weighed AS (SELECT *, greatest(1, (sum(length(markdown) + 2) OVER w) // 2 - 1 + 256 * sum(n_images) OVER w) > {S.BIG[1]} AS oversized, row_number() OVER (ORDER BY doc_id, element_no) AS eid FROM both_ WINDOW w AS (PARTITION BY doc_id, section_no, coarse_no)),
  {cut_sql('big_cut', 'weighed', f"oversized AND kind <> 'heading' AND NOT tokens BETWEEN 1 AND {S.BIG[1]}", S.BIG[1])},
  big_rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no, coarse_no ORDER BY element_no, g, i) AS k FROM big_cut),
  {packed_sql('fine', 'big_rows', ['doc_id', 'section_no', 'coarse_no'], 'tokens', f"b.oversized AND (p.pics < 0 OR (p.cur + 1 + b.tokens > {S.BIG[1]} AND b.tokens <= {S.BIG[1]}))",
              "CASE WHEN o THEN b.tokens ELSE p.cur + 1 + b.tokens END", f"CASE WHEN CASE WHEN o THEN b.tokens ELSE p.cur + 1 + b.tokens END >= {S.BIG[1]} THEN -1 ELSE 0 END").replace("n_images AS pics, 0 AS group_no FROM big_rows", f"CASE WHEN tokens >= {S.BIG[1]} THEN -1 ELSE 0 END AS pics, 0 AS group_no FROM big_rows")},
  big AS (SELECT * EXCLUDE (eid, g, i, k, group_no), dense_rank() OVER (PARTITION BY doc_id ORDER BY section_no, coarse_no, group_no) - 1 AS big_no,
    row_number() OVER (PARTITION BY doc_id ORDER BY section_no, coarse_no, group_no, element_no, g, i) AS place FROM fine)"""
WALK_MID = f"{WALK_BIG}, {level_sql('mid_', 'big', ['doc_id', 'big_no'], *S.MID)}, mid AS (SELECT * RENAME (group_no AS mid_no) FROM mid_)"
WALK_SMALL = f"{WALK_MID}, {level_sql('small_', 'mid', ['doc_id', 'big_no', 'mid_no'], *S.SMALL, f'p.pics + b.n_images > {S.SMALL_IMAGES} OR ')}, small AS (SELECT * RENAME (group_no AS small_no) FROM small_)"


def chunk_sql(walk: str, level: str, numbers: list[str]) -> str:
    four = lambda c: f"lpad({c}::VARCHAR, 4, '0')"
    ids = {n: f"doc_id || '_{n}_' || {four('big_no')}" + "".join(f" || '_' || {four(c)}" for c in cs) for n, cs in (("big", []), ("mid", ["mid_no"]), ("small", ["mid_no", "small_no"]))}
    ups = "".join(f", {ids[n]} AS {n}_chunk_id" for n in ("big", "mid") if n != level and f"{n}_no" in numbers)
    return f"""WITH RECURSIVE {walk}, rolled AS (SELECT doc_id, {', '.join(numbers)}, arg_min(path, place) AS header_path, (min(line_start) + 1)::BIGINT AS start_line, max(line_end)::BIGINT AS end_line,
      string_agg(markdown, chr(10) || chr(10) ORDER BY place) FILTER (markdown <> '') AS md FROM {level} GROUP BY ALL)
    SELECT {ids[level]} AS chunk_id{ups}, header_path, start_line, end_line, ({TOKENS_OF.format('md')} + 256 * len(regexp_extract_all(md, '{IMG}')))::BIGINT AS token_count, md5(md) AS content_hash FROM rolled"""


def chunk_rows(t: Tables, level: str) -> DataFrame:
    c = S.chunk_tables(elements(t), levels=(level,))[level]
    ups = [u for u in ("big_chunk_id", "mid_chunk_id") if u in c.columns]
    return c.select("chunk_id", *ups, X.breadcrumb(F.col("header_path")).alias("header_path"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "token_count", "content_hash")


@query(chunk_sql(WALK_BIG, "big", ["big_no"]))
def big_chunks(t: Tables) -> DataFrame:
    return chunk_rows(t, "big")


@query(chunk_sql(WALK_MID, "mid", ["big_no", "mid_no"]))
def mid_chunks(t: Tables) -> DataFrame:
    return chunk_rows(t, "mid")


@query(chunk_sql(WALK_SMALL, "small", ["big_no", "mid_no", "small_no"]))
def small_chunks(t: Tables) -> DataFrame:
    return chunk_rows(t, "small")


@query(
    f"""WITH RECURSIVE src AS (SELECT doc_id AS eid, doc_id, 'paragraph' AS kind, text AS markdown, text, 1 AS tokens FROM documents WHERE {norm('text')} <> ''), {cut_sql('c', 'src', 'true', 1200)}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, i) - 1)::BIGINT AS part_no, md5(markdown) AS md5 FROM c"""
)
def split_paragraph(t: Tables) -> DataFrame:
    parts = spread(t.documents).select("doc_id", F.posexplode_outer(S.split_paragraph(F.col("text"), 1200)).alias("n", "part")).where("n IS NOT NULL")
    return parts.select("doc_id", F.col("n").cast("long").alias("part_no"), F.md5("part").alias("md5"))


OLD = "SELECT doc_id AS chunk_id, md5(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0"
NEW = "SELECT doc_id AS chunk_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0"


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"))
    new = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("chunk_id"), F.md5(F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END")).alias("content_hash"))
    return old, new


@query(
    f"""SELECT chunk_id, CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'removed' WHEN a.content_hash = b.content_hash THEN 'same' ELSE 'changed' END AS change
    FROM ({OLD}) a FULL JOIN ({NEW}) b USING (chunk_id)"""
)
def incremental_chunks(t: Tables) -> DataFrame:
    return S.incremental_chunks(*versions(t))


CACHE = "(SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)"


def plan(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"), "source")
    cache = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"), F.array(F.lit(1.0)).alias("vector"))
    return S.embedding_plan(chunks, cache)


@query(f"SELECT doc_id AS chunk_id, c.content_hash IS NULL AS todo FROM documents LEFT JOIN {CACHE} c ON md5(text) = c.content_hash")
def embedding_plan(t: Tables) -> DataFrame:
    return plan(t).select("chunk_id", "todo")


@query(f"SELECT source, count(*) AS n_chunks, count(c.content_hash) AS n_embedded FROM documents LEFT JOIN {CACHE} c ON md5(text) = c.content_hash GROUP BY source")
def dry_run_plan(t: Tables) -> DataFrame:
    return plan(t).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(~F.col("todo")).alias("n_embedded"))


@query(
    rf"""WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, regexp_extract(md, '!\[[^\]]*\]\(img/([^)]+)\)', 1) AS image, heading, text_before, text_after FROM (
      SELECT *, last_value(title IGNORE NULLS) OVER w AS heading, lag(md) OVER w AS text_before, lead(md) OVER w2 AS text_after FROM pathed
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no), w2 AS (PARTITION BY doc_id ORDER BY line_no)) WHERE regexp_matches(md, '{IMG}')"""
)
def image_context(t: Tables) -> DataFrame:
    return S.image_context(md_lines(t)).withColumn("line_no", F.col("line_no").cast("long"))
