"""Views over the given tables that stand in for manuals, chunks, questions and requests; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.registry import Tables
from docloom.store import spread

#: Markdown of a line, by its place in the document; short lines make headings.
MD_CASE = """CASE WHEN i % 12 = 0 AND length(line) <= 60 THEN concat('# ', line)
     WHEN i % 4 = 0 AND length(line) <= 60 THEN concat('## ', line)
     WHEN i % 9 = 5 THEN concat('![fig](img/D', doc_id, '_', i, '.png)')
     WHEN i % 6 IN (1, 2) THEN concat('- ', line)
     ELSE line END"""

MD_LINES = f"""md_lines AS (
  SELECT doc_id, i AS line_no, {MD_CASE} AS md FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


def md_lines(t: Tables) -> DataFrame:
    lines = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line")).where("i IS NOT NULL")
    return lines.select("doc_id", F.col("i").alias("line_no"), F.expr(MD_CASE).alias("md"))


MD_DOCS = MD_LINES + ", md_docs AS (SELECT doc_id, string_agg(md, chr(10) ORDER BY line_no) AS md FROM md_lines GROUP BY doc_id)"


def md_docs(t: Tables) -> DataFrame:
    """Whole markdown documents, made in place."""
    made = f"array_join(transform(split(text, '\\n', -1), (line, i) -> {MD_CASE}), '\\n')"
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.expr(made).alias("md"))


TURNS = """turns AS (
  SELECT conv_id, turn, text AS user_message, next_text AS assistant_message FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
