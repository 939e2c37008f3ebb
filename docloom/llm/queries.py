"""The registered query of each operator: whole tables in, the full result out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import audit, dedup, digest, html, langid, media, mixing, packing, quality, secrets, simhash, spelling, suffix_lm
from docloom.llm.common import table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_rows(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_rows(table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_rows(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_packing": op3_packing,
    "op5_digest": op5_digest,
    "op6_mixing": op6_mixing,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_matroska": op8_matroska,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op4_simhash": op4_simhash,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_dedup": op13_exact_dedup,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 by its table of 256 remainders, over the bytes of a text.
CRC32_MACROS = """
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
crcs AS (SELECT doc_id, run, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, 2 * k + 1, 2))::BIGINT for k in range(length(x) // 2)]),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM (SELECT doc_id, run, hex(encode(doc_id || ':' || run)) AS x FROM per_doc), tab)"""

SPELLING_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), {CRC32_MACROS},
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crcs JOIN per_doc USING (doc_id, run)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
bags AS (SELECT word, n, word AS key, -1 AS i FROM words UNION ALL SELECT word, n, substr(word, 1, i) || substr(word, i + 2), i FROM less),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM bags a JOIN bags b USING (key) WHERE a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * words.n THEN other END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN best ON best.word = words.word AND k = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = root WHERE form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.root AND r.form IS NULL"""

FILTER_AUDIT_SQL = r"""
WITH w AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels USING (doc_id)),
masks AS (SELECT part, good, toxic, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM w),
sums AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, k AS step, 1 << o[k] AS bit, list_sum(list_transform(o[:k], lambda x: 1 << x))::INT AS after, coalesce(list_sum(list_transform(o[:k - 1], lambda x: 1 << x)), 0)::INT AS before
  FROM orders, range(1, 6) AS r(k)),
x AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & after = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM sums, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""

EXACT_DEDUP_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents) WINDOW w AS (PARTITION BY norm)"""

#: The other operators' results can't be said in SQL alone; tests/llm holds each against a brute-force version.
SQL: dict[str, str] = {"op11_spelling": SPELLING_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_exact_dedup": EXACT_DEDUP_SQL}
