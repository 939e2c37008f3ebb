"""Contexts, answers and routing as tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import let, truncate_ellipsis

RULE = "\n\n---\n\n"


def assemble_context(blocks: DataFrame, max_tokens: int = 12000) -> DataFrame:
    """blocks (query_id, rank, block): joined up to 3 characters a token. The first always stays; at the first that does not fit, a notice
    says how many are shown, and the rest is left out."""
    w = Window.partitionBy("query_id").orderBy("rank")
    upto = F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = blocks.withColumn("i", F.row_number().over(w)).withColumn("fits", (upto <= 3 * max_tokens) | (F.col("i") == 1))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("i", "block", "fits"))), lambda b: b["fits"])
    g = x.groupBy("query_id").agg(kept.alias("kept"), F.count(F.lit(1)).alias("n"))
    # Fixed value: the notice.
    notice = F.format_string("\n... (截断，共 %d 个结果，仅展示前 %d 个)", F.col("n"), F.size("kept"))
    parts = F.concat(F.transform("kept", lambda b: b["block"]), F.when(F.size("kept") < F.col("n"), F.array(notice)).otherwise(F.array().cast("array<string>")))
    return g.select("query_id", F.array_join(parts, RULE).alias("context"), F.size("kept").cast("long").alias("shown"), F.col("n").cast("long").alias("found"))


def format_block(doc: str, title: str, chunk: str, content: str, source: str) -> Column:
    # The words of a block.
    return F.concat(F.lit("["), F.col(doc), F.lit("] "), F.col(title), F.lit(" (小块: "), F.col(chunk).cast("string"), F.lit(")\n  来源："), F.col(source), F.lit("\n  内容：\n"), F.col(content))


def format_context(evidence: DataFrame, max_chars: int, language: str = "en") -> DataFrame:
    """evidence (query_id, rank, item struct with a field text): a JSON list within max_chars. The first item that does not fit has its
    text cut to what does, if anything does, and is the last."""
    names = [f.name for f in evidence.schema["item"].dataType.fields]
    shell = len('{"language":"' + language + '","evidence":[]}')
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit(shell).alias("used"), F.lit(False).alias("done"))

    def with_text(item: Column, text: Column) -> Column:
        return F.to_json(F.struct(*[(text if n == "text" else item[n]).alias(n) for n in names]))

    def step(acc: Column, e: Column) -> Column:
        item = e["item"]
        comma = F.when(F.size(acc["items"]) > 0, 1).otherwise(0)
        whole = F.to_json(item)
        room = F.lit(max_chars) - acc["used"] - comma
        # a longer cut never has shorter JSON, so the longest that fits is found by halving what is left of the lengths
        fits_at = lambda n: F.length(with_text(item, _cut(item["text"], n))) <= room

        def halve(at: Column, _: Column) -> Column:
            upper, lower = lambda n: F.struct(n.alias("lo"), at["hi"].alias("hi")), lambda n: F.struct(at["lo"].alias("lo"), (n - 1).alias("hi"))
            middle = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
            return F.when(at["lo"] >= at["hi"], at).otherwise(let(middle, lambda n: F.when(fits_at(n), upper(n)).otherwise(lower(n))))

        whole_range = F.struct(F.lit(0).alias("lo"), F.greatest(F.length(item["text"]) - 1, F.lit(0)).alias("hi"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(31)), whole_range, halve, lambda at: at["lo"])
        best = F.nullif(found, F.lit(0))
        cut = with_text(item, _cut(item["text"], best))
        fits = F.length(whole) <= room
        new = F.when(fits, whole).otherwise(cut)
        return F.when(acc["done"], acc).when(
            ~fits & best.isNull(), F.struct(acc["items"].alias("items"), acc["used"].alias("used"), F.lit(True).alias("done"))
        ).otherwise(F.struct(F.concat(acc["items"], F.array(new)).alias("items"), (acc["used"] + comma + F.length(new)).alias("used"), (~fits).alias("done")))

    g = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("es"))
    items = F.aggregate("es", start, step, lambda acc: acc["items"])
    return g.select("query_id", F.concat(F.lit('{"language":"' + language + '","evidence":['), F.array_join(items, ","), F.lit("]}")).alias("context"))


def _cut(text: Column, n: Column) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.left(text, F.greatest(n - 3, F.lit(0)))), F.lit("...")))


def collect_images(hits: DataFrame, most: int = 20) -> DataFrame:
    """hits (query_id, rank, images array): unique images in the order of their first hit, at most `most`."""
    x = hits.select("query_id", "rank", F.posexplode("images").alias("pos", "image"))
    first = x.groupBy("query_id", "image").agg(F.min(F.struct("rank", "pos")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "image")
    return first.withColumn("image_no", F.row_number().over(w)).where(F.col("image_no") <= most).select("query_id", "image_no", "image")


def image_manifest(images: DataFrame) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list(F.struct("image_no", "image"))), lambda x: F.concat(F.lit("- "), x["image"]))
    return images.groupBy("query_id").agg(F.array_join(ids, "\n").alias("manifest"))


def ensemble_merge(answers: DataFrame) -> DataFrame:
    """answers (query_id, level, content): the one of small, else mid, else big; blank ones do not count."""
    order = F.when(F.col("level") == "small", 0).when(F.col("level") == "mid", 1).otherwise(2)
    return answers.where(F.trim("content") != "").groupBy("query_id").agg(F.min_by(F.struct("level", "content"), order).alias("a")).select("query_id", "a.level", "a.content")


def route_queries(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """queries (query_id, n_images): `manual` with images, else as predicted (query_id, label), else `manual`."""
    known = predictions.where(F.col("label").isin("manual", "general")).select("query_id", "label")
    return queries.join(known, "query_id", "left").select("query_id", F.when(F.col("n_images") > 0, "manual").otherwise(F.coalesce("label", F.lit("manual"))).alias("route"))


def sanity_checks(answers: DataFrame, least: int = 10, most: int = 5000) -> DataFrame:
    """answers (…, content, images array, keywords array): six checks and their conjunction."""
    c = F.col("content")
    pics = F.regexp_count(c, F.lit("<PIC>"))
    checks = {
        "not_empty": F.trim(c) != "", "length_ok": F.length(c).between(least, most), "keyword_found": (F.size("keywords") == 0) | F.exists("keywords", lambda k: F.contains(c, k)),
        "pics_match": pics == F.size("images"), "no_marker": ~c.rlike(r"图片[：:]"), "no_json": ~c.rlike(r"^\s*[{\[]"),
    }
    out = answers.withColumns(checks)
    whole = None
    for name in checks:
        whole = F.col(name) if whole is None else whole & F.col(name)
    return out.withColumn("all_ok", whole)


# Words of checkpoints, and of answers that meet them.
IMPLIED, NO_REPEAT, RESOLVED, CONTROLS, POLICY = "路由|检索", "不重复", "消解|指代", "按钮|模式", "通用|退货"
REPEATED, OTHERS, CONTROL_WORDS, POLICY_WORDS = "滤网", "其他", "模式|按钮|mode|button|press|按", "退货|退换|return"


def dialogue_checks(turns: DataFrame) -> DataFrame:
    """turns (dialogue, turn, answer, rewritten, checks array): each checkpoint by the class of its words, in this order: routing and retrieval are
    implied by an answer; no repeat of the first topic at the answer's start; a resolved reference shows in a rewritten question or a longer
    answer; controls and policy by their words; else any answer of some length."""
    x = turns.select("dialogue", "turn", "answer", "rewritten", F.explode("checks").alias("check"))
    a, c = F.col("answer"), F.col("check")
    ok = (
        F.when(c.rlike(IMPLIED), True)
        .when(c.rlike(NO_REPEAT), ~F.contains(F.left(a, F.lit(200)), F.lit(REPEATED)) | F.contains(a, F.lit(OTHERS)))
        .when(c.rlike(RESOLVED), (F.length(F.coalesce("rewritten", F.lit(""))) > 0) | (F.length(a) > 50))
        .when(c.rlike(CONTROLS), F.lower(a).rlike(CONTROL_WORDS))
        .when(c.rlike(POLICY), F.lower(a).rlike(POLICY_WORDS))
        .otherwise(F.length(a) > 20)
    )
    return x.groupBy("dialogue", "turn").agg(F.bool_and(ok).alias("ok"), F.count(F.lit(1)).alias("checks"))


def batch_records(queries: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: success, retrieved ids in rank order, images."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"])
    got = hits.groupBy("query_id").agg(ids.alias("retrieved"))
    a = answers.select("query_id", "content", "images", F.lit(True).alias("answered"))
    return queries.join(got, "query_id", "left").join(a, "query_id", "left").select(
        *queries.columns, F.coalesce("answered", F.lit(False)).alias("success"), F.coalesce("retrieved", F.array().cast("array<" + hits.schema["chunk_id"].dataType.simpleString() + ">")).alias("retrieved"), "content", "images"
    )


def chunk_to_evidence(rank: Column, doc: Column, path: Column, title: Column, text: Column, content: Column, images: Column, text_most: int = 4000) -> Column:
    return F.struct(
        rank.alias("rank"), doc.alias("doc"), F.array_join(path, " > ").alias("path"), F.coalesce(title, F.element_at(path, -1)).alias("title"),
        truncate_ellipsis(F.coalesce(content, text, F.lit("")), text_most).alias("text"), F.transform(images, lambda i: F.regexp_replace(F.element_at(F.split(i, "/"), -1), r"\.[^.]*$", "")).alias("images"),
    )
