"""Joins that need a shape of their own: interval overlap, as-of lookups, and lookups with a second choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.store import stored

# Life of a cache entry, candidates looked at, entries kept.
TTL_SECONDS, CANDIDATES, KEPT = 3600, 5, 50
#: Words of a run that passages are found by, runs up to which they are broadcast (numbers only), and what is between words.
GRAM, FEW, GAP = 3, 2_000_000, r"\s+"


def evidence_to_chunks(evidence: DataFrame, spans: DataFrame, bin_size: int = 512) -> DataFrame:
    """evidence (doc_id, ref_id, start, end) and spans (doc_id, chunk_id, start, end), both inclusive: pairs that overlap.

    Both sides are cut into bins, so the join has keys even within one huge document; a pair is kept in the first bin that both share."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    e = evidence.select("doc_id", "ref_id", F.col("start").alias("es"), F.col("end").alias("ee")).withColumn("bin", cut("es", "ee"))
    s = spans.select("doc_id", "chunk_id", F.col("start").alias("ss"), F.col("end").alias("se")).withColumn("bin", cut("ss", "se"))
    first = F.floor(F.greatest("es", "ss") / bin_size)
    return e.join(s, ["doc_id", "bin"]).where((F.col("es") <= F.col("se")) & (F.col("ee") >= F.col("ss")) & (F.col("bin") == first)).select("doc_id", "ref_id", "chunk_id")


def _inner(text: Column) -> Column:
    """Words of a text but for the first and the last, which can be parts of words elsewhere."""
    return X.let(F.split(text, GAP, -1), lambda ws: F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0))))


def _grams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "), F.lit(n)))


def passages_in(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """texts (doc_id, text) and passages (ref_id, passage): (doc_id, ref_id, start, end) of every occurrence, overlapping ones too; places from 1, end inclusive.

    Of each passage the rarest run of GRAM words inside it, or the rarest word where there are fewer, is the key by which texts are found; runs are
    counted in the texts themselves, those of no passage go before any shuffle as far as the passages' runs are few. Found texts are verified. Passages without a
    whole word inside are searched in every text. Null and empty ones occur nowhere."""
    spark, given = texts.sparkSession, passages.where("passage <> ''").withColumn("inner", _inner(F.col("passage")))
    sized = F.when(F.size("inner") >= GRAM, GRAM).when(F.size("inner") >= 1, 1).otherwise(0)
    given = stored(given.select("ref_id", "passage", "inner", sized.alias("size")), "passages")
    sizes = {r["size"] for r in given.select("size").distinct().collect()}
    found = None
    for n in sorted(sizes - {0}):
        asked = stored(given.where(F.col("size") == n).select("ref_id", F.explode(F.array_distinct(_grams(F.col("inner"), n))).alias("gram")), "grams")
        wanted = stored(asked.select("gram").distinct(), "wanted")
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        words = texts.select("doc_id", F.xxhash64("text").alias("of"), F.split("text", GAP, -1).alias("words")).where(F.size("words") >= n)
        runs = words.select("doc_id", "of", F.explode_outer(_grams(F.col("words"), n)).alias("gram")).join(wanted, "gram", "left_semi")
        runs = stored(runs.distinct(), "runs")
        counted = asked.join(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "gram", "left")
        rarest = counted.groupBy("ref_id").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least")).where("least.texts > 0").select("ref_id", F.col("least.gram").alias("gram"))
        pairs = runs.join(rarest, "gram").select("doc_id", "of", "ref_id").distinct()
        found = pairs if found is None else found.unionByName(pairs)
    if 0 in sizes:
        short = given.where("size = 0").select("ref_id", F.col("passage").alias("short"))
        pairs = texts.join(short, F.contains("text", F.col("short"))).select("doc_id", F.xxhash64("text").alias("of"), "ref_id").distinct()
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = spark.createDataFrame([], T.StructType([texts.schema["doc_id"], T.StructField("of", T.LongType()), passages.schema["ref_id"]]))
    # texts by id and hash: rows that share an id are told apart
    whole = texts.select(F.struct("doc_id", F.xxhash64("text").alias("of")).alias("key"), "text")
    both = found.select(F.struct("doc_id", "of").alias("key"), "ref_id").join(whole, "key").join(given.select("ref_id", "passage"), "ref_id")
    return both.select("key.doc_id", "ref_id", F.length("passage").cast("long").alias("n"), F.explode(occurrences(F.col("text"), F.col("passage"))).alias("start")).select(
        "doc_id", "ref_id", "start", (F.col("start") + F.col("n") - 1).alias("end")
    )


def occurrences(text: Column, part: Column) -> Column:
    """Places, from 1, of all occurrences of a part, overlapping ones too."""
    ahead = F.concat(F.lit("(?="), F.regexp_replace(part, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(")"))
    step = lambda places, k: F.concat(places, F.array(F.position(part, text, F.coalesce(F.get(places, F.size(places) - 1), F.lit(0)).cast("int") + 1).cast("long")))
    times = F.regexp_count(text, ahead)
    return F.when(times == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.sequence(F.lit(1), times), F.array().cast("array<bigint>"), step))


def cache_exact_lookup(requests: DataFrame, entries: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """requests (request_id, key, ts), entries (entry_id, key, ts): the newest entry of the key that is not too old.

    Requests and entries of a key are read once in time order, so no pairs are made."""
    e = entries.select("key", F.col("ts").alias("at"), F.lit(0).alias("order"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.struct(F.col("ts").alias("ets"), "entry_id").alias("entry"))
    r = requests.select("key", F.col("ts").alias("at"), F.lit(1).alias("order"), "request_id", F.lit(None).cast(e.schema["entry"].dataType).alias("entry"))
    w = Window.partitionBy("key").orderBy("at", "order", "entry.entry_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = e.unionByName(r).withColumn("last", F.last("entry", ignorenulls=True).over(w)).where("order = 1")
    fresh = F.col("last.ets") > F.col("at") - F.make_dt_interval(secs=F.lit(ttl))
    return last.select("request_id", F.when(fresh, F.col("last.entry_id")).alias("entry_id"), F.coalesce(fresh, F.lit(False)).alias("hit"))


def cache_candidates(requests: DataFrame, entries: DataFrame, most: int = CANDIDATES, bin: str = "hour") -> DataFrame:
    """The newest entries of the same model before each request, at most `most`: (request_id, entry_id, rank).

    A model's time is cut into bins, each of which is scanned alone, so a model with a third of all requests is many tasks. What a bin hands on is its `most`
    newest entries; carried over the bins (a row for each), they complete the requests that their own bin leaves short."""
    e = entries.select("model", F.col("ts").alias("at"), F.lit(1).alias("order"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.col("entry_id"))
    r = requests.select("model", F.col("ts").alias("at"), F.lit(0).alias("order"), "request_id", F.lit(None).cast(e.schema["entry_id"].dataType).alias("entry_id"))
    both = e.unionByName(r).withColumn("bin", F.date_trunc(bin, "at"))
    own = Window.partitionBy("model", "bin")
    seen = both.withColumn("n", F.count("entry_id").over(own.orderBy("at", "order", "entry_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.count("entry_id").over(own))
    seen = stored(seen, "seen")
    numbered, asked = seen.where("order = 1").select("model", "bin", "entry_id", F.col("n").alias("no"), "all"), seen.where("order = 0").select("model", "bin", "request_id", "n")
    places = asked.where("n > 0").select("model", "bin", "request_id", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - most + 1), F.col("n"))).alias("no"))
    near = places.join(numbered, ["model", "bin", "no"]).select("request_id", "entry_id", (F.col("n") - F.col("no") + 1).alias("rank"))

    last = numbered.where(F.col("no") > F.col("all") - most).groupBy("model", "bin").agg(F.sort_array(F.collect_list(F.struct("no", "entry_id")))["entry_id"].alias("ids"))
    bins = Window.partitionBy("model").orderBy("bin")
    tail = F.flatten(F.collect_list("ids").over(bins.rowsBetween(1 - most, Window.currentRow)))
    upto = last.withColumn("upto", F.slice(tail, F.greatest(F.lit(1), F.size(tail) - most + 1), most))
    # of each bin with requests: what the last bin with entries before it hands on
    known = asked.select("model", "bin").distinct().join(upto.select("model", "bin", "upto"), ["model", "bin"], "full")
    carried = known.withColumn("carried", F.last("upto", ignorenulls=True).over(bins.rowsBetween(Window.unboundedPreceding, -1))).where("carried IS NOT NULL").select("model", "bin", "carried")
    far = asked.where(F.col("n") < most).join(carried, ["model", "bin"]).select("request_id", "n", F.posexplode(F.reverse("carried")).alias("pos", "entry_id"))
    far = far.where(F.col("n") + F.col("pos") < most).select("request_id", "entry_id", (F.col("n") + F.col("pos") + 1).alias("rank"))
    return near.unionByName(far)


def bounded_recent(entries: DataFrame, key: str = "model", most: int = KEPT) -> DataFrame:
    """The newest `most` entries of each key. Spark limits the groups in each task before it shuffles, so a hot key hands on no more than `most` rows a task."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("entry_id"))
    return entries.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def cache_entries(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """requests with hit: only a miss writes an entry, and a hit does not renew it. An ordered fold over each key."""
    r = requests.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("at"), "request_id"))).alias("rs"))
    start = F.struct(F.lit(None).cast("double").alias("entry"), F.array().cast("array<boolean>").alias("hits"))
    step = lambda acc, x: F.struct(
        F.when(acc["entry"].isNotNull() & (x["at"] - acc["entry"] < ttl), acc["entry"]).otherwise(x["at"]).alias("entry"),
        F.concat(acc["hits"], F.array(acc["entry"].isNotNull() & (x["at"] - acc["entry"] < ttl))).alias("hits"),
    )
    hits = F.aggregate("rs", start, step, lambda acc: acc["hits"])
    return r.select("key", F.inline_outer(F.arrays_zip("rs", hits.alias("hit")))).select("rs.request_id", "key", "hit")


def resolve_images(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs (…, image): path by exact name first, then by base name, else null."""
    from docloom.functions.text import path_name

    exact = inventory.select(F.col("path").alias("image"), F.col("path").alias("exact")).distinct()
    by_name = inventory.groupBy(path_name(F.col("path")).alias("name")).agg(F.min("path").alias("loose"))
    return refs.join(exact, "image", "left").withColumn("name", path_name(F.col("image"))).join(by_name, "name", "left").withColumn("path", F.coalesce("exact", "loose")).drop("exact", "loose", "name")


def missing_images(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    return refs.select("image").distinct().join(inventory.select(F.col("path").alias("image")), "image", "left_anti")


def append_expanded(hits: DataFrame, expanded: DataFrame) -> DataFrame:
    """Expanded hits that are not yet there, with ranks that go on after the query's last."""
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    new = expanded.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(last, "query_id", "left")
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    new = new.withColumn("rank", (F.row_number().over(w) + F.coalesce("last", F.lit(0))).cast("int"))
    both = ["query_id", "chunk_id", "rank"]
    return hits.select(*both, F.lit("hybrid").alias("source")).unionByName(new.select(*both, F.lit("graph").alias("source")))
