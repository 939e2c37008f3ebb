"""Markdown documents as tables of lines, sections, elements and three levels of chunks.

All of it works per document on windows; documents are never gathered. Greedy packing is done by jumps: where the next group opens is found for every
row at once, by running sums, and the openings that count are reached by jumps of doubling width. Arrays that are dear to make go through outer generators, as the others have Spark make them once more for a filter on their size. A line job knows
ATX headings, fences, pipe tables, lists with lazy continuation, block quotes and paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.store import stored

# Sizes of big, mid and small chunks (target, most tokens), and images in a small one.
BIG, MID, SMALL = (900, 1200), (520, 760), (220, 320)
SMALL_IMAGES = 1
#: Tokens of the blank line between parts.
SEPARATOR = 1


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(text_col, "\r?\n", -1)).alias("line_no", "md"))
    return lines.where("line_no IS NOT NULL")


def structured_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, md) with: kind (effective), level (of headings), section_no, header_path, block_no.

    A heading pops all headings as deep or deeper, so the path holds the last heading of each level that
    comes after the last heading of any higher level."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = X.line_kind(F.col("md"))
    x = lines.withColumn("own", own)
    fences = F.coalesce(F.sum((F.col("own") == "fence").cast("int")).over(before), F.lit(0))
    x = x.withColumn("in_code", (fences % 2 == 1) | (F.col("own") == "fence")).withColumn("opens", (fences % 2 == 0) & (F.col("own") == "fence"))
    x = x.withColumn("own", F.when(F.col("in_code"), "code").otherwise(F.col("own")))
    starter = F.last(F.when(~F.col("own").isin("paragraph", "image"), F.col("own")), ignorenulls=True).over(past)
    loose = F.col("own").isin("paragraph", "image")
    x = x.withColumn("kind", F.when(loose & starter.isin("list", "block"), starter).when(loose, "paragraph").otherwise(F.col("own")))
    is_heading = F.col("kind") == "heading"
    x = x.withColumn("level", F.when(is_heading, F.length(F.regexp_extract("md", r"^\s*(#+)", 1))).cast("int"))
    x = x.withColumn("title", F.when(is_heading, X.normalize_text(F.regexp_replace("md", r"^\s*#+\s*|\s+#+\s*$", ""))))
    x = x.withColumn("section_no", F.sum(is_heading.cast("int")).over(past))
    for n in range(1, 7):
        here = F.col("level") == n
        x = x.withColumn(f"_p{n}", F.last(F.when(here, F.col("line_no")), ignorenulls=True).over(past)).withColumn(f"_t{n}", F.last(F.when(here, F.col("title")), ignorenulls=True).over(past))
    path = []
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"_p{m}"), F.lit(-1)) for m in range(1, n)]
        top = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        path.append(F.when(F.col(f"_p{n}") > top, F.col(f"_t{n}")))
    x = x.withColumn("header_path", F.filter(F.array(*path), lambda p: p.isNotNull() & (p != "")))
    new = is_heading | F.col("opens") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    x = x.withColumn("block_no", F.sum(new.cast("int")).over(past))
    return x.select("doc_id", "line_no", "md", "kind", "level", "title", "section_no", "header_path", "block_no")


def section_table(lines: DataFrame) -> DataFrame:
    """One row per section: its heading, path and lines; lines before any heading are section 0; blank ones are left out."""
    x = structured_lines(lines)
    return x.groupBy("doc_id", "section_no").agg(
        F.max("level").alias("level"), F.max("title").alias("heading"), F.min_by("header_path", "line_no").alias("header_path"),
        F.min("line_no").alias("line_start"), F.max(F.when(F.col("kind") != "blank", F.col("line_no"))).alias("last_line"),
    ).where("last_line IS NOT NULL").withColumn("line_end", F.col("last_line") + 1).drop("last_line")


def element_table(lines: DataFrame) -> DataFrame:
    """One row per element: kind, lines (start, end exclusive), markdown, text, tokens and images."""
    x = structured_lines(lines).where("kind <> 'blank'")
    grouped = x.groupBy("doc_id", "section_no", "block_no").agg(
        F.max("kind").alias("kind"), F.min("line_no").alias("line_start"), (F.max("line_no") + 1).alias("line_end"),
        F.max("level").alias("level"), F.max("title").alias("title"), F.min_by("header_path", "line_no").alias("header_path"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "md"))), lambda r: r["md"]), "\n").alias("raw"),
    )
    md = X.strip(F.col("raw"))
    kind = F.when((F.col("kind") == "paragraph") & md.rlike(X.IMAGE), "image").otherwise(F.col("kind"))
    return grouped.select(
        "doc_id", "section_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start")) - 1).alias("element_no"), kind.alias("kind"),
        "line_start", "line_end", "level", "title", "header_path", md.alias("markdown"),
        F.coalesce(F.col("title"), X.normalize_text(md)).alias("text"), X.markdown_tokens(md).alias("tokens"), X.image_refs(md).alias("images"),
    )


def _packed(items: Column, most: Column | int, joiner: str, separator: int, cut: Column | int, edges: str = X.SPACES) -> Column:
    """Greedy parts of texts: a part closes where the next would pass `most`; longer items are cut into windows."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("tokens"))
    flush = lambda acc: F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])

    def step(acc: Column, item: Column) -> Column:
        n = X.approx_tokens(item)
        more = F.when(acc["cur"] == "", n).otherwise(acc["tokens"] + separator + n)
        long = F.struct(F.concat(flush(acc), X.overlap_windows(item, cut, edges=edges)).alias("parts"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("tokens"))
        new = F.struct(flush(acc).alias("parts"), item.alias("cur"), n.alias("tokens"))
        on = F.struct(acc["parts"].alias("parts"), F.when(acc["cur"] == "", item).otherwise(F.concat(acc["cur"], F.lit(joiner), item)).alias("cur"), more.alias("tokens"))
        return F.when(n > most, long).when((acc["cur"] != "") & (more > most), new).otherwise(on)

    return F.aggregate(items, empty, step, flush)


def split_paragraph(text: Column, most: int, edges: str = X.SPACES) -> Column:
    return X.let(
        X.normalize_text(text),
        lambda value: F.when(X.approx_tokens(value) <= most, F.filter(F.array(value), lambda v: v != "")).otherwise(_packed(X.split_sentences(value), most, " ", 0, most, edges)),
    )


def list_items(md: Column) -> Column:
    """A list's items, each with the lines that belong to it."""
    mark = F.lit("\x01")
    lines = F.transform(F.split(md, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(X.LIST_ITEM), F.concat(mark, x)).otherwise(x)), "\n")
    return F.filter(F.transform(F.split(marked, "\x01"), X.strip), lambda x: x != "")


def split_list(md: Column, most: int) -> Column:
    return _packed(list_items(md), most, "\n", SEPARATOR, most)


def split_table(md: Column, most: int) -> Column:
    """Rows in parts; each part begins with the header and its rule. Lines and header are made once, not for each row."""
    lines = F.filter(F.transform(F.split(md, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: X.strip(x) != "")

    def cut(lines: Column) -> Column:
        head = F.concat_ws("\n", F.element_at(lines, 1), F.try_element_at(lines, F.lit(2)))
        return X.let(F.struct(head.alias("text"), X.approx_tokens(head).alias("tokens"), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))).alias("rows")), fold)

    def fold(given: Column) -> Column:
        head, head_tokens = given["text"], given["tokens"]
        empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"), head_tokens.alias("tokens"))
        flush = lambda acc: F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(F.concat(head, F.lit("\n"), acc["cur"])))).otherwise(acc["parts"])

        def step(acc: Column, row: Column) -> Column:
            n = X.approx_tokens(row)
            more = acc["tokens"] + n + F.when(acc["cur"] == "", 0).otherwise(SEPARATOR)
            long = F.struct(F.concat(flush(acc), X.overlap_windows(F.concat(head, F.lit("\n"), row), most)).alias("parts"), F.lit("").alias("cur"), head_tokens.alias("tokens"))
            new = F.struct(flush(acc).alias("parts"), row.alias("cur"), (head_tokens + n).alias("tokens"))
            on = F.struct(acc["parts"].alias("parts"), F.when(acc["cur"] == "", row).otherwise(F.concat(acc["cur"], F.lit("\n"), row)).alias("cur"), more.alias("tokens"))
            return F.when(n > most, long).when((acc["cur"] != "") & (more > most), new).otherwise(on)

        return F.aggregate(given["rows"], empty, step, flush)

    return X.let(lines, lambda lines: F.when(F.size(lines) <= 2, F.filter(F.array(X.strip(md)), lambda v: v != "")).otherwise(cut(lines)))


def split_code(md: Column, most: int) -> Column:
    """Windows of the body, each between the fences."""
    fence = "^(```+|~~~+)"

    def cut(value: Column) -> Column:
        return X.let(F.split(value, "\n"), lambda lines: F.when((F.size(lines) >= 2) & F.element_at(lines, 1).rlike(fence), fenced(lines)).otherwise(X.overlap_windows(value, most)))

    def fenced(lines: Column) -> Column:
        closed = F.element_at(lines, -1).rlike(fence)
        opening = F.element_at(lines, 1)
        closing = F.when(closed, F.element_at(lines, -1)).otherwise(F.substring(opening, 1, 3))
        body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - F.when(closed, 2).otherwise(1), F.lit(0))), "\n")
        width = 2 * F.greatest(F.lit(1).cast("long"), F.lit(most) - X.approx_tokens(F.concat_ws("\n", opening, closing)))

        def pieces(w: Column) -> Column:
            count = F.greatest(F.lit(1), F.ceil(F.length(w["body"]) / w["width"])).cast("int")
            return F.transform(F.sequence(F.lit(0), count - 1), lambda i: X.strip(F.substring(w["body"], (i * w["width"] + 1).cast("int"), w["width"].cast("int"))))

        parts = X.let(F.struct(body.alias("body"), width.alias("width")), pieces)
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat_ws("\n", opening, p, closing))

    return X.let(X.strip(md), cut)


def split_element(kind: Column, md: Column, text: Column, most: int, edges: str = X.SPACES) -> Column:
    """An element's parts: itself where it fits, else as its kind is split. `edges` are taken off the windows of a paragraph's long sentences."""
    return X.let(
        X.strip(md),
        lambda value: F.when(X.markdown_tokens(value) <= most, F.filter(F.array(value), lambda v: v != ""))
        .when(kind == "paragraph", split_paragraph(text, most, edges))
        .when(kind == "list", split_list(value, most))
        .when(kind == "table", split_table(value, most))
        .when(kind == "code", split_code(value, most))
        .when(X.approx_tokens(value) <= most, F.array(value))  # only its images' cost passes: a last odd character makes no window of its own
        .otherwise(X.overlap_windows(value, most)),
    )


def render_table(md: Column) -> Column:
    """A pipe table in regular form: rows padded to the widest, one rule after the header."""
    rows = F.filter(F.split(md, "\n"), lambda r: (X.strip(r) != "") & ~r.rlike(r"^\s*\|?[\s:|-]+\|?\s*$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(X.strip(r), r"^\||\|$", ""), r"(?<!\\)\|", -1), X.normalize_text))
    wide = F.array_max(F.transform(cells, F.size))
    row = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    lines = F.transform(cells, lambda c: row(F.concat(c, F.array_repeat(F.lit(""), wide - F.size(c)))))
    rule = row(F.array_repeat(F.lit("---"), wide))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise(F.lit(""))


def render_list(md: Column) -> Column:
    """A list with `-` or running numbers, two blanks for each depth, and continuations under their item's text."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array_repeat(F.lit(0), 20).alias("count"), F.lit("").alias("pad"))

    def step(acc: Column, line: Column) -> Column:
        depth = F.least(F.floor(F.length(F.regexp_extract(line, r"^(\s*)", 1)) / 2), F.lit(18)).cast("int")
        numbered = line.rlike(r"^\s*\d+[.)]\s+")
        body = F.regexp_replace(F.regexp_replace(line, r"^\s*([-+*]|\d+[.)])\s+", ""), r"\s+$", "")
        number = F.element_at(acc["count"], depth + 1) + 1
        marker = F.when(numbered, F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
        indent = F.repeat(F.lit("  "), depth)
        item = F.struct(
            F.concat(acc["out"], F.array(F.concat(indent, marker, F.lit(" "), body))).alias("out"),
            F.transform(acc["count"], lambda n, i: F.when(i < depth, n).when(i == depth, number).otherwise(0)).alias("count"),
            F.concat(indent, F.repeat(F.lit(" "), F.length(marker) + 1)).alias("pad"),
        )
        more = F.struct(F.concat(acc["out"], F.array(F.concat(acc["pad"], X.strip(line)))).alias("out"), acc["count"].alias("count"), acc["pad"].alias("pad"))
        return F.when(line.rlike(X.LIST_ITEM), item).when(X.strip(line) == "", acc).otherwise(more)

    return F.array_join(F.aggregate(F.split(md, "\n"), start, step, lambda acc: acc["out"]), "\n")


def _first(key: str, total: str, reach: int, with_it: bool) -> Column:
    """Place of the first row whose sum before it (with_it: whose sum with it) is `reach` more than the own sum before; n where there is none. Sums only
    grow, so the rows below that bound are counted instead of searched, by a frame that slides along."""
    below = F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(total).rangeBetween(Window.unboundedPreceding, reach - 1))
    if not with_it:
        return below
    return F.when((below < F.col("n")) | (F.col(f"{total}_all") >= F.col(total) + reach), below - 1).otherwise(F.col("n"))


def group_numbers(follows: Column) -> Column:
    """Numbers of the groups of a key's rows, from each row's `follows`: where the next group would open if one opened here. Jumps of doubling width are laid
    out as arrays, and the d-th opening is found by the bits of d."""
    size = F.size(follows)
    at = lambda jumps, v: F.when(v >= size, size).otherwise(F.get(jumps, v))
    double = lambda all_jumps, k: X.let(F.get(all_jumps, k - 1), lambda last: F.concat(all_jumps, F.array(F.transform(last, lambda v: at(last, v)))))
    levels = F.ceil(F.log2(size)).cast("int")
    jumps = F.aggregate(F.sequence(F.lit(1), levels), F.array(follows), double)
    opening = lambda js, d: F.aggregate(F.sequence(F.lit(0), F.size(js) - 1), F.lit(0), lambda v, k: F.when(F.getbit(d, k) == 1, at(F.get(js, k), v)).otherwise(v))
    openings = X.let(jumps, lambda js: F.filter(F.transform(F.sequence(F.lit(0), size - 1), lambda d: opening(js, d)), lambda v: v < size))
    spread_out = X.let(openings, lambda os: F.flatten(F.transform(os, lambda o, g: F.array_repeat(g, F.coalesce(F.get(os, g + 1), size) - o))))
    return F.when(size == 1, F.array(F.lit(0))).otherwise(spread_out)


def _cut(rows: DataFrame, keys: list[str], order: list[str], separator: int, reaches: dict[str, tuple[str, int, bool]], follows) -> DataFrame:
    """rows with group_no. Sums and places are windows over numbers only; `follows` (rows of a key, row) gives the place of the next opening."""
    placed = rows.withColumn("_key", F.struct(*keys)).withColumn("_pos", F.row_number().over(Window.partitionBy("_key").orderBy(*order)) - 1)
    pictures = F.size("images") if "images" in rows.columns else F.lit(0)
    text = F.col("kind") != "image" if "kind" in rows.columns else F.lit(True)
    x = placed.select("_key", F.col("_pos").alias("pos"), "tokens", pictures.alias("pictures"), text.alias("text"))
    past = Window.partitionBy("_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_key")
    x = x.withColumn("n", F.count(F.lit(1)).over(whole).cast("int"))
    for name, of in (("sums", F.col("tokens") + separator), ("pics", F.col("pictures").cast("long"))):
        x = x.withColumn(f"{name}_end", F.sum(of).over(past)).withColumn(name, F.col(f"{name}_end") - of).withColumn(f"{name}_all", F.sum(of).over(whole))
    ahead = Window.partitionBy("_key").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("text_at", F.coalesce(F.min(F.when(F.col("text"), F.col("pos"))).over(ahead), F.col("n")))
    for name, (total, reach, with_it) in reaches.items():
        x = x.withColumn(name, _first("_key", total, reach, with_it).cast("int"))
    of_key = x.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "tokens", "sums", "sums_end", "text_at", *reaches))).alias("e"))
    cut = of_key.select("_key", X.let(F.transform("e", lambda r: follows(F.col("e"), r)), group_numbers).alias("groups"))
    return placed.join(cut, "_key").withColumn("group_no", F.element_at("groups", F.col("_pos") + 1)).drop("_key", "_pos", "groups")


def _next_text(e: Column, r: Column, at: Column) -> Column:
    """The first row from `at` on that is no image."""
    return F.when(at >= r["n"], r["n"]).otherwise(F.get(e, at)["text_at"])


def pack_groups(rows: DataFrame, keys: list[str], order: list[str], target: int, most: int) -> DataFrame:
    """rows (tokens, kind) with group_no, coarse groups: a row opens a new one where the current has reached the target or would pass `most` with it
    and a separator; images never do."""
    after = lambda r: F.greatest(F.least(r["reached"], r["passed"]), r["pos"] + 1)
    return _cut(rows, keys, order, 0, {"reached": ("sums", target, False), "passed": ("sums", most - SEPARATOR + 1, True)}, lambda e, r: _next_text(e, r, after(r)))


def pack_entries(rows: DataFrame, keys: list[str], order: list[str], target: int, most: int, images: int | None = None) -> DataFrame:
    """rows (tokens, kind, images) with group_no: an entry opens a new group where the images pass their quota, the target is
    reached (not for an image), or the tokens with separators pass `most`."""
    reaches = {"reached": ("sums", target + SEPARATOR, False), "passed": ("sums", most + SEPARATOR + 1, True)}
    if images is not None:
        reaches["pictured"] = ("pics", images + 1, True)
    after = lambda r, c: F.greatest(r[c], r["pos"] + 1)
    return _cut(rows, keys, order, SEPARATOR, reaches, lambda e, r: F.least(_next_text(e, r, after(r, "reached")), *[after(r, c) for c in reaches if c != "reached"]))


def split_oversized(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """rows (tokens) with group_no: a part opens a new group where it would pass `most` and itself fits; a group that reaches `most` closes."""

    def follows(e: Column, r: Column) -> Column:
        at = F.greatest(r["full"], r["pos"])
        passes = lambda x: (x["sums_end"] - r["sums"] > most + SEPARATOR) & (x["tokens"] <= most)
        return F.when(at >= r["n"], r["n"]).otherwise(F.when((at > r["pos"]) & passes(F.get(e, at)), at).otherwise(at + 1))

    return _cut(rows, keys, order, SEPARATOR, {"full": ("sums", most + SEPARATOR, True)}, follows)


ENTRY = ("kind", "markdown", "text", "tokens", "images", "line_start", "line_end")


def _text() -> Column:
    """An entry's text, which is null on the way where it is its markdown, so that it is not dealt and written twice."""
    return F.coalesce("text", "markdown")


def big_entries(elements: DataFrame, size: tuple[int, int] = BIG) -> DataFrame:
    """Entries with section_no and group_no of their big chunk. The heading goes with its section's first group; a group that is then
    too large has its elements split and packed again."""
    target, most = size
    keys, order = ["doc_id", "section_no"], ["element_no"]
    fields = [*order, "header_path", "title", *ENTRY]
    packed = pack_groups(elements.where("kind <> 'heading'").select(*keys, *fields), keys, order, target, most)
    heads = elements.where("kind = 'heading'").select(*keys, *fields, F.lit(0).alias("group_no"))
    both = packed.select(*keys, *fields, "group_no").unionByName(heads)
    whole = Window.partitionBy(*keys, "group_no")
    total = F.floor(F.sum(F.length("markdown") + 2).over(whole) / 2) - 1 + 256 * F.sum(F.size("images")).over(whole)
    both = both.withColumn("oversized", (F.greatest(total, F.lit(1)) > most))
    parts = F.when(~F.col("oversized") | (F.col("kind") == "heading"), F.array("markdown")).when(F.col("tokens").between(1, most), F.array("markdown")).otherwise(split_element(F.col("kind"), F.col("markdown"), _text(), most))
    cut = both.select(*keys, F.col("group_no").alias("coarse_no"), "oversized", *[f for f in fields if f not in ("markdown", "tokens", "text")], _text().alias("whole"), F.size(parts).alias("n_parts"), F.posexplode_outer(parts).alias("part_no", "markdown")).where("part_no IS NOT NULL")
    cut = cut.withColumn("text", F.when(F.col("n_parts") == 1, F.nullif("whole", "markdown"))).drop("whole").withColumn("tokens", X.markdown_tokens(F.col("markdown")))
    cut = stored(cut.drop("n_parts"), "big_parts")
    return split_oversized(cut.where("oversized"), [*keys, "coarse_no"], ["element_no", "part_no"], most).unionByName(cut.where("NOT oversized").withColumn("group_no", F.lit(0)))


def roll(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Entries of each chunk joined: markdown and text by blank lines, images and kinds at their first place, span, tokens."""
    e = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "header_path", *ENTRY))).alias("e"))
    part = lambda f: F.transform("e", lambda x: x[f])
    md = F.array_join(F.filter(part("markdown"), lambda m: m != ""), "\n\n")
    return e.select(
        *keys, F.element_at("e", 1)["header_path"].alias("header_path"), md.alias("markdown"), F.array_join(F.filter(F.transform("e", lambda x: F.coalesce(x["text"], x["markdown"])), lambda m: m != ""), "\n\n").alias("text"),
        F.array_distinct(F.flatten(part("images"))).alias("images"), F.array_distinct(part("kind")).alias("element_kinds"),
        (F.array_min(part("line_start")) + 1).alias("start_line"), F.array_max(part("line_end")).alias("end_line"), X.markdown_tokens(md).alias("token_count"), X.content_hash(md).alias("content_hash"),
    )


def numbered(rows: DataFrame, parent: list[str], order: list[str], name: str) -> DataFrame:
    """Entries with the number of their chunk within its parent, from 0."""
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy(*parent).orderBy(*order)) - 1)


def _level(entries: DataFrame, keys: list[str], size: tuple[int, int], name: str, images: int | None = None) -> DataFrame:
    """Entries of a chunk, split where they are too large, packed into chunks one level down."""
    target, most = size
    own = [*ENTRY, "header_path"]
    parts = F.when(F.col("tokens").between(1, most), F.array("markdown")).otherwise(split_element(F.col("kind"), F.col("markdown"), _text(), most))
    cut = entries.select(*keys, F.struct(*[c for c in ("element_no", "part_no", "sub_no") if c in entries.columns]).alias("place"), *[c for c in own if c not in ("markdown", "tokens", "text")], _text().alias("whole"), F.size(parts).alias("n"), F.posexplode_outer(parts).alias("cut_no", "markdown")).where("cut_no IS NOT NULL")
    cut = cut.withColumn("text", F.when(F.col("n") == 1, F.nullif("whole", "markdown"))).drop("whole").withColumn("tokens", X.markdown_tokens(F.col("markdown")))
    rows = pack_entries(stored(cut, f"{name}_parts"), keys, ["place", "cut_no"], target, most, images).drop("n")
    at = Window.partitionBy(*keys).orderBy("place", "cut_no")
    return rows.withColumn("sub_no", F.row_number().over(at)).withColumnRenamed("group_no", name).drop("place", "cut_no")


def chunk_tables(elements: DataFrame, big: tuple[int, int] = BIG, mid: tuple[int, int] = MID, small: tuple[int, int] = SMALL, levels: tuple[str, ...] = ("big", "mid", "small")) -> dict[str, DataFrame]:
    """Tables big, mid and small, or those levels of them, with ids that carry the numbers of the chunks above. What several of them need is written once."""
    four = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    doc = F.col("doc_id").cast("string")
    lean = stored(elements.withColumn("text", F.nullif("text", "markdown")), "elements")
    b = numbered(big_entries(lean, big), ["doc_id"], ["section_no", "coarse_no", "group_no"], "big_no")
    b = stored(b, "big_entries") if "big" in levels and len(levels) > 1 else b
    m = _level(b, ["doc_id", "big_no"], mid, "mid_no") if levels != ("big",) else None
    m = stored(m, "mid_entries") if "small" in levels and "mid" in levels else m
    s = _level(m, ["doc_id", "big_no", "mid_no"], small, "small_no", SMALL_IMAGES) if "small" in levels else None
    big_id = F.concat(doc, F.lit("_big_"), four("big_no"))
    mid_id = F.concat(doc, F.lit("_mid_"), four("big_no"), F.lit("_"), four("mid_no"))
    small_id = F.concat(doc, F.lit("_small_"), four("big_no"), F.lit("_"), four("mid_no"), F.lit("_"), four("small_no"))
    tables = {}
    if "big" in levels:
        tables["big"] = roll(b, ["doc_id", "big_no"], ["section_no", "coarse_no", "group_no", "element_no", "part_no"]).withColumn("chunk_id", big_id)
    if "mid" in levels:
        tables["mid"] = roll(m, ["doc_id", "big_no", "mid_no"], ["sub_no"]).withColumn("chunk_id", mid_id).withColumn("big_chunk_id", big_id)
    if "small" in levels:
        tables["small"] = roll(s, ["doc_id", "big_no", "mid_no", "small_no"], ["sub_no"]).withColumn("chunk_id", small_id).withColumn("big_chunk_id", big_id).withColumn("mid_chunk_id", mid_id)
        tables["small"] = tables["small"].withColumn("embedding_payload", X.embedding_payload(F.col("text"), F.col("images")))
    return {level: tables[level] for level in levels}


def incremental_chunks(old: DataFrame, new: DataFrame, id_col: str = "chunk_id", hash_col: str = "content_hash") -> DataFrame:
    """(chunk_id, change): added, removed, changed or same."""
    a, b = old.select(F.col(id_col).alias("chunk_id"), F.col(hash_col).alias("old_hash")), new.select(F.col(id_col).alias("chunk_id"), F.col(hash_col).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    return a.join(b, "chunk_id", "full").select("chunk_id", change.alias("change"))


def embedding_plan(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (chunk_id, content_hash) with the cached vector of equal content; todo where there is none."""
    known = cache.groupBy("content_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return chunks.join(known, "content_hash", "left").withColumn("todo", F.col("vector").isNull())


def image_context(lines: DataFrame) -> DataFrame:
    """Each image line with its nearest heading above and the lines around."""
    x = structured_lines(lines)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("heading", F.last("title", ignorenulls=True).over(past)).withColumn("text_before", F.lag("md").over(w)).withColumn("text_after", F.lead("md").over(w))
    return x.where(F.col("md").rlike(X.IMAGE)).select("doc_id", "line_no", F.element_at(X.image_refs(F.col("md")), 1).alias("image"), "heading", "text_before", "text_after")
