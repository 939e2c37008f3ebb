"""Column functions for manual text, markdown, paths, references and prompts. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular-expression class: ASCII and Unicode, as Python strips it.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters, as a string.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: Blanks within a line, without line ends: Unicode's space separators.
BLANKS = " \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
# Patterns of image links, list items and sentence ends.
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
LIST_ITEM = r"^(\s*)([-+*]|\d+[.)])\s+"
SENTENCE_END = r"(?<=[.!?。！？;；])\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_text(c: Column) -> Column:
    """No byte-order marks, single blanks, at most one empty line, stripped."""
    c = F.replace(c, F.lit("\ufeff"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def content_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def safe_id(c: Column, prefix: str = "id") -> Column:
    """A readable slug of at most 80 characters and 12 digits of the md5; the prefix where no slug begins with a letter."""
    digest = F.substring(content_hash(c), 1, 12)
    slug = F.regexp_replace(F.regexp_replace(strip(c), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.when(slug.rlike("^[A-Za-z]"), F.concat_ws("_", F.substring(slug, 1, 80), digest)).otherwise(F.concat_ws("_", F.lit(prefix), digest))


def exact_key(fields: dict[str, Column], namespace: str) -> Column:
    """sha-256 of the request's JSON with sorted keys, within a namespace."""
    return F.concat(F.lit(namespace), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))


def approx_tokens(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def markdown_tokens(c: Column, image_cost: int = 256) -> Column:
    """Tokens of the markdown, and a fixed cost for each image in it."""
    def count(value: Column) -> Column:
        tokens = approx_tokens(value) + F.regexp_count(value, F.lit(IMAGE)) * image_cost
        return F.when(F.length(value) == 0, F.lit(0).cast("long")).otherwise(tokens).cast("long")

    return let(strip(c), count)


def path_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def path_stem(c: Column) -> Column:
    return F.regexp_replace(path_name(c), r"(?<=.)\.[^.]*$", "")


def ordered_unique(a: Column) -> Column:
    """Stripped, non-empty items at their first place."""
    return F.array_distinct(F.filter(F.transform(a, strip), lambda x: x != ""))


def image_refs(c: Column) -> Column:
    return ordered_unique(F.transform(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(1)), lambda x: path_name(F.trim(x))))


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_text(c), SENTENCE_END), strip), lambda x: x != "")


def overlap_windows(c: Column, max_tokens: int, overlap_tokens: int = 0, edges: str = SPACES) -> Column:
    """Windows of 2 * max_tokens characters that overlap; the last is the first to cover the end. `edges` are taken off each window."""
    width = max(1, 2 * max_tokens)
    step = max(1, width - 2 * max(0, min(overlap_tokens, max_tokens - 1)))

    def cut(value: Column) -> Column:
        n = F.length(value)
        last = F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.btrim(F.substring(value, i * step + 1, F.lit(width)), F.lit(edges)))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= width, F.array(value)).otherwise(F.filter(pieces, lambda p: p != ""))

    return let(strip(c), cut)


def line_kind(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^\s*$"), "blank")
        .when(c.rlike(r"^ {0,3}#{1,6}(\s|$)"), "heading")
        .when(c.rlike(r"^ {0,3}(```+|~~~+)"), "fence")
        .when(c.rlike(LIST_ITEM), "list")
        .when(c.rlike(r"^\s*\|"), "table")
        .when(c.rlike(IMAGE), "image")
        .when(c.rlike(r"^\s*>"), "block")
        .otherwise("paragraph")
    )


def breadcrumb(path: Column) -> Column:
    return F.array_join(F.filter(path, lambda x: strip(x) != ""), " > ")


def retrieval_prefix(doc_name: Column, path: Column, big: Column | None = None, mid: Column | None = None) -> Column:
    """One line each for manual, section, and the chunks above; the words are those of the chunk format."""
    lines = [F.concat(F.lit("手册："), doc_name), F.when(F.size(path) > 0, F.concat(F.lit("章节："), breadcrumb(path)))]
    lines += [F.concat(F.lit("大块："), big)] if big is not None else []
    lines += [F.concat(F.lit("中块："), mid)] if mid is not None else []
    return F.concat_ws("\n", *lines)


def product_name(doc_name: Column) -> Column:
    return F.replace(doc_name, F.lit("手册"), F.lit(""))


def truncate_ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, max(n - 3, 0)), f"{SPACE}+$", ""), F.lit("...")))


def line_ranges(c: Column) -> Column:
    """Array of (start, end) from `N`, `N-M` with any usual dash, lists of these by comma, in brackets or not."""
    parts = F.transform(F.split(F.regexp_replace(c, r"[\[\]()\s]", ""), "[,，、]"), lambda p: F.regexp_replace(p, "[–—～~]", "-"))
    return F.transform(
        F.filter(parts, lambda p: p.rlike(r"^\d+(-\d+)?$")),
        lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("start_line"), F.element_at(F.split(p, "-"), -1).cast("int").alias("end_line")),
    )


def extract_json(c: Column) -> Column:
    """The JSON of a reply: code fences off, else the span from the first { to the last }; null if neither parses."""
    bare = F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def summarize_messages(messages: Column, most: int = 6, chars: int = 4000) -> Column:
    """`role: content` lines of the last messages; messages is an array of (role, content), null content for other parts."""
    tail = F.slice(messages, F.greatest(F.size(messages) - (most - 1), F.lit(1)), most)
    return F.left(F.array_join(F.transform(tail, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), F.lit(chars))


def format_turns(turns: Column) -> Column:
    """Transcript of an array of (user, assistant)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("用户: "), t["user"], F.lit("\n客服: "), t["assistant"])), "\n")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def embed_text(instruction: str, query: Column) -> Column:
    return F.concat_ws("\n", F.lit(instruction), query)


def embedding_payload(text: Column, images: Column) -> Column:
    return F.struct(text.alias("text"), F.try_element_at(images, F.lit(1)).alias("image"))


# Markers for pictures in answers, and the placeholder.
PIC = "<PIC>"
MARKER = r"[\[(（【<]?\s*(?:图片|图示|图|PIC|pic)\s*[：:]\s*([A-Za-z0-9][A-Za-z0-9_-]*(?:\.[A-Za-z0-9]+)?)\s*[\])）】>]?"


def repair_image_markers(c: Column, allowed: Column) -> Column:
    """Markers of allowed images become placeholders, all others go; blanks, and those before signs, are tidied."""
    named = F.transform(allowed, path_stem)
    found = F.regexp_extract_all(c, F.lit(f"({MARKER})"), F.lit(1))
    marked = F.aggregate(
        found, c,
        lambda out, m: F.replace(out, m, F.when(F.array_contains(named, path_stem(F.regexp_extract(m, MARKER, 1))), F.lit(PIC)).otherwise(F.lit(""))),
    )
    return strip(F.regexp_replace(F.regexp_replace(marked, r"[ \t]{2,}", " "), r"\s+([，。；、,.!?！？])", "$1"))


def align_pics(c: Column, images: Column) -> Column:
    """(text, images): each placeholder has the image of its place. It stays if the image is unseen, there is text before
    or after it, and there is text before it or the placeholder before it went. Unequal numbers change nothing."""
    has_text = lambda x: x.rlike(r"(?U)\w")

    def aligned(given: Column) -> Column:
        parts, images = given["parts"], given["images"]
        start = F.struct(F.element_at(parts, 1).alias("text"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("last"))

        def step(acc: Column, i: Column) -> Column:
            image, after = F.element_at(images, i), F.element_at(parts, i + 1)
            before = has_text(F.element_at(parts, i))
            keep = ~F.array_contains(acc["kept"], image) & (before | has_text(after)) & (before | ~acc["last"])
            return F.struct(
                F.concat(acc["text"], F.when(keep, F.lit(PIC)).otherwise(F.lit("")), after).alias("text"),
                F.when(keep, F.concat(acc["kept"], F.array(image))).otherwise(acc["kept"]).alias("kept"),
                keep.alias("last"),
            )

        fits = (F.size(parts) - 1 == F.size(images)) & (F.size(images) > 0)
        folded = F.when(fits, F.aggregate(F.sequence(F.lit(1), F.size(images)), start, step))
        return F.struct(strip(F.coalesce(folded["text"], given["whole"])).alias("text"), F.coalesce(folded["kept"], images).alias("images"))

    return let(F.struct(F.split(c, PIC, -1).alias("parts"), images.alias("images"), c.alias("whole")), aligned)


def image_url_ok(c: Column, max_bytes: int = 5 * 1024 * 1024) -> Column:
    """Whether a data URL holds a png, jpeg or webp image of bounded size."""
    body = F.regexp_extract(c, r"^data:image/(?:png|jpe?g|webp);base64,([A-Za-z0-9+/=]+)$", 1)
    return (body != "") & (F.octet_length(F.try_to_binary(body, F.lit("base64"))) <= max_bytes)


def render_answer(c: Column, images: Column) -> Column:
    """Answer text with each placeholder replaced by its image's id, or a note that it is missing."""
    parts = F.split(c, PIC, -1)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("["), F.coalesce(F.try_element_at(images, i), F.lit("missing image")), F.lit("]"), p))), ""
    )
