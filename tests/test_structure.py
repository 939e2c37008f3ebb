import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import structure as S

MANUAL = """intro line

# Top
text one
## Sub A
- item 1
  - nested
lazy line
- item 2

| a | b |
|---|---|
| 1 | 2 |
```py
# not a heading
x = 1
```
![fig](img/p1.png)
### Deep
> quote
## Sub B
end ##
# Next ##
last"""


@pytest.fixture(scope="module")
def lines(spark):
    return S.line_table(spark.createDataFrame([("m", MANUAL)], "doc_id string, md string"))


def test_sections(lines):
    got = [(r["section_no"], r["level"], r["heading"], r["header_path"], r["line_start"], r["line_end"]) for r in S.section_table(lines).orderBy("section_no").collect()]
    assert [(g[0], g[2], g[3]) for g in got] == [(0, None, []), (1, "Top", ["Top"]), (2, "Sub A", ["Top", "Sub A"]), (3, "Deep", ["Top", "Sub A", "Deep"]), (4, "Sub B", ["Top", "Sub B"]), (5, "Next", ["Next"])]
    assert got[0][4:] == (0, 1)


def test_elements(lines):
    got = [(r["kind"], r["markdown"]) for r in S.element_table(lines).orderBy("element_no").collect()]
    kinds = [k for k, _ in got]
    assert kinds == ["paragraph", "heading", "paragraph", "heading", "list", "table", "code", "image", "heading", "block", "heading", "paragraph", "heading", "paragraph"]
    assert got[4][1] == "- item 1\n  - nested\nlazy line\n- item 2" and got[6][1].startswith("```py\n# not a heading")


def test_heading_paths_equal_a_stack(spark):
    import random

    rng = random.Random(1)
    docs, want = [], {}
    for d in range(30):
        stack, md = [], []
        for n in range(40):
            level = rng.randint(1, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, f"h{n}"))
            md.append("#" * level + f" h{n}")
            want[d, n] = [t for _, t in stack]
        docs.append((d, "\n".join(md)))
    got = S.structured_lines(S.line_table(spark.createDataFrame(docs, "doc_id int, md string"))).collect()
    assert {(r["doc_id"], r["line_no"]): r["header_path"] for r in got} == want


def run(spark, col):
    return spark.range(1).select(col.alias("c")).first()["c"]


def test_tables_and_lists(spark):
    assert run(spark, S.render_table(F.lit("|a|b|c|\n|--|--|--|\n| 1 | 2 |"))) == "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |"
    assert run(spark, S.render_list(F.lit("* a\n  more\n* b\n  1) x\n  1) y\n* c"))) == "- a\n  more\n- b\n  1. x\n  2. y\n- c"
    table = "| h |\n| --- |\n" + "\n".join(f"| row {i:04d} |" for i in range(12))
    parts = run(spark, S.split_table(F.lit(table), 20))
    assert all(p.startswith("| h |\n| --- |\n") for p in parts) and sum(p.count("row") for p in parts) == 12
    items = "\n".join(f"- item {i} text" for i in range(10))
    parts = run(spark, S.split_list(F.lit(items), 20))
    assert "\n".join(parts) == items and all(len(p) // 2 <= 20 for p in parts)
    code = "```py\n" + "x" * 100 + "\n```"
    parts = run(spark, S.split_code(F.lit(code), 20))
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in parts) and "".join(p[6:-4] for p in parts) == "x" * 100
    parts = run(spark, S.split_paragraph(F.lit("Aa bb. " * 20), 10))
    assert all(len(p) // 2 <= 10 for p in parts) and " ".join(parts) == ("Aa bb. " * 20).strip()


def test_chunks_nest_and_cover(spark):
    body = "\n".join(f"## S{i}\nSome words of section {i}, and more. " * 1 + "Sentence here. " * (5 + 90 * (i % 3)) + f"\n![f](img/{i}.png)\n\n- li {i}\n- lj {i}" for i in range(6))
    elements = S.element_table(S.line_table(spark.createDataFrame([("m", body)], "doc_id string, md string"))).cache()
    t = {k: v.collect() for k, v in S.chunk_tables(elements).items()}
    bigs, mids = {r["chunk_id"] for r in t["big"]}, {r["chunk_id"]: r["big_chunk_id"] for r in t["mid"]}
    assert bigs and set(mids.values()) == bigs
    for r in t["small"]:
        assert mids[r["mid_chunk_id"]] == r["big_chunk_id"] and r["chunk_id"].startswith("m_small_")
        assert len(r["images"]) <= S.SMALL_IMAGES
    for level, (_, most) in (("big", S.BIG), ("mid", S.MID), ("small", S.SMALL)):
        for r in t[level]:
            assert r["token_count"] <= most + 256 or len(r["element_kinds"]) == 1
            assert r["start_line"] <= r["end_line"]
    squeeze = lambda s: "".join(s.split())
    words = squeeze("".join(r["markdown"] for r in elements.orderBy("element_no").collect()))
    for level in t:
        assert squeeze("".join(r["markdown"] for r in sorted(t[level], key=lambda r: r["chunk_id"]))) == words


def packed(spark, rows, pack, *sizes):
    """Group numbers of rows (tokens, kind, pictures) of one key, in their order."""
    made = [(None, i, n, k, ["x"] * p) for i, (n, k, p) in enumerate(rows)]
    df = spark.createDataFrame(made, "doc_id string, at int, tokens long, kind string, images array<string>").repartition(3)
    return [r["group_no"] for r in sorted(pack(df, ["doc_id"], ["at"], *sizes).collect(), key=lambda r: r["at"])]


def walked(rows, rule):
    """rule: one of the three packings, said as a walk over the rows."""
    out, cur, pics, group, empty = [], 0, 0, 0, True
    for n, kind, p in rows:
        opens, n_cur, closes = rule(cur, pics, n, kind, p, empty)
        group += opens and not empty
        cur, pics = n_cur if not (opens or empty) else n, p if opens or empty else pics + p
        empty = False
        out.append(group)
        if closes and (n if cur == n else cur) >= closes:
            group, empty, cur, pics = group + 1, True, 0, 0
    return out


def test_pack_groups_rule(spark):
    assert packed(spark, [(5, "p", 0), (4, "p", 0), (3, "p", 0), (50, "image", 0), (1, "p", 0)], S.pack_groups, 8, 10) == [0, 0, 1, 1, 2]
    assert packed(spark, [(n, "p", 0) for n in (4, 4, 12, 3, 10)], S.split_oversized, 10) == [0, 0, 0, 1, 2]
    assert run(spark, X.breadcrumb(F.array(F.lit("a"), F.lit(" "), F.lit("b")))) == "a > b"


@pytest.mark.parametrize("n", [1, 2, 3, 33, 3000])
def test_jumps_equal_a_walk(spark, n):
    """Empty rows, rows above every limit, images at the ends; the key is null."""
    import random

    rng = random.Random(n)
    rows = [(rng.choice([0, 1, 3, 5, 9, 40]), rng.choice(["p", "p", "image"]), rng.randint(0, 2)) for _ in range(n)]
    groups = lambda cur, pics, t, k, p, empty: (k != "image" and (cur >= 12 or cur + 1 + t > 20), cur + t, None)
    entries = lambda cur, pics, t, k, p, empty: (cur >= 12 and k != "image" or cur + 1 + t > 20 or pics + p > 3, cur + 1 + t, None)
    pieces = lambda cur, pics, t, k, p, empty: (cur + 1 + t > 20 and t <= 20, cur + 1 + t, 20)
    assert packed(spark, rows, S.pack_groups, 12, 20) == walked(rows, groups)
    assert packed(spark, rows, S.pack_entries, 12, 20, 3) == walked(rows, entries)
    assert packed(spark, rows, S.split_oversized, 20) == walked(rows, pieces)
