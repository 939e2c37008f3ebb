"""Every occurrence of passages in texts, against a plain search."""

import random

from docloom.operators import lookup as L


def plain(texts, passages):
    return sorted((i, r, k + 1, k + len(p)) for i, t in texts for r, p in passages if t and p for k in range(len(t)) if t.startswith(p, k))


def found(spark, texts, passages):
    t = spark.createDataFrame(texts, "doc_id long, text string")
    p = spark.createDataFrame(passages, "ref_id long, passage string")
    return sorted((r["doc_id"], r["ref_id"], r["start"], r["end"]) for r in L.passages_in(t, p).collect())


def test_all_occurrences(spark):
    """Overlaps, passages that begin or end within words, signs of regular expressions, short ones, line breaks, and one that is everywhere."""
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "ab", "aba", "b.c", "(x)", "é", "w\\d", "$1"])
    texts = [(i, "".join(word() + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 200)))) for i in range(60)] + [(100, None), (101, ""), (102, "ab ab ab ab ab ab ab ab")]
    cut = lambda t, n: (lambda k: t[k : k + n])(rng.randrange(max(1, len(t) - n)))
    passages = [(i, cut(texts[i % 60][1] or "xy", rng.choice([1, 3, 8, 15, 40, 90]))) for i in range(80)] + [(900, "ab ab ab ab ab"), (901, ""), (902, None), (903, "not in here at all, never"), (904, "ab")]
    want = plain(texts, passages)
    assert len(want) > 500 and (102, 900, 4, 17) in want
    assert found(spark, texts, passages) == want


def test_no_passages_no_texts_and_long_ones(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    assert found(spark, [(1, "x")], []) == [] and found(spark, [], [(1, "a b c d e")]) == []
    passages = [(1, long[60_000:61_000]), (2, "w976 w0 w1 w2 w3"), (3, "w5 w4 w3 w2 w1")]
    assert found(spark, [(1, long)], passages) == plain([(1, long)], passages)


def test_candidates_over_bins_equal_a_plain_search(spark):
    """Entries and requests at equal times, bins without entries, models without any, a hot model; and the plan of the newest entries."""
    import datetime

    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    at = lambda: start + datetime.timedelta(minutes=rng.choice([rng.randrange(600), rng.randrange(100) * 60, rng.randrange(3000)]))
    entries = [(i, rng.choice("aaaab"), at()) for i in range(150)]
    requests = [(i, rng.choice("aaaabc"), at()) for i in range(400)]
    e = spark.createDataFrame(entries, "entry_id long, model string, ts timestamp")
    r = spark.createDataFrame(requests, "request_id long, model string, ts timestamp")
    want = {(q, x, k + 1) for q, m, t in requests for k, (_, x) in enumerate(sorted(((s, i) for i, n, s in entries if n == m and s < t), reverse=True)[:5])}
    for size in ("hour", "day"):
        assert {tuple(x) for x in L.cache_candidates(r, e, bin=size).collect()} == want
    assert L.cache_candidates(r.limit(0), e).count() == 0 and L.cache_candidates(r, e.limit(0)).count() == 0
    assert "WindowGroupLimit" in L.bounded_recent(e)._jdf.queryExecution().executedPlan().toString()
