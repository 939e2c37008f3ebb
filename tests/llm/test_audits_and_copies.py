"""Spelling variants, filter interactions and exact copies against plain versions, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from docloom.llm import audit, dedup, spelling
from docloom.llm.common import table

UPPER = bytes(range(65, 91)).decode()
LOWERED = str.maketrans(UPPER, UPPER.lower())
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Word and another " * 20_000), (5, "the same"), (5, "the same"), (6, "THE same"), (None, "no id here at all"), (None, "no id here at all"), (7, "été à la plage 日本語 \U0001f44d"), (8, "É is not é")]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, body string, word string, part string, mask string, sender string, id string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None, *"abcdefg") for k, (i, t) in enumerate(rows)], ODD_SCHEMA)


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    out = {}
    for w, n in words.items():
        near = sorted((-m, x) for x, m in words.items() if distance_one(w, x))
        form = near[0] if near and -near[0][0] >= 2 * n else None
        out[w] = [form and form[1], None, n, len(near), form and -form[0]]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in out.items()}


def as_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_like_a_plain_search_of_all_pairs(spark):
    """Short alphabets make crowded bigrams, repeated ones and long chains of forms."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaabaaa", "ababab", "Àààààà", "zzzzzzzzzz" * 30]
    texts = []
    for i in range(400):
        picked = [base[min(int(rng.expovariate(0.08)), len(base) - 1)] for _ in range(30)]
        edited = [w if rng.random() < 0.7 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "b", "ab"]) + w[k + 1 :] for w in picked]
        texts.append((i, rng.choice([" ", ", ", "-"]).join(w.upper() if rng.random() < 0.1 else w for w in edited)))
    want = plain_variants(texts)
    assert len(want) > 150 and sum(r[0] is not None for r in want.values()) > 50 and any(r[0] != r[1] for w, r in want.items() if r[0])
    assert as_variants(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"))) == want


def test_crowded_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPLIT", 3)
    rng = random.Random(6)
    texts = [(i, " ".join("".join(rng.choice("ab") for _ in range(7)) for _ in range(60))) for i in range(40)]
    want = plain_variants(texts)
    assert len(want) > 100
    assert as_variants(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"))) == want


def test_variants_of_the_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = as_variants(spelling.variants(docs))
    assert got == want and any(r[0] for r in want.values())


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(7)
    for _ in range(300):
        grams = [(rng.randrange(9), p, rng.randrange(1, 50)) for p in rng.sample(range(8), 3)]
        pairs = [(a[2] + b[2], sorted((a[1], b[1]))) for a in grams for b in grams if b[1] - a[1] >= 2]
        got = spelling.pivots_of(grams)
        assert sum(f for _, p, f in grams if p in got) == min(pairs)[0] and got[1] - got[0] >= 2


def test_variants_of_odd_texts(spark):
    assert as_variants(spelling.variants(odd(spark))) == plain_variants(ODD)
    assert as_variants(spelling.variants(odd(spark, []))) == {}


def plain_audit(rows, labels):
    """rows (id, text, lang); every order is applied one filter after the other."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[lang or ""].append((fails, labels.get(i, (0, 0))))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = list(docs)
            for k, f in enumerate(order, 1):
                gone = [d for d in alive if d[0][f]]
                alive = [d for d in alive if not d[0][f]]
                shapley[f] += len(gone)
                failing = [d for d in docs if d[0][f]]
                out[part, order, k] = [len(alive), len(gone), len(failing) - len(gone), sum(sum(d[0].values()) == 1 for d in failing), sum(d[1][0] == 1 for d in gone), sum(d[1][1] == 1 for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_audit_like_filters_applied_one_by_one(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    assert as_audit(audit.interactions(docs, labels)) == plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], marks)


def test_audit_of_odd_texts(spark):
    rows = [(i, t, None if k % 3 == 0 else "en") for k, (i, t) in enumerate(ODD)] + [(i, "A lot of CAPITALS & signs " * 50, "fr") for i in range(20, 60)]
    docs = spark.createDataFrame([(i, t, lang, "x", "y", True, False, "z") for i, t, lang in rows], "doc_id long, text string, lang string, part string, mask string, good boolean, toxic boolean, first string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (20, 1, 1), (21, 0, 1)], "doc_id long, quality int, toxic int")
    want = plain_audit(rows, {4: (1, 0), 5: (1, 0), 7: (0, 1), 20: (1, 1), 21: (0, 1)})
    got = as_audit(audit.interactions(docs, labels))
    assert got == want and {k[0] for k in got} == {"", "en", "fr"}
    assert audit.interactions(docs.limit(0), labels).count() == 0
    assert all(v[4:6] == (0, 0) for v in as_audit(audit.interactions(docs, labels.limit(0))).values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 4099])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert audit.positional_counts(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2), (1, 1 << 40), (50, 60), (5000, 1 << 24), (3, 1 << 61), (200, 200)):
        for base in (0, 1 << 20):
            values = np.unique(rng.integers(0, top, n)) + base
            power, coded = dedup.golomb(values, base)
            assert dedup.from_golomb(coded, len(values), power, base).tolist() == values.tolist()
    dense = np.unique(rng.integers(0, 1 << 34, 1 << 20))
    assert len(dedup.golomb(dense, 0)[1]) < 2.1 * len(dense)  # 14 bits of gap


def plain_copies(rows):
    """rows (id, text), ids of a group differing: {id: (keep_id, size, kept, sha)}."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWERED)].append(i)
    return {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def as_copies(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("spare", [10, -4])  # few bits make every row a suspect, and bytes decide
def test_copies_like_a_plain_grouping(spark, sf, monkeypatch, spare):
    monkeypatch.setattr(dedup, "SPARE", spare)
    docs = table(spark, sf, "documents").repartition(7)
    assert as_copies(dedup.exact_duplicates(docs)) == plain_copies([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("sent", "cut"), [(50, 1 << 28), (50, 200), (1 << 20, 200)])
def test_many_senders_and_slices(spark, monkeypatch, sent, cut):
    """Hot copies over many senders; a slice too large for a broadcast."""
    monkeypatch.setattr(dedup, "SENT", sent)
    monkeypatch.setattr(dedup, "SLICE", cut)
    rows = [(i, "Hot text" if i % 3 == 0 else "hot TEXT" if i % 3 == 1 and i % 2 else f"text {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_copies(dedup.exact_duplicates(docs)) == plain_copies(rows)


def test_copies_of_odd_texts(spark):
    got = dedup.exact_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)]
    assert by[6] == [(6, 3, True)] and by[5] == [(6, 3, False)] * 2
    assert sorted(by[None]) == [(None, 2, False), (None, 2, True)]
    assert by[7] == [(7, 1, True)] and by[8] == [(8, 1, True)] and by[4] == [(4, 1, True)]
    once = dedup.exact_duplicates(odd(spark, [(5, "twice"), (5, "twice")])).collect()
    assert sorted(r["kept"] for r in once) == [False, True] and {r["keep_id"] for r in once} == {5}
    assert dedup.exact_duplicates(odd(spark, [])).count() == 0
