"""Every operator on nulls, empty and very long texts, repeated rows, an empty table, and extra columns with clashing names."""

import zlib

import pytest

from docloom.llm import digest, html, langid, media, mixing, packing, quality, secrets, simhash, suffix_lm

LONG = "word and another " * 20_000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same"), (5, "the same"), (6, "the same"), (None, "no id here at all"), (None, None), (7, "été à la plage 日本語 \U0001f44d"), (8, "12 34 !!")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, `row` string, size string, spans string, score string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 9, "x", "y", "z", None, "q") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, docs):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, None), (7, 1, 0), (8, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "digest": lambda s, d: digest.digest_rows(d),
    "mixing": lambda s, d: mixing.mix_report(d),
    "suffix_lm": lambda s, d: suffix_lm.score_rows(d),
    "media": lambda s, d: media.media_rows(d),
    "langid": lambda s, d: langid.identify(d),
    "quality": lambda s, d: quality.classify(d, labels(s, d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_result(spark, none, name):
    assert OPERATORS[name](spark, none).count() == 0


def test_packing(spark, docs, none):
    got = packing.packed_sequences(docs).collect()
    assert sum(r["piece"] == 0 for r in got) == len(TEXTS)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert all(r["length"] == 1 and r["ids_crc32"] == zlib.crc32(bytes(4)) for r in empty)
    assert sum(r["length"] == 2048 for r in got if r["doc_id"] == 4) >= 10
    assert packing.packed_sequences(none).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>text", "x"), (2, None, "", "x"), (3, "u", "<html><body><nav>menu</nav></body>", "x"), (4, "u", "<p>" + "long text, " * 50_000, "x")]
    got = html.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == "" and by_id[2]["text"] == "" and by_id[3]["text"] == "" and by_id[None]["text"] == "text"
    assert by_id[4]["n_chars"] == len(("long text, " * 50_000).strip())
    assert html.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_filters_keep_all_columns(spark, docs, none):
    for keep in (langid.recognised, simhash.keep_one, secrets.redacted):
        got = keep(docs)
        assert got.columns == docs.columns
        assert keep(none).count() == 0
    kept = langid.recognised(docs)
    assert kept.where("text is null or text = ''").count() == 0
    once = simhash.keep_one(docs)
    assert once.where("text = 'the same'").count() == 1 and once.where("doc_id = 5").count() == 1
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_shard", "mix_round"]


def test_defined_values(spark, docs):
    lm = {(r["doc_id"], r["n_tokens"]) for r in suffix_lm.score_rows(docs).collect()}
    assert (1, 1) in lm and (2, 1) in lm and (5, 3) in lm
    lang = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert lang[1]["lang_pred"] == lang[8]["lang_pred"] == "und" and lang[7]["lang_pred"] == "en"
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] == "0" * 16 and prints[3]["component_id"] == 1
