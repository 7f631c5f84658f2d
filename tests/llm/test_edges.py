"""Odd rows, empty tables and clashing columns through every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brinewave.llm import (
    apportion,
    hyperminhash,
    language_zstd,
    pii_lstm,
    quality_gbt,
    token_counts,
    toxicity_mil,
    url_rules,
    warc_normalise,
    winnowing,
)

SMALL = {"rounds": 3}


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii_lstm.train([], rounds=3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, "Quick Brown fox, jumps"), (1, "Quick Brown fox, jumps"), (None, "chat est sur la table"), (2, None), (3, "..."), (4, ""),
         (5, "no such passage in any of these texts at all, not even once")], "item_id bigint, text string")


def test_quality(odd_documents, odd_labels):
    model = quality_gbt.train_quality(odd_documents, odd_labels, trees=3)
    got = by_id(quality_gbt.judge_quality(odd_documents, model))
    assert sum(map(len, got.values())) == 14 and len(got[2]) == 2
    for k in (3, 4, 5):
        assert [got[k][0][n] for n in quality_gbt.STATS] == [0] * len(quality_gbt.STATS)
    assert got[8][0]["word_chars"] == 200_000 and got[7][0]["n_repeat_words"] == 30_000
    assert got[9][0]["word_chars"] == 10 and got[12][0]["n_dup_lines"] == 1
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)


def test_quality_without_labels(odd_documents, odd_labels):
    model = quality_gbt.train_quality(odd_documents, odd_labels.limit(0))
    assert {r["score"] for r in quality_gbt.judge_quality(odd_documents, model).select("score").distinct().collect()} == {1 / (1 + 2.718281828459045 ** -13.815510557964274)}


def test_private_data(odd_documents, tagger):
    got = by_id(pii_lstm.find_spans(odd_documents, tagger))
    assert [(s["kind"], s["start"], s["end"]) for s in got[10][0]["base"]] == [("email", 0, 6), ("ip", 7, 14), ("phone", 15, 32)]
    assert all(not got[k][0]["base"] and not got[k][0]["added"] for k in (3, 4, 5, 8))
    masked = by_id(pii_lstm.redact(odd_documents, tagger))
    assert masked[10][0]["text"] == "<email> <ip> <phone>" and masked[3][0]["text"] is None and masked[4][0]["text"] == ""
    assert masked[10][0]["key"] == "k" and len(masked[2]) == 2


def test_toxicity(odd_documents, odd_labels):
    model = toxicity_mil.train_toxicity(odd_documents, odd_labels, F.lit(True), min_documents=1)
    got = by_id(toxicity_mil.score_toxicity(odd_documents, model))
    assert sum(map(len, got.values())) == 14 and all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)
    assert abs(got[3][0]["score"] - model.leak) < 1e-9 and got[4][0]["offending"] == []
    none = toxicity_mil.train_toxicity(odd_documents, odd_labels.limit(0), F.lit(True))
    assert max(r["score"] for r in toxicity_mil.score_toxicity(odd_documents, none).collect()) < 1e-9


def test_token_counts(odd_documents):
    got = by_id(token_counts.count_tokens(odd_documents, token_counts.load_vocabulary()))
    assert sum(map(len, got.values())) == 14 and got[3][0]["n_tokens"] == got[4][0]["n_tokens"] == 0
    assert got[2][0] == got[2][1] and got[8][0]["n_tokens"] > 1000


def test_winnowing(odd_documents, bench):
    got = by_id(winnowing.match_benchmark(odd_documents, bench))
    assert got[1][0]["n_hit"] == 4 and got[1][0]["items"] == ["1"] and [list(s) for s in got[1][0]["spans"]] == [[1, 5]]
    assert got[7][0]["n_hit"] == 15_000 and got[7][0]["items"] == []
    assert got[3][0]["n_words"] == got[4][0]["n_words"] == got[5][0]["n_words"] == 0 and len(got[2]) == 2 and got[None][0]["n_words"] == 5


def test_near_duplicates(odd_documents):
    got = by_id(hyperminhash.near_duplicates(odd_documents))
    assert [r["component_id"] for r in got[2]] == [1, 1] and got[1][0]["kept"] and not got[2][0]["kept"]
    assert got[None][0]["component_id"] is None
    for k in (3, 4, 5):
        assert (got[k][0]["n_shingles"], got[k][0]["component_id"], got[k][0]["kept"]) == (0, k, True)
    assert got[6][0]["n_shingles"] == 1 and sum(map(len, got.values())) == 14


def test_mixing(odd_documents):
    rows = apportion.mix_sources(odd_documents).collect()
    assert len(rows) == 14 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    assert all(r["size"] == 0 and r["target"] == 0 for r in rows if r["source"] == "b")


def test_language(odd_documents):
    found = language_zstd.train_dictionaries(odd_documents, F.lit(True))
    assert sorted(found) == ["en", "fr"]
    got = by_id(language_zstd.identify(odd_documents, found))
    assert got[7][0]["best"] == "fr" and got[1][0]["best"] == "en" and len(got[2]) == 2
    assert all(got[k][0]["best"] == "und" and got[k][0]["score"] == 0 for k in (3, 4, 5, 11))
    untrained = language_zstd.identify(odd_documents, language_zstd.train_dictionaries(odd_documents.limit(0), F.lit(True)))
    assert {r["language"] for r in untrained.collect()} == {"und"}


def test_warc(spark):
    long = "<p>" + "é" * 200_000 + "</p>"
    pages = spark.createDataFrame(
        [(1, "http://a\r\nX: y", "x" * 100, "k"), (2, None, "x" * 100, "k"), (3, "u", None, "k"), (4, "u", "", "k"), (None, "u", "x" * 100, "k"),
         (5, "u", "y" * 99, "k"), (6, "u", "y" * 99, "k"), (7, "u", long, "k"), (7, "u", long, "k"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 9, "k")],
        "page_id bigint, url string, html string, key string").repartition(3)
    got = warc_normalise.round_trip(pages).collect()
    assert len(got) == 10
    one = {r["page_id"]: r for r in got if r["page_id"] != 7}
    assert (one[1]["record_type"], one[2]["record_type"], one[2]["refers_to"], one[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert one[3]["payload_bytes"] == one[4]["payload_bytes"] == 0 and one[5]["record_type"] == one[6]["record_type"] == "response"
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 7) == [("response", None), ("revisit", 7)]
    assert one[2]["payload_bytes"] == 100 and one[8]["payload_bytes"] == len("\r\n\r\nWARC/1.1\r\n" * 9)


def test_url_rules(spark):
    pages = spark.createDataFrame(
        [(1, "http://WWW.Example.org/en/1?x", "r"), (1, "http://WWW.Example.org/en/1?x", "r"), (2, None, "r"), (3, "no scheme/at all", "r"), (4, "", "r"),
         (5, "x://example.org", "r"), (6, "x://" + "a." * 5000 + "org/" + "p" * 20000, "r"), (None, "http://e.com/de/1", "r"), (7, "a://b://org/", "r")],
        "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("net", None, "block")],
        "host string, path string, verdict string")
    for limit in (url_rules.RULE_BYTES, 0):
        got = url_rules.judge_urls(pages, rules, rule_bytes=limit).collect()
        assert len(got) == 9
        one = {r["page_id"]: tuple(r)[1:] for r in got}
        assert one[1] == ("www.example.org", "/en/1", "example.org/en/1", "block") and one[2] == ("", "", None, "allow") == one[3] == one[4]
        assert one[5] == ("example.org", "", None, "allow") and one[6][2] == "org/" and one[None][2:] == ("com/de/", "block") and one[7][0] == "b:"
    assert url_rules.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_empty_tables(spark, odd_documents, odd_labels, tagger, bench):
    none = odd_documents.limit(0)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert quality_gbt.judge_quality(none, quality_gbt.train_quality(none, odd_labels)).count() == 0
    assert pii_lstm.find_spans(none, pii_lstm.train_tagger(none, **SMALL)).count() == 0
    assert toxicity_mil.score_toxicity(none, toxicity_mil.train_toxicity(none, odd_labels, F.lit(True))).count() == 0
    assert token_counts.count_tokens(none, token_counts.load_vocabulary()).count() == 0
    assert winnowing.match_benchmark(none, bench).count() == 0
    assert winnowing.match_benchmark(odd_documents, bench.limit(0)).where("n_hit > 0").count() == 0
    assert hyperminhash.near_duplicates(none).count() == 0
    assert apportion.mix_sources(none).count() == 0
    assert language_zstd.identify(none, {}).count() == 0
    assert warc_normalise.round_trip(pages).count() == 0
    assert url_rules.judge_urls(pages, spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")).count() == 0


def test_near_duplicates_with_one_key_on_several_texts(spark):
    """Each text under a repeated key is linked by its own set, whichever row comes first."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(20):
        own = [f"g{g}{w}" for w in words]
        rows += [(g, " ".join(own)), (g, f"other text {g} " + " ".join(f"z{g}{w}" for w in words)), (100 + g, " ".join(own[:-1] + ["end"]))]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(got) == 60
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {
        *[(g, g, True) for g in range(20)], *[(100 + g, g, False) for g in range(20)]}
