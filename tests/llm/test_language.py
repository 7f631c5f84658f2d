"""Language by compression: training does not lean on ids, and verdicts equal a plain loop."""

from __future__ import annotations

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from brinewave.llm import language_zstd as L

WORDS = {"aa": ["salt", "tide", "buoy", "drift", "harbour", "current"], "bb": ["zout", "getij", "boei", "haven", "stroming", "water"]}


def sentence(r, lang):
    return " ".join(r.choice(WORDS[lang]) for _ in range(12))


def test_training_with_null_one_and_repeated_ids(spark):
    r = random.Random(1)
    rows = [(None, sentence(r, "aa"), "aa") for _ in range(2_000)] + [(7, sentence(r, "bb"), "bb") for _ in range(2_000)]
    rows += [(k, "the very same text", "cc") for k in range(500)] + [(9, "one row many times", "dd")] * 3_000
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(8)
    for n in (5, 300):
        found = L.train_dictionaries(docs, F.lit(True), docs_per_language=n, dictionary_bytes=4_096)
        assert sorted(found) == ["aa", "bb", "cc", "dd"] and all(0 < len(d) <= 4_096 for d in found.values())
        assert found == L.train_dictionaries(docs.repartition(3), F.lit(True), docs_per_language=n, dictionary_bytes=4_096)
    asked = spark.createDataFrame([(1, sentence(r, "aa")), (2, sentence(r, "bb"))], "doc_id int, text string")
    assert {x["doc_id"]: x["best"] for x in L.identify(asked, found).collect()} == {1: "aa", 2: "bb"}


def test_rows_that_reach_the_driver_are_bounded(spark):
    """Of a language with one id for all rows, no more than twice the documents asked for are fetched."""
    r = random.Random(2)
    docs = spark.createDataFrame([(None, sentence(r, "aa") + f" {k}", "aa") for k in range(3_000)], "doc_id int, text string, lang string")
    seen = []
    plain = L.cut_dictionary
    L.cut_dictionary = lambda texts, size: seen.append(len(texts)) or plain(texts, size)
    try:
        L.train_dictionaries(docs, F.lit(True), docs_per_language=40)
    finally:
        L.cut_dictionary = plain
    assert seen == [40]


def test_verdicts_equal_a_plain_loop(spark):
    r = random.Random(3)
    dictionaries = {lang: L.cut_dictionary([sentence(r, lang) for _ in range(50)], 2_048) for lang in WORDS}
    texts = [sentence(r, r.choice(["aa", "bb"])) for _ in range(60)] + ["salt zout", "x", "ÆØ tide", "tide " * 9_000, "12 34", "", None]
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), dictionaries, margin=0.02, steepness=30.0).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert (row["language"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        raw, sizes = L.plain(text), {}
        for lang, content in dictionaries.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            make = zstandard.ZstdCompressor(dict_data=known, level=5, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(make.compress(raw[a:a + L.PIECE])) for a in range(0, len(raw), L.PIECE))
        order = sorted(sizes, key=lambda lang: (sizes[lang], lang))
        low = sizes[order[0]]
        narrow = (sizes[order[1]] - low) / low < 0.02
        assert (row["best"], row["rejected"], row["language"]) == (order[0], narrow, "und" if narrow else order[0])
        assert np.isclose(row["score"], 1 / sum(np.exp(-30.0 * (s - low) / low) for s in sizes.values()))
