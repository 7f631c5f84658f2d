"""The pipeline's stages on the small tables, each against what it should keep."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from brinewave.llm import queries


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, ids = docs.columns, [r["doc_id"] for r in docs.select("doc_id").collect()]
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == schema
        docs = queries_table(spark, docs)
        frames.append({r["doc_id"]: r for r in docs.collect()})
    toxic = {r["doc_id"] for r in queries.op3_multiple_instance_toxicity(spark, folder).where("predicted = 1").collect()}
    assert set(frames[0]) == set(ids) - toxic
    near = {r["doc_id"] for r in queries.op6_hyperminhash(spark, folder).where("not kept").collect()}
    assert set(frames[1]) <= set(frames[0]) and set(frames[0]) - near <= set(frames[1])
    hit = {r["doc_id"] for r in queries.op5_winnowing(spark, folder).where("contaminated").collect()}
    assert set(frames[2]) == set(frames[1]) - hit
    assert set(frames[3]) == set(frames[2])
    private = {r["doc_id"] for r in queries.op2_bilstm_crf_pii(spark, folder).where("spans <> ''").collect()}
    for d, row in frames[3].items():
        assert row["n_chars"] == len(row["text"])
        assert (row["text"] != frames[2][d]["text"]) == (d in private)
    last = corpus_pipeline.mixing(spark, docs, folder).collect()
    assert {r["doc_id"] for r in last} == set(frames[3]) and all(r["taken"] <= 3 * r["size"] for r in last)


def queries_table(spark, df):
    from brinewave.llm.common import stored

    return stored(df, "stage-test")


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (3, None)],
        "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == [(False, 1), (False, 3), (True, None)]


def kept_by_hand(docs, words=5, percent=80):
    """Ids that stay when texts are compared pair by pair on sets of five words."""
    sets = {}
    for d, text in docs:
        w = text.lower().split()
        sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d for d in sets if root(d) == d}


def test_near_copies_on_five_words(spark):
    r = random.Random(31)
    names = [f"w{i}" for i in range(500)]
    docs = []
    for n in (1, 2, 3, 4, 5, 6, 9, 30, 80, 200, 400, 1200):
        base = r.choices(names, k=n)
        for step in (0, 0, 20, 60, 200, 400):
            w = [f"new{i}" if step and i % step == step // 2 else x for i, x in enumerate(base)]
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, " ".join(r.choices("abc", k=k))) for i, k in enumerate((3, 4, 5, 300, 300, 500))]
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "").collect()}
    want = kept_by_hand(docs)
    assert got == want
    assert len(want - kept_by_hand(docs, words=2)) > 3  # no copies, though close on pairs of words


def test_rows_of_one_id_with_different_texts(spark):
    r = random.Random(5)
    one, two, three = (" ".join(f"w{r.randrange(900)}" for _ in range(120)) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, two + " end"), (2, three), (3, three), (4, one + " end"), (5, ""), (5, None), (None, one)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == sorted(
        [(1, one), (1, two), (2, three), (5, ""), (5, ""), (0, one)])


def test_stages_with_columns_named_like_those_of_the_operators(spark, folder):
    """Every stage keeps the same rows, and foreign columns as they are, whatever these are called."""
    from pyspark.sql import functions as F

    names = ["score", "offending", "n_hit", "items", "spans", "n_words", "_text", "_masked", "_node", "kept", "base", "key", "component_id", "size", "taken"]
    docs = queries_table(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(60))
    extra = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        plain = {r["doc_id"]: r for r in stage(spark, docs, folder).collect()}
        got = {r["doc_id"]: r for r in stage(spark, extra, folder).collect()}
        assert got.keys() == plain.keys(), name
        if name != "mixing":
            assert all(r[n] == f"{n}{d}" for d, r in got.items() for n in names), name
            assert all(r["text"] == plain[d]["text"] for d, r in got.items()), name
        else:
            assert all(r["taken"] == plain[d]["taken"] for d, r in got.items())
