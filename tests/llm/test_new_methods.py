"""Collocations, shared search and positive-unlabelled quality: brute force, edges, held-out rates."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.llm import collocations, quality_pu, queries, shared_search
from brinewave.llm.common import crc_mod, table


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def random_docs(n, seed, longest=80):
    r = random.Random(seed)
    names = ["a", "Bb", "çé", "d(d", "e", "#f", "g|", "H-1", "\U0001F600", "k9", "x" * 70, "la"]
    weights = [30, 20, 10, 8, 6, 5, 4, 3, 2, 2, 3, 1]
    ends = (" ", " ", " ", " ", "\t", "  ", ", ", ".\n", "\r")
    texts = ["".join(w + r.choice(ends) for w in r.choices(names, weights, k=r.randint(0, longest))) for _ in range(n)]
    return [(i, t, r.choice(("en", "en", "en", "fr", None))) for i, t in enumerate(texts)] + [(n, None, "en"), (n + 1, "", None), (None, "a bb a bb", "fr"), (None, "a bb a bb", "fr")]


# -- collocations ------------------------------------------------------------------------


def by_hand(rows, longest=3, least=10, inside=50, top=2000):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        n = sum(a for w, a in counts.items() if len(w) == 1)
        held = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        found = []
        for w, a in held.items():
            if any(len(v) > len(w) and 100 * b >= inside * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in held.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), l, r))
        out |= {(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("longest,heads,top", [(3, (1 << 18, 1 << 19), 2000), (3, (4, 5), 7), (3, (0, 0), 2000), (4, (6, 3), 2000), (2, (5, 5), 2000)])
def test_collocations_by_hand(spark, longest, heads, top):
    """With all, few and no phrases in the heads, so that dense tiles, runs and texts all count."""
    rows = random_docs(120, 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"phrase": F.lit(1), "a": F.lit("z"), "n": F.lit(2)}).repartition(3)
    got = collocations.collocations(docs, longest=longest, top=top, head_words=heads[0], head_phrases=heads[1]).collect()
    want = by_hand(rows, longest, top=top)
    assert len(got) == len(want) > 10 and {tuple(r) for r in got} == want


def test_tiles_dense_and_sparse():
    r = np.random.default_rng(3)
    tiles = collocations.Tiles(buffer=5_000, dense_at=500)
    want, got = collections.Counter(), collections.Counter()
    for _ in range(12):
        left, right = (np.minimum(r.zipf(1.3, 3_000) - 1, 100_000) for _ in range(2))
        want.update(zip(left.tolist(), right.tolist()))
        for a, b, n in tiles.add(left, right):
            for key in zip(a.tolist(), b.tolist(), n.tolist()):
                got[key[:2]] += key[2]
    assert 0 < len(tiles.dense) <= collocations.MOST_TILES
    for a, b, n in tiles.finish():
        for key in zip(a.tolist(), b.tolist(), n.tolist()):
            got[key[:2]] += key[2]
    assert got == want


def test_collocations_edges(spark, odd_documents):
    assert collocations.collocations(odd_documents.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_documents.collect()]
    got = collocations.collocations(odd_documents).collect()
    assert {tuple(r) for r in got} == by_hand(rows) and {r["lang"] for r in got} == {"fr"}
    # products beyond 64 bits
    big = 4_000_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big)], "lang string, phrase string, a bigint")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, a bigint")
    assert collocations.scored([one, two]).first()["score"] == 1_000_000 * (big - 1) ** 2 // big ** 2


# -- shared search -----------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def search_by_hand(docs, items, top):
    held = [(k, collections.Counter(terms_of(t))) for k, t in docs]
    held = [(k, c) for k, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(terms_of(t))
    out = []
    for i, own in terms.items():
        found = []
        for k, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, k is None, k or 0, k))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [7, 100_000])
def test_search_by_hand(spark, block_terms):
    rows = [(k, t) for k, t, _ in random_docs(150, 9)]
    items = [(1, "a Bb çé"), (2, "a bb zz"), (2, "k9 la"), (3, None), (4, "..."), (None, "e e f a"), (None, "e e f a"), (5, "a bb e g h 1 k9"), (6, "nowhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit(1), "rank": F.lit(2), "key": F.lit("x"), "n": F.lit(3)}).repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit(1))
    got = [tuple(r) for r in shared_search.search(docs, bench, top=6, block_terms=block_terms).collect()]
    assert sorted(got, key=repr) == search_by_hand(rows, items, 6)
    assert shared_search.search(docs.limit(0), bench).count() == 0 == shared_search.search(docs, bench.limit(0)).count()


def test_search_odd_documents(spark, odd_documents):
    items = [(1, "the quick fox"), (2, "chat table émile \U0001F600"), (3, "word")]
    got = [tuple(r) for r in shared_search.search(odd_documents, spark.createDataFrame(items, "item_id int, text string")).collect()]
    assert sorted(got, key=repr) == search_by_hand([(r["doc_id"], r["text"]) for r in odd_documents.collect()], items, 50)


@pytest.mark.parametrize("seed", range(6))
def test_shared_sums(seed):
    """Every item's row is the sum of its terms' rows, whatever was shared, with fewer additions than term by term."""
    r = random.Random(seed)
    common = [r.sample(range(60), 8) for _ in range(4)]
    sets = [sorted({*(t for c in r.sample(common, r.randint(0, 3)) for t in c), *r.sample(range(60, 90), r.randint(1, 5))}) for _ in range(40)]
    names = sorted({t for own in sets for t in own})
    items = [[names.index(t) for t in own] for own in sets]
    sums = shared_search.share_sums(items, len(names))
    terms = np.random.default_rng(seed).integers(0, 1 << 40, (len(names), 5))
    assert (sums.scores(terms) == np.stack([terms[own].sum(axis=0) for own in items])).all()
    assert sums.additions < 0.8 * sum(len(own) - 1 for own in items) and sums.levels


def test_lengths_beyond_64_bits():
    n = np.array([3, 2_000_000_000], np.int64)
    assert shared_search.lengths_scaled(n, 4_000_000_000, 9_000_000_000_000).tolist() == [50 + 50 * int(x) * 4_000_000_000 // 9_000_000_000_000 for x in n]


# -- quality by positive-unlabelled learning -------------------------------------------------


def test_risk_slopes_are_derivatives():
    r = np.random.default_rng(1)
    for shift in (-2.0, 2.0):  # with the estimate on negatives below and above zero
        g_p, g_u = r.normal(1, 1, 7) - shift, r.normal(-1, 1, 11) + (0 if shift > 0 else -3)
        whole = quality_pu.nn_risk(g_p, g_u, 0.6)

        def risk(p, u):
            a, b = quality_pu.nn_risk(p, u, 0.6)
            return a + b if whole[1] >= 0 else -b

        s_p, s_u = quality_pu.risk_slopes(g_p, g_u, 0.6)
        for slopes, at in ((s_p, 0), (s_u, 1)):
            for i in range(len(slopes)):
                moved = [g_p.copy(), g_u.copy()]
                moved[at][i] += 1e-6
                up = risk(*moved)
                moved[at][i] -= 2e-6
                assert abs((up - risk(*moved)) / 2e-6 - slopes[i]) < 1e-5


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_and_scores_without_negative_labels(share):
    r = np.random.default_rng(4)
    good, bad = r.normal(1.3, 1, (8000, 6)), r.normal(-1.3, 1, (6000, 6))
    n = int(5000 * share)
    model = quality_pu.learn(good[:2000], np.concatenate([good[2000:2000 + n], bad[:5000 - n]]))
    assert abs(model.prior - share) < 0.07
    assert (model.network.score(good[7000:]) > 0.5).mean() > 0.97 and (model.network.score(bad[5000:]) < 0.5).mean() > 0.95


def test_quality_features_by_hand():
    text = "Ab 1.\nçx # #"
    row = quality_pu.features([text, "", "a"])
    kinds = [int(quality_pu.KIND[b]) for b in text.encode()]
    pairs = collections.Counter(zip(kinds, kinds[1:]))
    want = np.zeros(quality_pu.KINDS ** 2)
    for (a, b), n in pairs.items():
        want[a * quality_pu.KINDS + b] = math.sqrt(n / (len(kinds) - 1))
    assert np.allclose(row[0, :quality_pu.KINDS ** 2], want, atol=1e-6)
    assert not row[1, :-8].any() and not row[2, :-8].any() and not row[1, -8:].any()
    assert [quality_pu.KIND[ord(c)] for c in "aBAb5 \n"] == [1, 4, 3, 2, 5, 6, 7] and quality_pu.KIND[200] == 8


def test_quality_edges(spark, odd_documents, odd_labels):
    train = F.lit(True)
    model = quality_pu.train_quality(odd_documents, odd_labels, train, epochs=2)
    got = quality_pu.score_quality(odd_documents, model).collect()
    assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    none = quality_pu.train_quality(odd_documents, odd_labels.limit(0), train)
    assert {r["score"] for r in quality_pu.score_quality(odd_documents, none).collect()} == {0.5}
    empty = quality_pu.train_quality(odd_documents.limit(0), odd_labels, train)
    assert quality_pu.score_quality(odd_documents.limit(0), empty).count() == 0


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op13_positive_unlabelled(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 30 and good.predicted.mean() > 0.95 and (bad.predicted == 0).mean() > 0.5 and good.score.mean() > bad.score.mean() + 0.4


def test_labels_of_held_out_rows_are_not_learned(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    train = crc_mod(F.col("doc_id"), 5) != 0
    turned = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality_pu.train_quality(docs, x, train, epochs=2) for x in (labels, turned))
    assert (a.network.w == b.network.w).all() and a.prior == b.prior
