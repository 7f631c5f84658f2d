"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import copy
import gzip
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.llm import apportion, hyperminhash, language_zstd, pii_lstm, quality_gbt, queries, token_counts, toxicity_mil, url_rules, warc_normalise, winnowing
from brinewave.llm.words import LETTERS, NOT_BLANK, cut, grams


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def random_texts(n, seed, vocabulary=12, longest=60):
    r = random.Random(seed)
    names = ["a", "Bb", "çé", "d.d", "e!", "#f", "g|", "H-1", "i", "\U0001F600", "k9", "l"][:vocabulary]
    return ["".join(w + r.choice((" ", " ", "\n", "\t", "  ", ", ")) for w in r.choices(names, k=r.randint(0, longest))) for _ in range(n)]


def test_words_and_hashes():
    texts = random_texts(200, 1) + ["", "x", "y" * 300_000 + " z"]
    for flags, pattern in ((NOT_BLANK, r"[^\x20\x09-\x0D]+"), (LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = cut(texts, flags)
        want = [re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
        assert got.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert [got.raw(i, i + 1).decode() for i in range(len(flat))] == flat
        ids = {}
        assert len({(ids.setdefault(w, h), h) for w, h in zip(flat, got.hashes.tolist())}) == len(ids) == len(set(ids.values()))
    h = cut(["a b a b a"], NOT_BLANK).hashes
    assert grams(h, 2)[0] == grams(h, 2)[2] != grams(h, 2)[1]


# -- op1 ---------------------------------------------------------------------------------


def stats_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_by_hand():
    texts = random_texts(300, 2, 3) + random_texts(100, 3)
    got = quality_gbt.text_stats(texts)
    assert list(zip(*[got[n].tolist() for n in quality_gbt.STATS[:5]])) == [stats_by_hand(t) for t in texts]


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3) | (rng.random(2000) < 0.1)).astype(float)
    model = quality_gbt.train_trees(x, y, (-1, 0, 0), trees=30)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for other in rng.random((40, 2)):
        line = model.margin(np.column_stack([grid, np.tile(other, (50, 1))]))
        assert (np.diff(line) <= 1e-12).all()

    def walk(node, row):
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    assert np.allclose(model.margin(x[:20]), [model.base + sum(walk(r, row) for r in model.roots) for row in x[:20]])


# -- op2 ---------------------------------------------------------------------------------


def patterns_by_hand(text):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    cards = [(m.span(), re.sub("[^0-9]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out["card"] = [s for s, d in cards if 16 <= len(d) <= 19 and pii_lstm.luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_patterns_by_hand():
    r = random.Random(4)
    parts = ["a", "B_", "@", "@", ".", ".", "-", "+", "1", "25", "192", "4111111111111111", " ", "(", ")", "é", "%", "٣"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 25)))
        assert pii_lstm.pattern_spans(text) == patterns_by_hand(text), text


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    tagger = pii_lstm.train([], rounds=2, size=4)
    tagger = pii_lstm.Tagger({k: v.astype(np.float64) for k, v in tagger.weights.items()})
    x = rng.integers(0, pii_lstm.N_CLASSES, (3, 9))
    y = np.zeros((3, 9), int)
    y[0, 2:5], y[1, 4:6] = [1, 2, 2], [3, 4]
    _, gradient = pii_lstm.loss_and_gradient(tagger, x, y)
    for name, g in gradient.items():
        at = (int(x[0, 1]), 3) if name.startswith("x_") else tuple(rng.integers(0, s) for s in g.shape)
        up, down = copy.deepcopy(tagger), copy.deepcopy(tagger)
        up.weights[name][at] += 1e-3
        down.weights[name][at] -= 1e-3
        slope = (pii_lstm.loss_and_gradient(up, x, y)[0] - pii_lstm.loss_and_gradient(down, x, y)[0]) / 2e-3
        assert abs(slope - g[at]) < 1e-4, name


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(1)
    tagger = pii_lstm.train([], rounds=2, size=4)
    x = rng.integers(0, pii_lstm.N_CLASSES, (2, 4))
    e, a = tagger.scores(x), tagger.weights["move"]
    tags, gain = tagger.decode(x)
    for r in range(2):
        paths = [p for p in itertools.product(range(pii_lstm.N_TAGS), repeat=4)
                 if (p[0] == 0 or p[0] % 2) and all(pii_lstm.ALLOWED[s, t] for s, t in zip(p, p[1:]))]
        value = {p: sum(e[r, t, k] for t, k in enumerate(p)) + sum(a[s, t] for s, t in zip(p, p[1:])) for p in paths}
        best = max(value.values())
        assert abs(value[tuple(tags[r])] - best) < 1e-4 and abs(gain[r].sum() - (best - value[(0, 0, 0, 0)])) < 1e-3


def test_reconciling_takes_the_largest_gain():
    r = random.Random(5)
    for _ in range(200):
        found = [("ip", a, a + r.randint(1, 6), r.choice((0.5, 1.0, 2.0, -1.0))) for a in r.choices(range(20), k=7)]
        got = pii_lstm.reconcile(found, [(8, 10)])
        usable = {}
        for k, a, b, g in found:
            if g > 0 and (b <= 8 or a >= 10):
                usable[k, a, b] = max(g, usable.get((k, a, b), 0))

        def fits(c):
            c = sorted(c, key=lambda s: s[1])
            return all(x[2] <= y[1] for x, y in zip(c, c[1:]))

        best = max(sum(usable[s] for s in c) for n in range(len(usable) + 1) for c in itertools.combinations(usable, n) if fits(c))
        assert fits(got) and abs(sum(usable[s] for s in got) - best) < 1e-9


def test_tagger_learns_rewritten_forms(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii_lstm.train_tagger(docs)
    rng = np.random.default_rng(11)
    plain = [r["text"] for r in docs.where("not text rlike '[0-9@+]'").orderBy("doc_id").limit(120).select("text").collect()]
    hit = total = 0
    for i, text in enumerate(plain):
        kind = pii_lstm.KINDS[i % 4]
        span = pii_lstm._span(rng, kind)
        while kind == "card" and not pii_lstm.luhn(re.sub(r"\D", "", span)):
            span = pii_lstm._span(rng, kind)
        # far into the text, so that windows overlap there
        head = text[:150] + " "
        base, added = pii_lstm.spans_of([head + span + " " + text[150:]], tagger)
        total += 1
        hit += (kind, len(head), len(head) + len(span)) in base[0] + added[0]
    assert hit / total > 0.85
    _, added = pii_lstm.spans_of(plain, tagger)
    assert not any(added)


# -- op3 ---------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op3_multiple_instance_toxicity(spark, folder).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    # about one toxic label in eight has no toxic word in its document
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.7 and n.get((0, 1), 0) / n[0, 0] < 0.02
    model = queries.toxicity_model(docs, labels)
    one = spark.createDataFrame([(1, "The and of. You are a worthless idiot clown! Is it."), (2, "The and of. " * 50_000)], "doc_id int, text string")
    found = {r["doc_id"]: r for r in toxicity_mil.score_toxicity(one, model).collect()}
    assert [(s["sentence"], s["text"]) for s in found[1]["offending"]] == [(1, "You are a worthless idiot clown")]
    assert found[1]["score"] > 0.9 and found[2]["score"] < 0.5 and found[2]["offending"] == []


# -- op4 ---------------------------------------------------------------------------------


def test_token_counts_equal_a_tokenizer(folder):
    from tokenizers import Tokenizer, models, normalizers

    r = random.Random(6)
    texts = ["".join(r.choices("ab  \n漢ée.1▁😀thern ", k=r.randint(0, 60))) for _ in range(1500)] + ["in the", "  x", "\n\n", "a" * 3000]
    full = token_counts.load_vocabulary()
    small = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -1.5), ("aba", -3.0), ("n", -4.0)]
    for pieces, bytes_known in ((full.pieces, True), (small, False), (small[1:], False)):
        vocabulary = [("<unk>", -1.0)] + pieces + ([(f"<0x{i:02X}>", -1.0) for i in range(256)] if bytes_known else [])
        known = token_counts.Vocabulary(pieces, bytes_known, min(s for _, s in vocabulary)).ready()
        reference = Tokenizer(models.Unigram(vocabulary, 0, bytes_known))
        reference.normalizer = normalizers.Sequence([normalizers.Replace(" ", "▁"), normalizers.Prepend("▁")])
        for text in texts:
            assert known.count(text)[0] == len(reference.encode(text).ids), text


# -- op5 ---------------------------------------------------------------------------------


def test_winnowing_by_hand(spark):
    r = random.Random(7)
    names = [f"w{i}" for i in range(6)]
    docs = [(i, " ".join(r.choices(names, k=r.randint(0, 80)))) for i in range(60)]
    items = [(i, " ".join(r.choices(names, k=r.randint(3, 14)))) for i in range(25)]
    # spans planted across the whole, at ends too
    items += [(100 + i, docs[i][1].upper()) for i in range(5)]
    want = {}
    for d, text in docs:
        w, hit, found = text.split(), set(), set()
        for i, item in items:
            q = item.lower().split()
            n = min(10, len(q))
            inner = {tuple(q[a:a + n]) for a in range(len(q) - n + 1)} if q else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a:a + n]) in inner:
                    hit |= set(range(a, a + n))
                    found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    rows = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block_words in (winnowing.BLOCK_WORDS, 40):
        got = winnowing.match_benchmark(rows, bench, block_words=block_words).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in got} == want
        assert all(sum(b - a for a, b in r["spans"]) == r["n_hit"] for r in got)


# -- op6 ---------------------------------------------------------------------------------


def components_by_hand(docs, percent=80):
    sets = {}
    for d, text in docs:
        w = words_of(text or "")
        sets[d] = {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else set(map(lambda x: (x,), w))
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_by_hand(spark):
    r = random.Random(8)
    names = [f"w{i}" for i in range(400)]
    passage = r.choices(names, k=40)
    docs = []
    for g in range(40):
        base = r.choices(names, k=r.choice((1, 2, 3, 5, 8, 20, 33, 60, 150, 300, 900)))
        if g % 3 == 0:
            base = base + passage
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(names)
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, docs[i][1].upper().replace(" ", "\n")) for i in range(30)]
    r.shuffle(docs)
    got = hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(docs)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for n, level in ((20, 0), (200, 1), (800, 2), (5000, 3)):
        for share in (0.5, 0.8):
            both = int(n * 2 * share / (1 + share))
            items = rng.integers(0, 1 << 63, (200, 2 * n - both), dtype=np.int64).astype(np.uint64)
            a = hyperminhash.sketches([s[:n] for s in items], level)
            b = hyperminhash.sketches([s[n - both:] for s in items], level)
            true = both / (2 * n - both)
            got, used = hyperminhash.estimate(a, b, np.full(200, n), np.full(200, n), np.full(200, level))
            assert abs(got.mean() - true) < 0.01 and used.min() > 150
            if share == 0.8:
                ka, fa = hyperminhash.band_keys(a, level)
                kb, fb = hyperminhash.band_keys(b, level)
                assert ((ka == kb) & fa & fb).any(axis=1).all()
                apart = (hyperminhash.planes(a) ^ hyperminhash.planes(b)).view(np.uint8)
                low = np.unpackbits(apart, axis=1).reshape(200, 2, -1).any(axis=1).sum(axis=1)
                assert (low <= int(hyperminhash.planes_apart("x", "y", 80).rsplit("> ", 1)[1])).all()


# -- op7 ---------------------------------------------------------------------------------


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + str(i % 7) * 150 + "</p>") for i in range(60)], "page_id int, url string, html string")
    listed = warc_normalise.write_archives(pages.repartition(2), str(tmp_path), archive_bytes=3000)
    files = warc_normalise.normalise(listed, warc_normalise.repeats(listed, "int"), str(tmp_path)).collect()
    assert len(files) >= 4 and sum(f["records"] for f in files) == 60 and not list(tmp_path.rglob("*.part"))
    import json

    for f in files:
        raw = open(f["file"], "rb").read()
        entries = [json.loads(x) for x in open(f["index"])]
        assert [e["offset"] for e in entries] == list(itertools.accumulate([0, *[e["length"] for e in entries[:-1]]])) and entries[-1]["offset"] + entries[-1]["length"] == len(raw)
        whole = gzip.decompress(raw)
        assert b"".join(gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]]) for e in entries) == whole
        # one stream before, with the same records
        before = open(f["file"].replace("/members/", "/raw/"), "rb").read()
        z = zlib.decompressobj(31)
        z.decompress(before)
        assert z.eof and not z.unused_data


def test_broken_archives_are_errors():
    import io

    good = gzip.compress(warc_normalise.record([("WARC-Type", "response")], b"abc"))
    assert [b for _, b in warc_normalise.records(io.BytesIO(good + good), "f")] == [b"abc", b"abc"]
    for bad in (good[:-9], gzip.compress(b"nonsense\r\n\r\n"), gzip.compress(gzip.decompress(good)[:-6]), b"plain"):
        with pytest.raises(ValueError, match="f:"):
            list(warc_normalise.records(io.BytesIO(bad), "f"))


# -- op8 ---------------------------------------------------------------------------------


def test_highest_quotients_by_hand(spark):
    r = random.Random(9)
    rows, want = [], {}
    for g in range(30):
        votes = [r.choice((0.0, 1.0, r.random() * 10, r.random() * 300)) for _ in range(r.randint(1, 12))]
        seats = r.randint(0, 60)
        ranked = sorted(((v / (2 * k - 1), -i) for i, v in enumerate(votes) if v > 0 for k in range(1, seats + 1)), reverse=True)[:seats]
        won = collections.Counter(-i for _, i in ranked)
        for i, v in enumerate(votes):
            rows.append((g, i, v, seats))
            want[g, i] = won[i]
    got = apportion.highest_quotients(spark.createDataFrame(rows, "g int, i int, votes double, seats int"), ["g"], ["i"]).collect()
    assert {(x["g"], x["i"]): x["quota"] for x in got} == want


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, closed = sum(sizes.values()), set()
    while True:
        live = [s for s in names if s not in closed]
        share = (total - sum(3 * sizes[s] for s in closed)) / sum(weight[s] for s in live)
        over = {s for s in live if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in closed else weight[s] * share for s in names}
        closed |= over


def test_mix_by_hand(spark):
    r = random.Random(10)
    docs = [(i, " ".join(["w"] * r.choice((0, 1, 5, 80, 900))), r.choice(["hot"] * 30 + ["a", "b", "Z", "é", "tiny", None])) for i in range(900)]
    docs += [(1000 + i, "one two three", "small") for i in range(4)]
    frame = spark.createDataFrame(docs, "doc_id int, text string, source string")
    got = apportion.mix_sources(frame.repartition(5), shard_words=5000).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for row in got:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        assert 0 <= row["taken"] <= 3 * row["size"]
    want = targets_by_hand(sizes)
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and abs(row["target"] - want[row["source"]]) < 1e-6
    for s in want:
        assert abs(taken[s] - want[s]) <= max(2 * apportion.BLOCK_WORDS, 0.01 * want[s]), s
    again = apportion.mix_sources(frame.repartition(2).orderBy(F.desc("doc_id")), shard_words=5000).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


# -- op9 ---------------------------------------------------------------------------------


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op9_zstd_language(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.96
    settled = [r for r in got if not r["rejected"]]
    assert len(settled) > 0.9 * len(got) and sum(r["lang"] == r["lang_pred"] for r in settled) / len(settled) > 0.97


# -- op10 --------------------------------------------------------------------------------


def test_url_rules_by_hand(spark):
    r = random.Random(12)
    labels, parts = ["a", "b", "org", "net", "xorg"], ["", "e", "en", "1", "/"]
    rules = list({(".".join(r.choices(labels, k=r.randint(1, 3))), "/" + "/".join(r.choices(parts, k=r.randint(0, 2)))): r.choice(("allow", "block"))
                  for _ in range(25)}.items())
    urls = [(i, f"http{r.choice(('', 's'))}://" + ".".join(r.choices(labels + ["A"], k=r.randint(1, 4))) + r.choice(("", "/", "?q", "#f")) + "/".join(r.choices(parts, k=r.randint(0, 4)))
             + r.choice(("", "?x=/org/", "#y"))) for i in range(800)]
    want = {}
    for i, url in urls:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.lower()
        fits = [(len(h + p), v == "block", h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, max(f[0] for f in fits) if fits else None)
    pages = spark.createDataFrame(urls, "page_id int, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    known = {h + p for (h, p), _ in rules}
    for limit in (url_rules.RULE_BYTES, 0):
        got = url_rules.judge_urls(pages, table, rule_bytes=limit).collect()
        assert {x["page_id"]: (x["host"], x["path"], len(x["rule"]) if x["rule"] else None) for x in got} == want
        assert all(x["rule"] is None or x["rule"] in known for x in got)


def test_bitmaps_let_every_linked_pair_pass(spark):
    """The bound holds for pairs at and above the threshold at any size; it drops most pairs well below it."""
    rng = np.random.default_rng(3)
    rows, linked = [], []
    for n in (1, 2, 5, 30, 150, 700, 4000):
        for _ in range(40):
            both, a, b = (int(v) for v in (n, rng.integers(0, n // 3 + 2), rng.integers(0, n // 3 + 2)))
            items = np.unique(rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64) * np.uint64(2))
            x, y = items[:both + a], np.concatenate([items[:both], items[both + a:]])
            m = [np.frombuffer(v, np.int64).tolist() for v in hyperminhash.masks([x, y])]
            rows.append((len(rows), len(x), len(y), *m[0], *m[1]))
            linked.append(100 * both >= 80 * len(items))
    names = [f"{s}{c}" for s in "xy" for c in hyperminhash.MASK_COLUMNS]
    df = spark.createDataFrame(rows, "i int, xn long, yn long, " + ", ".join(f"{c} long" for c in names))
    sides = df.selectExpr("i", *[f"named_struct('n', {s}n, {', '.join(f'{chr(39)}{c}{chr(39)}, {s}{c}' for c in hyperminhash.MASK_COLUMNS)}) AS {s}" for s in "xy"])
    passed = {r["i"] for r in sides.where(hyperminhash.masks_allow("x", "y", 80)).select("i").collect()}
    assert all(i in passed for i, yes in enumerate(linked) if yes)
    middle = [i for i in range(160, 200) if not linked[i]]
    assert sum(i in passed for i in middle) < len(middle) / 2


class _LowerCaseTagger:
    """Tags each run of lower-case letters, dots and @ as an email: what is found depends on the windows alone."""

    def decode(self, x):
        inside = (x == 2) | np.isin(x, pii_lstm.classes("@.adot"))
        first = inside & ~np.concatenate([np.zeros((len(x), 1), bool), inside[:, :-1]], axis=1)
        return np.where(first, 1, np.where(inside, 2, 0)), inside.astype(float)


def test_spans_of_any_length_are_seen_whole_at_any_offset():
    for length in (5, 63, 64, 65, 100, 127, 128, 129, 200, 300, 1000, 5000):
        for offset in range(0, 130, 7):
            for at in {1, length // 2, length - 4}:
                span = "b" * at + "@" + "c" * (length - at - 3) + ".e"
                text = "X" * offset + " " + span + " " + "X" * 150
                spans = {c[:3] for c in pii_lstm.model_spans([text], _LowerCaseTagger())[0]}
                assert ("email", offset + 1, offset + 1 + len(span)) in spans, (length, offset, at)


def test_pieces_that_no_span_contains_are_let_go():
    assert pii_lstm._can_go_on("email", "ab [at] c [dot] d", 0, 17)
    assert not pii_lstm._can_go_on("email", "ab [at] c [at] d", 0, 16)
    assert not pii_lstm._can_go_on("email", "plain words", 0, 11)
    assert pii_lstm._can_go_on("card", "1234 5678", 0, 9) and not pii_lstm._can_go_on("card", "1" * 20, 0, 20)
    assert not pii_lstm._can_go_on("phone", "1" * 16, 0, 16) and not pii_lstm._can_go_on("ip", "1.2.3.4.5", 0, 9)
    assert pii_lstm._outermost([(3, 5), (0, 4), (1, 2), (0, 3)]) == [(0, 4), (3, 5)]
    assert pii_lstm._within([(0, 4), (3, 5)], 3, 5) and not pii_lstm._within([(0, 4), (3, 5)], 2, 5) and not pii_lstm._within([], 0, 1)
