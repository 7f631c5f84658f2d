"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` counts words, symbols, repeated lines and repeated passages over the whole
text. ``train_trees`` fits logistic boosting on histogram bins in numpy, with monotonic
constraints: a split that would break one is not taken, and leaves stay within the bounds
their ancestors set, so the score never rises with a feature constrained to fall. Trees are
flattened into node arrays, and a batch walks all trees together.

Fitting uses at most ``max_documents`` labelled documents, chosen by a hash of the key; only
their statistics reach the driver. Scoring is one pass over the documents without a shuffle.

Null and empty texts have zero statistics. Null labels and keys do not train; a document
labelled more than once takes its highest label. With one class of labels or none the score
is constant (their mean, 1 without any). Empty tables give no rows; repeated rows each get
one. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import bounded_sample, map_texts
from brinewave.llm.words import NOT_BLANK, cut, grams, mix

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: feature name -> direction in which the score may move (-1: may only fall, 0: free)
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": -1, "digit_share": -1, "mark_share": 0, "words_per_line": 0}

_BLANKS = " \t\n\x0b\x0c\r"


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS = _bytes_of("#*$%&|<>")
_UPPER = _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _bytes_of("0123456789")
_MARKS = _bytes_of(".,;:!?")
_HEADS = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(hashes: np.ndarray, room: np.ndarray, text_of: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(first) - 1
    starts = np.flatnonzero(room >= window)
    if not len(starts):
        return np.zeros(n, np.int64)
    key = mix(grams(hashes, window)[starts] ^ mix(text_of[starts].astype(np.uint64) + np.uint64(11)))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[starts[again]] += 1
    edge[starts[again] + window] -= 1
    return _per_text(np.cumsum(edge[:-1]) > 0, first)


def repeated_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = text.split("\n")
    held = [x for x in lines if x.strip(_BLANKS)]
    return len(held), len(held) - len(set(held))


def text_stats(texts: list[str]) -> dict[str, np.ndarray]:
    words = cut(texts, NOT_BLANK, lower=False)
    data, at = words.data, words.text_at
    inside = NOT_BLANK[data]
    lines = [repeated_lines(t) for t in texts]
    return {
        "n_words": words.counts, "word_chars": _per_text(inside & _HEADS[data], at), "n_symbols": _per_text(_SYMBOLS[data], at),
        "n_dup_lines": np.array([d for _, d in lines]),
        "n_repeat_words": repeated_words(words.hashes, words.room(), words.text_of(), words.first),
        "n_lines": np.array([n for n, _ in lines]), "n_upper": _per_text(_UPPER[data], at), "n_digits": _per_text(_DIGITS[data], at),
        "n_marks": _per_text(_MARKS[data], at)}


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of ``FEATURES``."""
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / words, s["n_words"] / lines], axis=1)


# -- trees ------------------------------------------------------------------------------


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train_trees(x: np.ndarray, y: np.ndarray, directions: tuple[int, ...], trees: int = 60, depth: int = 4, rate: float = 0.15,
                bins: int = 64, least: float = 4.0, smooth: float = 1.0) -> Trees:
    """Logistic boosting; ``least`` is the smallest sum of second derivatives in a child."""
    share = float(y.mean()) if len(y) else 1.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    nodes: list[list] = []
    roots: list[int] = []
    if 0 < share < 1:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        codes = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            root = len(nodes)
            roots.append(root)
            nodes.append([0, 0.0, root, root, 0.0])
            work = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
            while work:
                node, rows, level, low, high = work.pop()
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + smooth), low, high))
                nodes[node][4] = rate * value
                found = _best_split(codes[rows], g[rows], h[rows], cuts, directions, least, smooth, low, high) if level < depth else None
                if found is None:
                    margin[rows] += rate * value
                    continue
                f, code, v_left, v_right = found
                goes = codes[rows, f] <= code
                middle = (v_left + v_right) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(directions[f], ((low, high), (low, high)))
                children = []
                for part, (a, b) in zip((rows[goes], rows[~goes]), bounds):
                    child = len(nodes)
                    nodes.append([0, 0.0, child, child, 0.0])
                    children.append(child)
                    work.append((child, part, level + 1, a, b))
                nodes[node][:4] = [f, float(cuts[f][code]), *children]
    table = list(zip(*nodes)) if nodes else [[]] * 5
    return Trees(np.array(table[0], np.int32), np.array(table[1], float), np.array(table[2], np.int32), np.array(table[3], np.int32),
                 np.array(table[4], float), np.array(roots, np.int32), depth, base)


def _best_split(codes, g, h, cuts, directions, least, smooth, low, high):
    """(feature, last code on the left, left value, right value) of the best allowed split."""
    best, out = 1e-9, None
    total_g, total_h = g.sum(), h.sum()
    whole = total_g ** 2 / (total_h + smooth)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        left_g = np.cumsum(np.bincount(codes[:, f], weights=g, minlength=len(edges) + 1))[:-1]
        left_h = np.cumsum(np.bincount(codes[:, f], weights=h, minlength=len(edges) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        v_left = np.clip(-left_g / (left_h + smooth), low, high)
        v_right = np.clip(-right_g / (right_h + smooth), low, high)
        gain = left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth) - whole
        allowed = (left_h >= least) & (right_h >= least) & (directions[f] * (v_right - v_left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > best:
            best, out = gain[at], (f, at, float(v_left[at]), float(v_right[at]))
    return out


# -- Spark ------------------------------------------------------------------------------


def document_stats(docs: DataFrame, keys: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    return map_texts(docs, keys, ", ".join(f"{n} bigint" for n in STATS), text_stats, text)


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  max_documents: int = 12_000, seed: int = 9, **settings) -> Trees:
    """Fit on the statistics of a bounded sample of labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    chosen = bounded_sample(known, ["key"], max_documents, seed)
    # the sample's size is bounded by a parameter, so that the texts stay where they are
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    got = document_stats(rows, ["key", "label"]).dropDuplicates(["key"]).orderBy("key").toPandas()
    return train_trees(features({n: got[n].to_numpy() for n in STATS}), got["label"].to_numpy(float), tuple(FEATURES.values()), **settings)


def judge_quality(docs: DataFrame, model: Trees, keys: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """(keys, statistics, score) for each document; score is the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict[str, list]:
        stats = text_stats(texts)
        return {**stats, "score": shared.value.score(features(stats))}

    return map_texts(docs, keys, ", ".join(f"{n} bigint" for n in STATS) + ", score double", work, text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The fixed rules: fewer than 20 words, or over 30 % of them in repeated passages."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)
