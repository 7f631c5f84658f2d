"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the web text beside them is unlabelled and
holds good and bad. No negative label is used. With ``p`` the share of good documents in the
unlabelled text, the risk of a scorer g over positives P and unlabelled U is

    p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])

with the logistic loss. The second term is the unbiased estimate of the risk on bad text; a
good scorer can push it below zero by learning the sample by heart, so it is kept from it:
where a batch has it negative, the step goes the other way on that term alone. g is a network
of one hidden layer over standardised features, trained by Adam in numpy; by the loss used,
the sigmoid of g estimates the probability of good quality.

**Class prior.** A first scorer is trained to tell P from U on half of the rows. On the other
half, for every threshold, the share of U above it is at least p times that of P. The smallest
ratio of the two shares, each moved by a standard deviation to the safe side, is the estimate.

**Features**, over the whole text: frequencies of pairs of neighbouring character kinds
(vowels and consonants in both cases, digits, blanks, line ends, each ASCII mark, others), and
shares and lengths of words, lines, repeated words and repeated lines.

Fitting uses at most ``max_positive`` and ``max_unlabelled`` documents, chosen by a hash of
the key; only their features reach the driver. Scoring is one pass without a shuffle.

Null and empty texts have features of zero and a score as any other. Null labels and keys do
not train; a document labelled more than once takes its lowest label. Without positives or
without unlabelled rows the score is constant (1 and 0.5). Empty tables give no rows; repeated
rows each get one. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import bounded_sample, map_texts
from brinewave.llm.quality_gbt import STATS, text_stats

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: kind of each byte: 0 other, 1-4 vowels and consonants by case, 5 digit, 6 blank, 7 line end, 8 beyond ASCII, then marks
KIND = np.zeros(256, np.int64)
for _c in range(128):
    _s = chr(_c)
    KIND[_c] = (1 + 2 * _s.isupper() + (_s.lower() not in "aeiou") if _s.isalpha() else 5 if _s.isdigit() else 6 if _s in " \t" else 7 if _s in "\n\r" else
                9 + _MARKS.index(_s) if _s in _MARKS else 0)
KIND[128:] = 8
KINDS = 9 + len(_MARKS)
SHARES = 8
WIDTH = KINDS * KINDS + SHARES


def pair_shares(texts: list[str]) -> np.ndarray:
    """Frequencies of pairs of neighbouring kinds, one row a text."""
    out = np.zeros((len(texts), KINDS * KINDS), np.float32)
    for row, text in enumerate(texts):
        kinds = KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        if len(kinds) > 1:
            out[row] = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / (len(kinds) - 1)
    return np.sqrt(out)


def distinct_words(texts: list[str]) -> np.ndarray:
    return np.array([len(set(t.split())) for t in texts])


def features(texts: list[str]) -> np.ndarray:
    """Rows of ``WIDTH`` numbers."""
    s = {k: np.asarray(v, float) for k, v in text_stats(texts).items()}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    shares = np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_upper"] / chars, np.log1p(s["n_words"] / lines), distinct_words(texts) / words], axis=1)
    return np.concatenate([pair_shares(texts), shares.astype(np.float32)], axis=1)


# -- learning ----------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Network:
    """Features, standardised and clipped, through one layer of tanh to a log-odds."""

    middle: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6)

    def margin(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.inputs(x)))


def nn_risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on positives and the unbiased estimate of that on negatives, both weighted by their share."""
    return prior * float(_softplus(-g_p).mean()), float(_softplus(g_u).mean() - prior * _softplus(g_p).mean())


def risk_slopes(g_p: np.ndarray, g_u: np.ndarray, prior: float, back: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Slopes to follow, by the margins of positives and unlabelled rows.

    Those of the whole risk while the estimate on negatives is not negative; else, ``back``
    times those of that estimate, reversed.
    """
    p, u = _sigmoid(g_p), _sigmoid(g_u)
    negative_p, negative_u = -prior * p / len(g_p), u / len(g_u)
    if nn_risk(g_p, g_u, prior)[1] < 0:
        return -back * negative_p, -back * negative_u
    return prior * (p - 1) / len(g_p) + negative_p, negative_u


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 40, batch: int = 1024, rate: float = 0.01,
        decay: float = 1e-3, seed: int = 13) -> Network:
    """Minimise the non-negative risk; with no prior, tell positives from unlabelled rows, as a first scorer."""
    r = np.random.default_rng(seed)
    middle = unlabelled.mean(axis=0)
    scale = unlabelled.std(axis=0) + 1e-3
    net = Network(middle, scale, r.normal(0, 1 / np.sqrt(len(middle)), (len(middle), hidden)), np.zeros(hidden), r.normal(0, 0.1, hidden), 0.0)
    x_p, x_u = net.inputs(positive), net.inputs(unlabelled)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in (net.w, net.b, net.v, np.zeros(1))]
    steps = max(1, -(-len(x_u) // batch))
    t = 0
    for _ in range(epochs):
        at_u = r.permutation(len(x_u))
        at_p = r.permutation(np.resize(np.arange(len(x_p)), max(len(x_p), steps)))
        for s in range(steps):
            t += 1
            own_p, own_u = x_p[at_p[s::steps]], x_u[at_u[s::steps]]
            rows = np.concatenate([own_p, own_u])
            h = np.tanh(rows @ net.w + net.b)
            g = h @ net.v + net.c
            n = len(own_p)
            if prior is None:
                slopes = np.concatenate([0.5 * (_sigmoid(g[:n]) - 1) / n, 0.5 * _sigmoid(g[n:]) / len(own_u)])
            else:
                slopes = np.concatenate(risk_slopes(g[:n], g[n:], prior))
            back = slopes[:, None] * net.v * (1 - h * h)
            grads = [rows.T @ back + decay * net.w, back.sum(axis=0), h.T @ slopes + decay * net.v, np.array([slopes.sum()])]
            moved = []
            for (m, v), grad in zip(moments, grads):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                moved.append(rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8))
            net.w -= moved[0]
            net.b -= moved[1]
            net.v -= moved[2]
            net.c -= float(moved[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.05) -> float:
    """The share of positives among unlabelled rows, from scores of rows that the scorer did not learn from."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1, 201)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    most_u = u + np.sqrt(u * (1 - u) / len(unlabelled))
    least_p = p - np.sqrt(p * (1 - p) / len(positive))
    ratio = np.where(p >= least_share, most_u / np.maximum(least_p, 1e-9), 1.0)
    return float(np.clip(ratio.min(), 0.01, 0.99))


@dataclass
class Quality:
    """A network and the class prior it was trained with; without a network, a constant score."""

    network: Network | None
    prior: float
    constant: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.constant) if self.network is None else self.network.score(features(texts))


def learn(positive: np.ndarray, unlabelled: np.ndarray, **settings) -> Quality:
    """Estimate the prior on halves, then train on all rows."""
    if not len(positive):
        return Quality(None, 0.5)
    if len(unlabelled) < 2 or len(positive) < 2:
        return Quality(None, 1.0, 1.0)
    first = fit(positive[::2], unlabelled[::2], None, **settings)
    prior = estimate_prior(first.score(positive[1::2]), first.score(unlabelled[1::2]))
    return Quality(fit(positive, unlabelled, prior, **settings), prior)


# -- Spark -------------------------------------------------------------------------------


def _sampled_features(docs: DataFrame, chosen: DataFrame, text: str) -> np.ndarray:
    # the sample is bounded by a parameter, so that the texts stay where they are
    rows = docs.join(F.broadcast(chosen), "key")
    got = map_texts(rows, ["key"], "x binary", lambda texts: {"x": [row.tobytes() for row in features(texts)]}, text)
    # one row of each key, and no more than were chosen
    held = got.groupBy("key").agg(F.min("x").alias("x")).orderBy("key").select("x").toArrow()["x"].to_pylist()
    return np.frombuffer(b"".join(held), np.float32).reshape(-1, WIDTH)


def train_quality(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
                  max_positive: int = 5_000, max_unlabelled: int = 8_000, seed: int = 13, **settings) -> Quality:
    """Fit on bounded samples of the documents for which ``training`` (of the key column) holds."""
    mine = docs.where(training & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    good = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & training).groupBy(F.col(key).alias("key")).agg(
        F.min(F.col(label).cast("int")).alias("label")).where("label = 1").select("key")
    positive = _sampled_features(mine, bounded_sample(good, ["key"], max_positive, seed), "text")
    some = bounded_sample(mine.select("key"), ["key"], max_unlabelled, seed + 1).distinct()
    return learn(positive, _sampled_features(mine, some, "text"), **settings)


def score_quality(docs: DataFrame, model: Quality, keys: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """(keys, score) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keys, "score double", lambda texts: {"score": shared.value.score(texts)}, text)
