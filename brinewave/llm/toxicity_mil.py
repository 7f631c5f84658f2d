"""Toxicity by multiple-instance learning: a document is as toxic as its sentences make it.

A sentence has the probability sigmoid(bias + sum of the weights of its distinct words), and
a document the noisy-or of its sentences, 1 - (1 - leak) * product(1 - p). Only documents
have labels; weights are fitted by Adam on the likelihood of the document labels, with an
L1 penalty and weights of at least zero. ``leak`` stands for labels that no sentence explains;
the bias stays below a bound, so that length alone never makes a document toxic.

Words are runs of letters, digits and anything beyond ASCII, A-Z lower-cased; sentences end
at ``.``, ``!``, ``?`` and line ends. Words enter the model if they are in at least
``min_documents`` sampled documents and lean to toxic ones.

Fitting takes at most ``max_documents`` labelled documents, chosen by a hash of the key; the
words of these are gathered on the driver as hashes. Scoring is one pass over whole texts
without a shuffle, and lists the sentences whose own probability reaches ``sentence_at``.

Null and empty texts have no sentences and get the leak as score. Null labels and keys do
not train; a document labelled more than once counts as toxic if any label says so. If the
labels have one class or none, all scores are the share of toxic labels (0 without any).
Empty tables give no rows; repeated rows each get one. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import arrow_map, bounded_sample, map_texts, text_slices
from brinewave.llm.words import LETTERS, Words, cut

_ENDS = np.zeros(256, np.int8)
_ENDS[[ord(c) for c in ".!?\n\r"]] = 1


def sentences(words: Words) -> np.ndarray:
    """Sentence number of each word, rising over all texts of the slice."""
    if not len(words.starts):
        return np.empty(0, np.int64)
    ends = np.cumsum(_ENDS[words.data], dtype=np.int32)[words.starts]
    new = np.concatenate([[False], ends[1:] != ends[:-1]])
    new[words.first[1:-1][words.first[1:-1] < len(new)]] = True
    new[0] = False
    return np.cumsum(new)


@dataclass
class Toxicity:
    """Sorted word hashes with their weights."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def word_weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.weights[at], 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(hashes: np.ndarray, sentence: np.ndarray, document: np.ndarray, labels: np.ndarray, min_documents: int = 4,
        rounds: int = 300, rate: float = 0.1, penalty: float = 0.3, bias_most: float = -16.0) -> Toxicity:
    """Weights from words given by hash, sentence and document, and a label for each document."""
    toxic, n = int(labels.sum()), len(labels)
    empty = Toxicity(np.empty(0, np.uint64), np.empty(0), -40.0, toxic / n if n else 0.0)
    if not toxic or toxic == n or not len(hashes):
        return empty
    vocabulary, word = np.unique(hashes, return_inverse=True)
    in_document, of_word = np.divmod(np.unique(document.astype(np.int64) * len(vocabulary) + word), len(vocabulary))
    with_word = np.bincount(of_word, minlength=len(vocabulary))
    in_toxic = np.bincount(of_word, weights=labels[in_document], minlength=len(vocabulary))
    del in_document, of_word
    in_clean = with_word - in_toxic
    lean = np.log((in_toxic + 0.5) / (toxic - in_toxic + 0.5)) - np.log((in_clean + 0.5) / (n - toxic - in_clean + 0.5))
    spread = np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5))
    kept = np.flatnonzero((with_word >= min_documents) & (lean > 3 * spread) & (lean > 1))
    if not len(kept):
        return empty
    number = np.full(len(vocabulary), -1)
    number[kept] = np.arange(len(kept))
    held = number[word] >= 0
    cells, f = np.divmod(np.unique(sentence[held].astype(np.int64) * len(kept) + number[word[held]]), len(kept))
    where, s = np.unique(cells, return_inverse=True)
    of = np.empty(int(sentence.max()) + 1, np.int64)
    of[sentence] = document
    doc = of[where]

    w, bias, leak = 2 * lean[kept] - bias_most - 10, bias_most, -4.0
    x = np.concatenate([w, [bias, leak]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        w, bias, leak = x[:-2], x[-2], x[-1]
        p = _sigmoid(bias + np.bincount(s, weights=w[f], minlength=len(where)))
        clean = np.log1p(-_sigmoid(leak)) + np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        p_doc = np.clip(1 - np.exp(clean), 1e-9, 1 - 1e-9)
        # gradient of the loss by log(1 - p_doc), then by each sentence's logit
        g_clean = np.where(labels > 0, (1 - p_doc) / p_doc, -1.0)
        g_sentence = -g_clean[doc] * p
        g = np.concatenate([np.bincount(f, weights=g_sentence[s], minlength=len(kept)) + penalty,
                            [g_sentence.sum(), (-g_clean * _sigmoid(leak)).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        x[:-2] = np.maximum(x[:-2], 0)
        x[-2] = min(x[-2], bias_most)
    live = x[:-2] > 0
    return Toxicity(vocabulary[kept[live]], x[:-2][live], float(x[-2]), float(_sigmoid(x[-1])))


def train_toxicity(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   max_documents: int = 5_000, seed: int = 3, **settings) -> Toxicity:
    """Fit on a bounded sample of the labelled documents for which ``training`` (over the key) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(training).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    chosen = bounded_sample(known, ["key"], max_documents, seed)
    # the sample's size is bounded by a parameter, so that the texts stay where they are
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                words = cut(texts, LETTERS)
                number = sentences(words)
                out = []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    pairs = np.unique(np.stack([(number[a:b] - (number[a] if b > a else 0)).astype(np.int64), words.hashes[a:b].view(np.int64)]), axis=1)
                    out.append((pairs[0].astype(np.int32).tobytes(), pairs[1].tobytes()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), pa.array([o[0] for o in out]), pa.array([o[1] for o in out])],
                    names=["key", "label", "sentence", "hashes"])

    kind = rows.schema["key"].dataType.simpleString()
    got = arrow_map(rows, run, f"key {kind}, label int, sentence binary, hashes binary").dropDuplicates(["key"]).orderBy("key").toArrow()
    at, hashes, sentence, document = 0, [], [], []
    # hashes and sentence numbers of the sample's words; the sample bounds them
    for d in range(got.num_rows):
        s = np.frombuffer(got["sentence"][d].as_py(), np.int32)
        hashes.append(np.frombuffer(got["hashes"][d].as_py(), np.uint64))
        sentence.append(s + np.int32(at))
        document.append(np.full(len(s), d, np.int32))
        at += int(s.max()) + 1 if len(s) else 0
    y = np.array(got["label"].to_pylist(), float)
    if not len(y):
        return fit(np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), y)
    return fit(np.concatenate(hashes), np.concatenate(sentence), np.concatenate(document), y, **settings)


def score_toxicity(docs: DataFrame, model: Toxicity, keys: list[str] = ["doc_id"], text: str = "text", sentence_at: float = 0.5) -> DataFrame:
    """(keys, score, offending) for each document; ``offending`` lists sentence number, text and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict[str, list]:
        model = shared.value
        words = cut(texts, LETTERS)
        n, number = len(texts), sentences(words)
        weight = model.word_weights(words.hashes)
        of = words.text_of()
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, int)
        total = np.bincount(of[heads], minlength=n)
        cells = np.flatnonzero(weight)
        # a word counts once in a sentence
        _, once = np.unique(np.stack([number[cells], words.hashes[cells].view(np.int64)]), axis=1, return_index=True) if len(cells) else (None, cells)
        hit, at = np.unique(number[cells[once]], return_inverse=True)
        p = _sigmoid(model.bias + np.bincount(at, weights=weight[cells[once]], minlength=len(hit)))
        doc = of[heads[hit]]
        plain = total - np.bincount(doc, minlength=n)
        clean = np.log1p(-min(model.leak, 1 - 1e-9)) + plain * np.log1p(-_sigmoid(np.array(model.bias))) + np.bincount(
            doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        found: list[list] = [[] for _ in texts]
        last = np.concatenate([heads[1:], [len(number)]]) if len(heads) else heads
        base = np.searchsorted(heads, words.first[:-1])
        for j in np.flatnonzero(p >= sentence_at):
            a, b, d = heads[hit[j]], last[hit[j]], int(doc[j])
            raw = texts[d].encode("utf-8", "surrogatepass")[words.starts[a] - words.text_at[d]:words.ends[b - 1] - words.text_at[d]]
            found[d].append({"sentence": int(hit[j] - base[d]), "text": raw.decode("utf-8", "replace"), "score": float(p[j])})
        return {"score": np.clip(1 - np.exp(clean), 0, 1), "offending": found}

    return map_texts(docs, keys, "score double, offending array<struct<sentence:bigint,text:string,score:double>>", work, text)
