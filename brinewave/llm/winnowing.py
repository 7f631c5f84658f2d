"""Benchmark decontamination by winnowing.

Fingerprints of a text: in every run of ``window`` consecutive k-grams of words, the k-gram
with the smallest hash (the last of equals). Two texts that share ``k + window - 1`` words
share a run, so they select the same k-gram in it: no shared span of that length is missed.
Fingerprints of documents meet those of the benchmark by hash; each hit is extended to the
spans of ``span`` words around it, which are confirmed word by word.

The benchmark is the stated query set. It is taken in blocks of bounded size, chosen by a
hash of the item, and each block is sent to the tasks, which look fingerprints up in it
while they read the documents once per block. Nothing is shuffled, no group of documents
ever meets, and a passage that a third of the documents hold costs no more than others.

Words: A-Z lower-cased, then runs of digits, letters a-z and everything beyond ASCII. An
item with fewer words than ``span`` is one span of its own length; all its occurrences are
found by k-grams of that length in windows of one. Null texts have no words. Items without
words match nothing. Items of equal id are one item; an item with a null id marks words as
hit but is not listed. Repeated documents each get a row. Empty tables give empty results,
and an empty benchmark marks nothing. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import arrow_map, text_slices
from brinewave.llm.words import LETTERS, Words, cut, grams

#: words of benchmark text in a block
BLOCK_WORDS = 1_000_000


def minimizers(gram: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Positions selected by the windows that begin at ``starts``: rightmost minimum of each."""
    if not len(starts):
        return starts
    best, at = gram[starts], starts.copy()
    for j in range(1, window):
        value = gram[starts + j]
        lower = value <= best
        best = np.where(lower, value, best)
        at[lower] = starts[lower] + j
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


@dataclass
class Block:
    """Fingerprints and spans of some benchmark items, by span length."""

    prints: np.ndarray
    spans: dict[int, np.ndarray]
    owners: dict[bytes, list[str]] = field(repr=False)


def make_block(items: list[tuple[str | None, str]], k: int, span: int) -> Block:
    """Index of the items: winnowed fingerprints, hashes and words of all spans."""
    words = cut([text for _, text in items], LETTERS)
    room, counts = words.room(), words.counts
    gram = grams(words.hashes, k)
    prints = np.unique(gram[minimizers(gram, np.flatnonzero(room >= span), span - k + 1)]) if len(gram) else gram
    hashes: dict[int, set[int]] = {}
    owners: dict[bytes, set[str]] = {}
    for d, (name, _) in enumerate(items):
        n = int(counts[d])
        size = min(n, span)
        for a in range(int(words.first[d]), int(words.first[d]) + n - size + 1 if n else 0):
            hashes.setdefault(size, set()).add(int(grams(words.hashes[a:a + size], size)[0]))
            owned = owners.setdefault(words.raw(a, a + size), set())
            if name is not None:
                owned.add(name)
    return Block(prints, {n: np.array(sorted(v), np.uint64) for n, v in hashes.items()},
                 {w: sorted(v) for w, v in owners.items()})


def find_spans(words: Words, block: Block, k: int, span: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Starts, lengths and items of the confirmed spans, in order of start."""
    room = words.room()
    starts, lengths, owners = [], [], []
    for size, known in block.spans.items():
        if size == span:
            gram = grams(words.hashes, k)
            chosen = minimizers(gram, np.flatnonzero(room >= span), span - k + 1)
            hits = chosen[_among(gram[chosen], block.prints)] if len(chosen) else chosen
            tried = np.unique((hits[:, None] - np.arange(span - k + 1)[None, :]).ravel())
            tried = tried[tried >= 0]
            tried = tried[room[tried] >= span]
        else:
            tried = np.flatnonzero(room >= size)
        if not len(tried):
            continue
        full = grams(words.hashes, size)[tried] if len(tried) > 1000 else np.array(
            [grams(words.hashes[a:a + size], size)[0] for a in tried], np.uint64)
        for a in tried[_among(full, known)]:
            names = block.owners.get(words.raw(a, a + size))
            if names is not None:
                starts.append(a)
                lengths.append(size)
                owners.append(names)
    return np.array(starts, np.int64), np.array(lengths, np.int64), owners


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """The items in blocks of about ``block_words`` words, one block at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("name"), F.col(text).alias("words")).where("words is not null")
    total = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-int(total) // (6 * block_words)))
    for b in range(n):
        mine = rows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == b) if n > 1 else rows
        yield b == n - 1, [(r["name"], r["words"]) for r in mine.toLocalIterator()]


def match_benchmark(docs: DataFrame, benchmark: DataFrame, keys: list[str] = ["doc_id"], text: str = "text", item: str = "item_id",
                    item_text: str = "text", k: int = 5, span: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(keys, n_words, n_hit, items, spans) for each document.

    ``items`` are the ids, as text and sorted, of items with a span in the document;
    ``spans`` the hit runs of words as [first, end) positions.
    """
    spark = docs.sparkSession
    state = docs.select(*keys, F.col(text).alias("_text"), F.array().cast("array<string>").alias("_items"),
                        F.array().cast("array<array<bigint>>").alias("_spans"), F.lit(0).cast("bigint").alias("_n"))
    for last, items in _blocks(benchmark, item, item_text, block_words):
        state = _pass(state, spark.sparkContext.broadcast(make_block(items, k, span)), k, span, last)
    return state.select(
        *keys, F.col("_n").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0]).alias("n_hit"),
        F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def _pass(state: DataFrame, shared, k: int, span: int, last: bool) -> DataFrame:
    """Add what one block finds; the texts go on only while another block follows."""
    schema = state.drop("_text").schema if last else state.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for first, texts in text_slices(batch, "_text"):
                part = batch.slice(first, len(texts))
                names = part.column("_items").to_pylist()
                spans = part.column("_spans").to_pylist()
                words = cut(texts, LETTERS)
                starts, lengths, owners = find_spans(words, shared.value, k, span)
                of = np.searchsorted(words.first, starts, "right") - 1
                touched = set()
                for d, a, n, who in zip(of.tolist(), starts.tolist(), lengths.tolist(), owners):
                    a -= int(words.first[d])
                    spans[d].append([a, a + n])
                    if not set(who) <= set(names[d]):
                        names[d] = sorted({*names[d], *who})
                    touched.add(d)
                for d in touched:
                    spans[d] = _merge(spans[d])
                new = {"_items": names, "_spans": spans, "_n": words.counts}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], type=f.type) if f.name in new else part.column(f.name).cast(f.type) for f in arrow],
                    schema=arrow)

    return arrow_map(state, run, schema)
