"""Ranked lexical search for many items at once, with sums that items share computed once.

The score of a document for an item is a sum over the item's terms, so the items of a block
are a set of sums over the same addends. ``share_sums`` mines what they have in common:

* terms that the same items hold become one *class*, summed once;
* then, round by round, the pairs of classes or sums that most items hold together become a
  new sum, and stand in these items for their two parts. Each round takes the best pairs that
  do not touch each other, until no pair is in two items.

The result is a graph of additions. For a run of documents the contributions of the terms are
laid out as one matrix, and the graph is walked level by level with whole rows: each shared
sum is an accumulator over these documents, made once and read by all items (and sums) above
it. All numbers are 64-bit integers, so the order of the additions does not matter.

The items are the stated query set. They are taken in blocks of about ``block_terms`` terms,
one block at a time on the driver. For a block the texts are read once; the terms of the block
found in each document are stored with their counts, which give the document frequencies and
then the scores. Every task keeps the best ``top`` of each item only; a window that ranks them
in part before its shuffle merges these. Documents are never shuffled.

Terms are runs of digits, letters and everything beyond ASCII, A-Z lower-cased. Null and
empty texts have none and are found by nothing. Items of equal id (null among them) are one
item with the terms of all its rows; items without terms give no rows. Repeated documents
each get a row. Equal scores go by ascending key, null keys last. Keys are integers. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.llm.common import arrow_map, drop_stored, stored, text_slices
from brinewave.llm.words import LETTERS, Words, cut

#: terms of a block, over its items
BLOCK_TERMS = 100_000
#: bytes of the matrix of contributions and sums
MATRIX_BYTES = 1 << 25
#: neighbouring members of an item that are tried as pairs in a round
NEAR = 48


def term_array(words: Words) -> pa.Array:
    """The words as an Arrow array of their bytes."""
    inside = LETTERS[words.data]
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[inside])])


# -- sums --------------------------------------------------------------------------------


@dataclass
class Sums:
    """A graph of additions. Row c < len(starts) sums the terms ``order[starts[c]:...]``; each
    (rows, left, right) of ``levels`` adds rows of earlier ones; item i sums the rows
    ``members[item_starts[i]:...]``."""

    order: np.ndarray
    starts: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rows: int
    members: np.ndarray
    item_starts: np.ndarray

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Item rows from term rows; the columns are documents."""
        sums = np.empty((self.rows, terms.shape[1]), np.int64)
        sums[:len(self.starts)] = np.add.reduceat(terms[self.order], self.starts, axis=0)
        for rows, left, right in self.levels:
            sums[rows] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.members], self.item_starts, axis=0)

    @property
    def additions(self) -> int:
        """Of document rows, for one walk."""
        return len(self.order) - len(self.starts) + sum(len(x) for x, _, _ in self.levels) + len(self.members) - len(self.item_starts)


def share_sums(items: list[list[int]], n_terms: int) -> Sums:
    """The graph for items given as their distinct terms; none may be empty, and every term is in some item."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    classes: dict[tuple[int, ...], list[int]] = {}
    for t, own in enumerate(holders):
        classes.setdefault(tuple(own), []).append(t)
    order = np.array([t for terms in classes.values() for t in terms], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in classes.values()])])[:-1].astype(np.int64)
    items_of = [set(own) for own in classes]
    level = [0] * len(items_of)
    held: list[set[int]] = [set() for _ in items]
    for c, own in enumerate(items_of):
        for i in own:
            held[i].add(c)
    added: list[tuple[int, int, int, int]] = []
    while True:
        codes = []
        for own in held:
            shared = np.array(sorted((c for c in own if len(items_of[c]) > 1), key=lambda c: (-len(items_of[c]), c)), np.int64)
            for step in range(1, min(NEAR, len(shared))):
                a, b = shared[:-step], shared[step:]
                codes.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        pairs, together = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True)
        good = np.flatnonzero(together > 1)
        if not len(good):
            break
        used: set[int] = set()
        for at in good[np.lexsort((pairs[good], -together[good]))].tolist():
            a, b = int(pairs[at] >> 32), int(pairs[at] & 0xFFFFFFFF)
            if a in used or b in used:
                continue
            used |= {a, b}
            both = items_of[a] & items_of[b]
            new = len(items_of)
            items_of.append(both)
            items_of[a] = items_of[a] - both
            items_of[b] = items_of[b] - both
            level.append(1 + max(level[a], level[b]))
            added.append((level[new], new, a, b))
            for i in both:
                held[i] -= {a, b}
                held[i].add(new)
    levels = []
    for depth in sorted({x[0] for x in added}):
        levels.append(tuple(np.array(x, np.int64) for x in zip(*[x[1:] for x in added if x[0] == depth])))
    members = np.array([c for own in held for c in sorted(own)], np.int64)
    item_starts = np.concatenate([[0], np.cumsum([len(own) for own in held])])[:-1].astype(np.int64)
    return Sums(order, starts, levels, len(items_of), members, item_starts)


# -- scores ------------------------------------------------------------------------------


def term_weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


def lengths_scaled(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """100 - 50 + (50 * n * N) div L of each document length n."""
    if not len(n) or int(n.max()) * 50 * n_documents < 1 << 63:
        return 50 + 50 * n * n_documents // max(n_terms, 1)
    return np.array([50 + 50 * int(x) * n_documents // n_terms for x in n], np.int64)


@dataclass
class Block:
    """Items of a block: their numbers, terms, sums and the weights of the terms."""

    items: list[int]
    terms: list[bytes]
    sums: Sums = field(repr=False)
    weights: np.ndarray | None = None
    n_documents: int = 0
    n_terms: int = 0


class Best:
    """The best ``top`` documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.kept = [np.empty(0, np.int64) for _ in range(4)]  # item, score, key is null, key
        self.new: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.new.append([item, scores[item, at], missing[at], keys[at]])
        self.held += len(item)
        if self.held > 4 * self.top * len(self.least) + 10_000:
            self.prune()

    def prune(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(self.kept, *self.new)]
        order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
        item = columns[0][order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        self.kept = [c[order[place < self.top]] for c in columns]
        last = place == self.top - 1
        self.least[item[last]] = columns[1][order[last]]
        self.new, self.held = [], 0
        return self.kept


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms): the distinct terms of each item."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    schema = f"item {rows.schema['item'].dataType.simpleString()}, terms array<binary>"

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                words = cut(texts, LETTERS, hashed=False)
                every = term_array(words).to_pylist()
                own = [sorted(set(every[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(own, pa.list_(pa.binary()))], names=["item", "terms"])

    found = arrow_map(rows, run, schema)
    # a set, so that the rows of a much repeated item meet as their distinct terms only
    return found.select("item", F.explode("terms").alias("term")).groupBy("item").agg(F.collect_set("term").alias("terms"))


def _blocks(terms: DataFrame, block_terms: int) -> Iterator[tuple[list, Block]]:
    """The items' ids and the block, one block of about ``block_terms`` terms at a time."""
    def made(part: list) -> tuple[list, Block]:
        vocabulary = sorted({bytes(t) for _, own in part for t in own})
        number = {t: i for i, t in enumerate(vocabulary)}
        sums = share_sums([[number[bytes(t)] for t in own] for _, own in part], len(vocabulary))
        return [x for x, _ in part], Block(list(range(len(part))), vocabulary, sums)

    part, held = [], 0
    for row in terms.toLocalIterator():
        if part and held + len(row["terms"]) > block_terms:
            yield made(part)
            part, held = [], 0
        part.append((row["item"], row["terms"]))
        held += len(row["terms"])
    if part:
        yield made(part)


def _postings(docs: DataFrame, key: str, text: str, shared) -> DataFrame:
    """(key, n, terms, counts) of each document with a term: n of all its terms, the others of the block's."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text <> ''")

    def run(batches):
        import pyarrow.compute as pc

        known = pa.array(shared.value.terms, pa.binary())
        for batch in batches:
            for first, texts in text_slices(batch):
                words = cut(texts, LETTERS, hashed=False)
                coded = term_array(words).dictionary_encode()
                of_code = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = of_code[coded.indices.to_numpy(zero_copy_only=False)] if len(words.starts) else np.empty(0, np.int64)
                hit = term >= 0
                cells, tf = np.unique(words.text_of()[hit] * len(known) + term[hit], return_counts=True)
                of, term = np.divmod(cells, max(len(known), 1))
                filled = np.flatnonzero(words.counts)
                offsets = np.searchsorted(of, np.concatenate([filled, [len(texts)]])).astype(np.int32)
                held = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)).take(pa.array(filled)), pa.array(words.counts[filled]), *held],
                                                 names=["key", "n", "terms", "counts"])

    return arrow_map(rows, run, "key bigint, n bigint, terms array<int>, counts array<int>")


def _frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the block."""
    def run(batches):
        found = np.zeros(terms, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    got = arrow_map(postings.select("terms"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _best(postings: DataFrame, shared, top: int) -> DataFrame:
    """(item number, key, score): the best of each item in each task."""
    def run(batches):
        block = shared.value
        best = Best(len(block.items), top)
        wide = max(1, MATRIX_BYTES // (8 * (2 * len(block.terms) + block.sums.rows + len(block.sums.members))))
        for batch in batches:
            for first in range(0, len(batch), wide):
                part = batch.slice(first, wide)
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                sizes = part.column("terms").value_lengths().to_numpy()
                m = lengths_scaled(part.column("n").to_numpy(), block.n_documents, block.n_terms)
                at = np.repeat(np.arange(len(part)), sizes)
                matrix = np.zeros((len(block.terms), len(part)), np.int64)
                matrix[term, at] = block.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
                keys = part.column("key")
                best.add(block.sums.scores(matrix), keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64), keys.fill_null(0).to_numpy(zero_copy_only=False))
        item, score, missing, keys = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(keys, pa.int64(), mask=missing > 0), pa.array(score)], names=["item", "key", "score"])

    return arrow_map(postings, run, "item int, key bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           top: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    terms = stored(_item_terms(items, item, item_text), "item-terms")
    kind = terms.schema["item"].dataType
    out = spark.createDataFrame([], f"{item} {kind.simpleString()}, rank int, {key} bigint, score bigint")
    for names, block in _blocks(terms, block_terms):
        postings = stored(_postings(docs, key, text, spark.sparkContext.broadcast(block)), "postings")
        block.n_documents, block.n_terms = (int(x or 0) for x in postings.agg(F.count("*"), F.sum("n")).first())
        block.weights = np.array([term_weight(block.n_documents, int(df)) for df in _frequencies(postings, len(block.terms))], np.int64)
        found = _best(postings, spark.sparkContext.broadcast(block), top)
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
        ranked = stored(found.withColumn("rank", rank).where(F.col("rank") <= top), "ranked")
        drop_stored(postings)
        numbers = spark.createDataFrame(list(enumerate(names)), f"item int, name {kind.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(numbers), "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score"))
    return out
