"""Phrase collocations by direct-address tiling of ranked ids.

Texts, A-Z lower-cased, are split at ``. , ; : ! ?`` and line ends into pieces, pieces at
blanks and tabs into words. Everything is counted per language (null: ``und``). A phrase of
up to ``longest`` words found ``least`` times or more is *frequent*; a phrase is frequent
only if all shorter phrases in it are, so the levels are counted one after the other.

* **Ranks.** The ``HEAD_WORDS`` most frequent (language, word) and, on each level, the
  ``HEAD_PHRASES`` most frequent phrases get their place in that order as id. Both are
  bounded by these parameters, words and phrases by ``WORD_BYTES`` a word too, so they are sent to all tasks.
* **Tiles.** A phrase of k + 1 words is a pair (id of its first k words, id of its last):
  on level 2 two word ids, on level 3 the rank a pair got on level 2, and so on. The plane
  of pairs is cut into tiles of 1,024 x 1,024. A task collects pairs; a tile that holds many
  is counted by a dense ``bincount`` of its addresses, the rest is sorted and run-length
  coded. Spark adds the counts of all tasks up.
* **The rest, exactly.** Phrases with a part that has no id are counted by their text. A bit
  set of fixed size, filled with the hashes of all frequent phrases of the level below, first
  leaves out positions that cannot be frequent; a chance hit costs a row and no more.

Scores are exact decimals. Each frequent phrase of two words or more is cut after every word
but the last, and the lowest score counts. The parts of a frequent phrase are frequent, so
their counts come from the same tables, by joins. Candidates inside a longer one that has
``inside`` % of their count are dropped; the best ``top`` of each language remain.

Null and empty texts have no words. Repeated rows count each time. A language or table
without frequent phrases gives no rows. Ties in score go by count, then by the phrase's bytes.
Very long words have no id and are counted by text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.llm.common import arrow_map, stored, text_slices
from brinewave.llm.words import cut, grams, mix, word_hashes

HEAD_WORDS, HEAD_PHRASES = 1 << 18, 1 << 19
WORD_BYTES = 64
#: a tile is 2^TILE_BITS ids wide and high
TILE_BITS = 10
#: pairs a task collects before it counts them, and pairs that make a tile of them dense
BUFFER, DENSE = 1 << 21, 1 << 17
#: dense tiles a task keeps counting in
MOST_TILES = 16
#: entries of a task's dictionaries of texts
MOST_TEXTS = 200_000
#: bits of the set of frequent phrases
FILTER_BITS = 25

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, *range(0x0A, 0x0E), *(ord(c) for c in ".,;:!?")]] = False
_ENDS = np.zeros(256, np.int8)
_ENDS[[*range(0x0A, 0x0E), *(ord(c) for c in ".,;:!?")]] = 1
_MASK = (1 << 32) - 1


@dataclass
class Encoded:
    """The words of a slice of texts, as numbers of its distinct (language, word) pairs.

    ``unit``: number of each word; ``piece``: number of its piece. ``langs`` and ``words``:
    what the numbers stand for, ``hashes``: their hashes.
    """

    unit: np.ndarray
    piece: np.ndarray
    langs: list[str]
    words: list[bytes]
    hashes: np.ndarray
    first: np.ndarray

    def text(self, at: int, size: int) -> bytes:
        return b" ".join(self.words[u] for u in self.unit[at:at + size].tolist())


def encode(texts: list[str], langs: list[str]) -> Encoded:
    cutted = cut(texts, _WORD, hashed=False)
    starts, ends = cutted.starts, cutted.ends
    n = len(starts)
    piece = np.cumsum(_ENDS[cutted.data], dtype=np.int64)[starts] if n else np.empty(0, np.int64)
    values = cutted.data[_WORD[cutted.data]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    lang = np.repeat(np.array([number[x] for x in langs], np.int64), cutted.counts)
    size = len(coded.dictionary)
    pairs, unit = np.unique(lang * max(size, 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    of_lang, of_word = np.divmod(pairs, max(size, 1))
    words = coded.dictionary.to_pylist()
    joined = np.frombuffer(b"".join(words), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in names], np.uint64)
    own = word_hashes(joined, edge[:-1], edge[1:]) if size else np.empty(0, np.uint64)
    hashes = mix(own[of_word] ^ salt[of_lang]) if n else np.empty(0, np.uint64)
    return Encoded(unit, piece, [names[i] for i in of_lang.tolist()], [words[i] for i in of_word.tolist()], hashes, cutted.first)


def phrase_hashes(slice_: Encoded, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    own = slice_.hashes[slice_.unit]
    return own if size == 1 else grams(own, size)


@dataclass
class Tiles:
    """Counts pairs of ids: dense tiles where they crowd, sorted runs elsewhere."""

    buffer: int = BUFFER
    dense_at: int = DENSE
    waiting: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    dense: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.waiting.append(left.astype(np.int64) << 32 | right)
        self.held += len(left)
        if self.held >= self.buffer:
            yield self.count()

    def count(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, count) of the waiting pairs outside dense tiles."""
        codes = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.int64)
        self.waiting, self.held = [], 0
        left, right = codes >> 32, codes & _MASK
        across = int(right.max(initial=0) >> TILE_BITS) + 1
        tile = (left >> TILE_BITS) * across + (right >> TILE_BITS)
        sizes = np.bincount(tile, minlength=1)
        rest = np.ones(len(codes), bool)
        low = (1 << TILE_BITS) - 1
        for t in np.flatnonzero(sizes):
            name = int(t // across) << 32 | int(t % across)
            if name not in self.dense and (sizes[t] < self.dense_at or len(self.dense) >= MOST_TILES):
                continue
            mine = tile == t
            rest &= ~mine
            cells = np.bincount((left[mine] & low) << TILE_BITS | (right[mine] & low), minlength=1 << 2 * TILE_BITS)
            if name in self.dense:
                self.dense[name] += cells
            else:
                self.dense[name] = cells
        codes = np.sort(codes[rest])
        edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
        codes, n = codes[edge], np.diff(np.concatenate([edge, [len(codes)]]))
        return codes >> 32, codes & _MASK, n

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield self.count()
        while self.dense:
            name, cells = self.dense.popitem()
            at = np.flatnonzero(cells)
            yield (name >> 32 << TILE_BITS) + (at >> TILE_BITS), ((name & _MASK) << TILE_BITS) + (at & ((1 << TILE_BITS) - 1)), cells[at]


@dataclass
class Level:
    """What the tasks know of the frequent phrases of one length.

    ``bits``: the hashed set of all of them. ``ids`` (words): language -> word -> id.
    ``codes`` (longer): sorted pairs of those with an id, ``ranks`` their ids.
    """

    bits: np.ndarray
    ids: dict[str, dict[bytes, int]] = field(default_factory=dict, repr=False)
    codes: np.ndarray | None = None
    ranks: np.ndarray | None = None

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - FILTER_BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of pairs of ids; -1 for none."""
        if not len(self.codes):
            return np.full(len(left), -1)
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.codes[at] == code), self.ranks[at], -1)


def positions(slice_: Encoded, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase one word longer than the last level may be frequent, and the ids of its
    first words and of its last word (-1 for none)."""
    size = len(levels)
    n = len(slice_.unit) - size
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    known = levels[-1].holds(phrase_hashes(slice_, size))
    at = np.flatnonzero(known[:n] & known[1:n + 1] & (slice_.piece[:n] == slice_.piece[size:]))
    own = np.array([levels[0].ids.get(x, {}).get(w, -1) for x, w in zip(slice_.langs, slice_.words)], np.int64)[slice_.unit]
    left = own[at]
    for k, level in enumerate(levels[1:], 1):
        left = level.rank(left, own[at + k])
    return at, left, own[at + size]


def _emit(schema: pa.Schema, left=(), right=(), n=(), texts: dict | None = None) -> pa.RecordBatch:
    if texts is not None:
        langs, phrases = zip(*texts) if texts else ((), ())
        parts = [pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int32()), pa.array(langs, pa.string()),
                 pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(list(texts.values()), pa.int64())]
    else:
        parts = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(parts, schema=schema)


_COUNTED = "left int, right int, lang string, phrase string, n bigint"
_ARROW = pa.schema([("left", pa.int32()), ("right", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _counted(rows: DataFrame, shared=None) -> DataFrame:
    """Counts by task: of words, or of phrases one word longer than the shared levels."""
    def run(batches):
        tiles, texts = Tiles(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, some in text_slices(batch, "text"):
                slice_ = encode(some, langs[first:first + len(some)])
                if shared is None:
                    at = ()
                    for key, n in zip(zip(slice_.langs, slice_.words), np.bincount(slice_.unit, minlength=len(slice_.words)).tolist()):
                        texts[key] = texts.get(key, 0) + n
                else:
                    at, left, right = positions(slice_, shared.value)
                    ranked = (left >= 0) & (right >= 0)
                    for part in tiles.add(left[ranked], right[ranked]):
                        yield _emit(_ARROW, *part)
                    size = len(shared.value) + 1
                    for p in at[~ranked].tolist():
                        key = slice_.langs[slice_.unit[p]], slice_.text(p, size)
                        texts[key] = texts.get(key, 0) + 1
                if len(texts) >= MOST_TEXTS:
                    yield _emit(_ARROW, texts=texts)
                    texts = {}
        yield _emit(_ARROW, texts=texts)
        for part in tiles.finish():
            yield _emit(_ARROW, *part)

    return arrow_map(rows, run, _COUNTED)


def _filter_bits(phrases: DataFrame, size: int) -> np.ndarray:
    """The hashes of all phrases as a bit set; at most 2^(FILTER_BITS - 6) numbers reach the driver."""
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, some in text_slices(batch, "phrase"):
                slice_ = encode(some, langs[first:first + len(some)])
                at = phrase_hashes(slice_, size)[slice_.first[:-1]] >> np.uint64(64 - FILTER_BITS)
                slot, place = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
                bits = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    found = arrow_map(phrases.select("lang", "phrase"), run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _short(size: int):
    return F.octet_length("phrase") <= size * WORD_BYTES + size - 1


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10,
                  head_words: int = HEAD_WORDS, head_phrases: int = HEAD_PHRASES) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n): words of each language), and for each length a table (lang, phrase, a) of the frequent phrases."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''")
    words = stored(_counted(rows).groupBy("lang", "phrase").agg(F.sum("n").alias("a")), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.where(F.col("a") >= least)
    head = frequent.where(_short(1)).orderBy(F.desc("a"), "lang", "phrase").limit(head_words).select("lang", "phrase").toArrow()
    ids: dict[str, dict[bytes, int]] = {}
    for i, (name, word) in enumerate(zip(head["lang"].to_pylist(), head["phrase"].cast(pa.binary()).to_pylist())):
        ids.setdefault(name, {})[word] = i
    named = spark.createDataFrame(pa.table({"id": pa.array(range(len(head)), pa.int32()), "lang": head["lang"], "phrase": head["phrase"]}))
    id_words = stored(named, "word-ids")
    levels, tables, lefts = [Level(_filter_bits(frequent, 1), ids)], [frequent], id_words
    for size in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(levels)
        counted = stored(_counted(rows, shared).groupBy("left", "right", "lang", "phrase").agg(F.sum("n").alias("a"))
                         .where(F.col("a") >= least), f"phrase-counts-{size}")
        # both id tables are bounded by parameters
        decoded = counted.where("left is not null").select("left", "right", "a").join(
            F.broadcast(lefts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"))), "left").join(
            F.broadcast(id_words.select(F.col("id").alias("right"), F.col("phrase").alias("end"))), "right").select(
            "left", "right", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "a")
        table = stored(decoded.unionByName(counted.where("left is null")), f"phrases-{size}")
        tables.append(table.select("lang", "phrase", "a"))
        if size < longest:
            best = table.where("left is not null").where(_short(size)).orderBy(F.desc("a"), "left", "right").limit(head_phrases)
            got = best.select("left", "right", "lang", "phrase").toArrow()
            codes = got["left"].to_numpy().astype(np.int64) << 32 | got["right"].to_numpy()
            order = np.argsort(codes)
            levels.append(Level(_filter_bits(tables[-1], size), codes=codes[order], ranks=order))
            lefts = stored(spark.createDataFrame(pa.table({"id": pa.array(range(len(got)), pa.int32()), "lang": got["lang"], "phrase": got["phrase"]})), f"phrase-ids-{size}")
    return totals, tables


#: counts below 10^15: 1,000,000 times the square of one has 36 digits at most
_EXACT = "decimal(15,0)"


def _words(count: int):
    """The first words of the phrase, or with a negative count the last."""
    return F.substring_index("phrase", " ", count)


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): each phrase of two words or more at its lowest-scoring cut."""
    out = []
    for size, table in enumerate(tables[1:], 2):
        cuts = table
        for k in range(1, size):
            left = tables[k - 1].select("lang", F.col("phrase").alias("_begin"), F.col("a").alias(f"l{k}"))
            right = tables[size - k - 1].select("lang", F.col("phrase").alias("_end"), F.col("a").alias(f"r{k}"))
            cuts = cuts.withColumns({"_begin": _words(k), "_end": _words(k - size)}).join(left, ["lang", "_begin"]).join(right, ["lang", "_end"]).drop("_begin", "_end")
        options = F.array(*[F.struct(
            F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as {_EXACT}) * cast(a as {_EXACT})) div (cast(l{k} as {_EXACT}) * cast(r{k} as {_EXACT}))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)])
        lowest = cuts.withColumn("best", F.array_min(options))
        out.append(lowest.select("lang", "phrase", F.lit(size).alias("size"), "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, out)


def _covered(tables: list[DataFrame], inside: int) -> DataFrame:
    """(lang, phrase) of frequent phrases inside a longer one that has ``inside`` % of their count."""
    covers = []
    for size, table in enumerate(tables[1:], 2):
        for k in range(2, size):
            for first in range(size - k + 1):
                part = F.substring_index(F.substring_index("phrase", " ", first + k), " ", -k)
                covers.append(table.select("lang", part.alias("phrase"), "a"))
    if not covers:
        return tables[0].select("lang", "phrase").limit(0)
    longer = reduce(DataFrame.unionByName, covers).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = reduce(DataFrame.unionByName, tables[1:-1])
    return own.join(longer, ["lang", "phrase"]).where(100 * F.col("longer") >= inside * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000,
                 head_words: int = HEAD_WORDS, head_phrases: int = HEAD_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    totals, tables = count_phrases(docs, text, lang, longest, least, head_words, head_phrases)
    kept = scored(tables).join(_covered(tables, inside), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
