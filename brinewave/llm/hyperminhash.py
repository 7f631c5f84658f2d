"""Near-duplicate documents by HyperMinHash sketches, banded, estimated and confirmed.

A document is the set of its shingles of ``shingle`` words (a shorter one its whole sequence):
two by the contract of op6, five in the pipeline. Links are pairs of sets with ``100 * |A & B| >= percent * |A | B|``; documents fall into components.

* **Sketch.** Each shingle is hashed once per repeat; the leading bits choose a bucket, and
  a bucket keeps of its smallest hash the number of leading zeros (6 bits) and 10 bits of
  mantissa. 256 registers in all: one hash into 256 buckets for large sets, more repeats
  of fewer buckets for small ones, so that buckets are seldom empty. A document is sketched
  on the level of its own size and, if another, on that of the smallest size it can be
  linked to, so any linked pair meets on the level of its smaller set.
* **Bands.** 51 bands of 5 registers. A pair at 0.8 misses all of them with probability
  (1 - 0.8^5)^51, below 2e-9.
* **Copies first.** Documents of equal sets are one class; only its smallest id goes on.
* **Few pairs within a bucket.** Each member of a bucket is first tried with the bucket's
  smallest member only, beginning with the one it shares most bands with. Then, in buckets
  whose members are still in several components, every member outside the largest of these
  is tried with all members of other components whose sizes, low register bits and bitmaps allow
  a link, all compared in the join. A bitmap has a bit for each of 2,048 ranges of shingle
  hashes; bits that the other set lacks bound the intersection from above, so that no linked
  pair fails, and few pairs below the threshold are left of sets of some hundred shingles. (Of
  sets of thousands it says little, and the registers decide.) Pairs already in one component
  need no test, and no link between components is lost. The comparisons of bits within the join
  are still as many as the members outside a large component times its size.
* **Tests.** A pair goes on if its collision-corrected estimate is not more than six
  standard deviations below the threshold; the full sets, made from the whole texts, decide.

Hot buckets are only aggregated with map-side combining or joined, which adaptive execution
splits. Intermediate tables are in the shared folder. Nothing is collected.

Null, empty and blank texts have an empty set and are their own component. Repeated rows
are equal sets. Rows that share a key but not their text are documents of their own, linked by
their own sets; each is kept if its key is its component's. A row with a null key is linked with
nothing and has a null component. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import arrow_map, map_texts, stored
from brinewave.llm.words import NOT_BLANK, Words, cut, grams, mix
from brinewave.operators.components import connected_components

REGISTERS, BAND, BANDS = 256, 5, 51
#: (least set size, buckets, repeats)
LEVELS = ((0, 1, 256), (32, 16, 16), (256, 64, 4), (1024, 256, 1))
EMPTY = 0xFFFF
MANTISSA = 10
_U = np.uint64


def level_of(n: int) -> int:
    return max(i for i, (least, _, _) in enumerate(LEVELS) if n >= least)


def shingle_sets(words: Words, shingle: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``shingle`` words of each text."""
    h = words.hashes
    if shingle == 2:
        runs = mix((h[:-1] * _U(0x9FB21C651E98DF25)) ^ (h[:-1] >> _U(31)) ^ (h[1:] * _U(0xD6E8FEB86659FD93))) if len(h) > 1 else h[:0]
    else:
        runs = grams(h, shingle)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            own = np.sort(runs[a:b - shingle + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        else:  # its whole sequence; nothing of an empty text
            out.append(mix((grams(h[a:b], b - a) if b - a > 1 else h[a:b]) ^ _U(0xA5A5A5A5A5A5A5A5)))
    return out


def sketches(sets: list[np.ndarray], level: int) -> np.ndarray:
    """Registers of each set: leading zeros and mantissa of the smallest hash per bucket."""
    _, buckets, repeats = LEVELS[level]
    bits = buckets.bit_length() - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, _U)
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    seeds = np.arange(1, repeats + 1, dtype=_U) * _U(0x632BE59BD9B4E019)
    if buckets == 1:  # one bucket holds a whole set: plain minima, many repeats at once
        at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        for r in range(0, repeats, 32):
            low = np.minimum.reduceat(mix(items[None, :] + seeds[r:r + 32, None]), at, axis=1)
            out[:, r:r + 32] = _registers(low).T
        return out
    for r in range(repeats):
        h = mix(items + seeds[r])
        slot = owner * buckets + (h >> _U(64 - bits)).astype(np.int64)
        low = np.full(len(sets) * buckets, np.iinfo(_U).max, _U)
        np.minimum.at(low, slot, h << _U(bits))
        seen = np.zeros(len(low), bool)
        seen[slot] = True
        out[:, r * buckets:(r + 1) * buckets] = np.where(seen, _registers(low), EMPTY).reshape(len(sets), buckets)
    return out


def _registers(low: np.ndarray) -> np.ndarray:
    """Number of leading zeros (at most 62) and the mantissa bits that follow the first one."""
    fraction, exponent = np.frexp((low >> _U(11)).astype(np.float64))
    zeros = np.minimum(np.where(fraction > 0, 53 - exponent, 62), 62)
    mantissa = np.where(fraction > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return (zeros << MANTISSA | mantissa).astype(np.uint16)


def band_keys(registers: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands, and which of them have a filled register."""
    shape = (len(registers), BANDS, BAND)
    bands = registers[:, :BANDS * BAND].reshape(shape)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(level * 1000 + 7), shape[:2])
    for j in range(BAND):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bands[:, :, j].astype(_U))
    return key.view(np.int64), (bands != EMPTY).any(axis=2)


PLANES = 2
_WORDS = REGISTERS // 64
#: agreement columns: the low bits of all registers, plane by plane, in 64-bit words
PLANE_COLUMNS = [f"p{j}" for j in range(PLANES * _WORDS)]


def planes(registers: np.ndarray) -> np.ndarray:
    """The lowest bits of each register: rows of ``PLANE_COLUMNS``."""
    bits = (registers[:, None, :] >> np.arange(PLANES, dtype=np.uint16)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(registers), -1), axis=1).view(np.int64)


def planes_apart(a: str, b: str, percent: int) -> str:
    """SQL: too many registers differ in their low bits for a pair at the threshold, by six standard deviations."""
    words = [" | ".join(f"({a}.p{j + i} ^ {b}.p{j + i})" for i in range(0, PLANES * _WORDS, _WORDS)) for j in range(_WORDS)]
    share = (1 - percent / 100) * (1 - 2.0 ** -PLANES)
    most = REGISTERS * share + 6 * np.sqrt(REGISTERS * share * (1 - share))
    return f"{' + '.join(f'bit_count({w})' for w in words)} > {int(most)}"


MASK_BITS = 2048
MASK_COLUMNS = [f"m{j}" for j in range(MASK_BITS // 64)]


def masks(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap of each set: one bit for the leading bits of each shingle's hash."""
    out = np.zeros((len(sets), MASK_BITS), bool)
    for row, s in zip(out, sets):
        row[(s >> _U(64 - MASK_BITS.bit_length() + 1)).astype(np.int64)] = True
    return [row.tobytes() for row in np.packbits(out, axis=1)]


def masks_allow(a: str, b: str, percent: int) -> str:
    """SQL: the bitmaps leave a pair at the threshold possible.

    A bit of one set that the other lacks is a shingle the other lacks, so that the bitmaps
    bound the intersection from above. No linked pair fails, whatever the hashes.
    """
    def own(x: str, y: str) -> str:
        return " + ".join(f"bit_count({x}.{c} & ~{y}.{c})" for c in MASK_COLUMNS)

    return f"{100 + percent} * least({a}.n - ({own(a, b)}), {b}.n - ({own(b, a)})) >= {percent} * ({a}.n + {b}.n)"


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of sketch rows, and the number of registers it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & used).sum(axis=1)
    buckets = np.array([m for _, m, _ in LEVELS])[level]
    load_a, load_b = n_a / buckets, n_b / buckets
    # expected agreements of unrelated sets, by the published approximation for equal loads
    chance = 0.169919487159739 * 4 * np.sqrt(load_a * load_b) / (1 + np.sqrt(load_a * load_b)) ** 2 * 2.0 ** -MANTISSA * REGISTERS
    n = np.maximum(used.sum(axis=1), 1)
    return np.maximum(equal - chance, 0) / n, n


def _signatures(percent: int, shingle: int):
    def work(texts: list[str]) -> dict[str, list]:
        sets = shingle_sets(cut(texts, NOT_BLANK), shingle)
        n = np.array([len(s) for s in sets])
        held: list[list] = [[] for _ in sets]
        wanted: dict[int, list[int]] = {}
        for d, size in enumerate(n.tolist()):
            if size:
                for level in {level_of(size), level_of(-(-size * percent // 100))}:
                    wanted.setdefault(level, []).append(d)
        for level, members in wanted.items():
            for d, row in zip(members, sketches([sets[d] for d in members], level)):
                held[d].append({"level": level, "registers": row.tobytes()})
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"n_shingles": n, "set_key": keys, "mask": masks(sets), "sketches": held}

    return work


def _bands(reps: DataFrame) -> DataFrame:
    """(band, node, n, level): a row for each filled band of each sketch."""
    def run(batches):
        for batch in batches:
            node, n = batch.column(0), batch.column(1)
            for first in range(0, len(node), 2000):
                part = batch.slice(first, 2000)
                level = part.column(2).to_numpy()
                registers = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for v in np.unique(level):
                    rows = np.flatnonzero(level == v)
                    keys, filled = band_keys(registers[rows], int(v))
                    at = pa.array(np.repeat(rows, filled.sum(axis=1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[filled]), part.column(0).take(at), part.column(1).take(at), pa.array(np.full(len(at), v, np.int32))],
                        names=["band", "node", "n", "level"])

    kind = reps.schema["node"].dataType.simpleString()
    flat = reps.select("node", "n", F.explode("sketches").alias("s")).select("node", "n", "s.level", "s.registers")
    return arrow_map(flat, run, f"band bigint, node {kind}, n bigint, level int")


def _planes(reps: DataFrame) -> DataFrame:
    """(node, level, agreement columns, bitmap columns) of each sketch."""
    names = ["node", "level", *PLANE_COLUMNS, *MASK_COLUMNS]

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 2000):
                part = batch.slice(first, 2000)
                low = planes(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS))
                bits = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64).reshape(len(part), -1)
                columns = [pa.array(c) for c in np.ascontiguousarray(np.concatenate([low, bits], axis=1).T)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    kind = reps.schema["node"].dataType.simpleString()
    flat = reps.select("node", "mask", F.explode("sketches").alias("s")).select("node", "s.level", "s.registers", "mask")
    return arrow_map(flat, run, f"node {kind}, level int, " + ", ".join(f"{c} bigint not null" for c in names[2:]))


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, shingle: int, name: str) -> DataFrame:
    """The linked ones of (a, b): sketch estimate first, then the full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = stored(pairs, f"{name}-pairs")

    def side(x: str) -> DataFrame:
        return reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketches").alias(f"s_{x}"))

    def near(batches):
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                rows, left, right, level = [], [], [], []
                for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    mine = {s["level"]: s["registers"] for s in x}
                    for s in y:
                        if s["level"] in mine:
                            rows.append(i)
                            left.append(mine[s["level"]])
                            right.append(s["registers"])
                            level.append(s["level"])
                if not rows:
                    continue
                a = np.frombuffer(b"".join(left), np.uint16).reshape(-1, REGISTERS)
                b = np.frombuffer(b"".join(right), np.uint16).reshape(-1, REGISTERS)
                got, n = estimate(a, b, part.column(4).to_numpy()[rows], part.column(5).to_numpy()[rows], np.array(level))
                t = percent / 100
                good = np.unique(np.array(rows)[got >= t - 6 * np.sqrt(t * (1 - t) / n)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good))], names=["a", "b"])

    likely = arrow_map(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b", "n_a", "n_b"), near, f"a {kind}, b {kind}")
    likely = stored(likely, f"{name}-likely")

    def linked(batches):
        held: dict = {}

        def shingles(node, text: str) -> np.ndarray:
            if node not in held:
                if len(held) >= 8:
                    held.pop(next(iter(held)))
                held[node] = shingle_sets(cut([text], NOT_BLANK), shingle)[0]
            return held[node]

        for batch in batches:
            keep = []
            for i, (a, b, x, y) in enumerate(zip(*[batch.column(c) for c in range(4)])):
                s, t = shingles(str(a), x.as_py()), shingles(str(b), y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    def text_of(x: str) -> DataFrame:
        return texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    return stored(arrow_map(likely.join(text_of("b"), "b").join(text_of("a"), "a").select("a", "b", "text_a", "text_b"), linked,
                            f"a {kind}, b {kind}"), f"{name}-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 2) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each document; components are named by their smallest key."""
    rows = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    if rows.where("node is not null").groupBy("node").count().where("count > 1").isEmpty():
        found = _linked(rows, percent, shingle)
    else:  # rows that share a key but not their text are documents of their own
        known = F.col("node").isNotNull()
        apart = rows.withColumn("node", F.when(known, F.struct(F.col("node").alias("id"), F.when(known, F.xxhash64("text")).alias("mark"))))
        found = _linked(apart, percent, shingle).select(F.col("node.id").alias("node"), "n_shingles", F.col("component_id.id").alias("component_id"))
    return found.select(F.col("node").alias(key), "n_shingles", "component_id", F.col("node").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(node, n_shingles, component_id) for each row of (node, text), where a node has one text."""
    signed = stored(map_texts(rows, ["node"], "n_shingles bigint, set_key binary, mask binary, sketches array<struct<level:int,registers:binary>>",
                              _signatures(percent, shingle)), "sketches")
    usable = signed.where("node is not null and n_shingles > 0")
    classes = stored(usable.groupBy("set_key").agg(F.min("node").alias("node")), "set-classes")
    reps = stored(
        usable.join(classes.select("node"), "node", "left_semi").groupBy("node").agg(
            F.first("n_shingles").alias("n"), F.first("mask").alias("mask"), F.first("sketches").alias("sketches")), "set-sketches")

    buckets = _bands(reps).groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1")
    shared = stored(_bands(reps).join(buckets.select("band", "head"), "band"), "shared-bands")
    sized = shared.select("node").distinct()
    texts = stored(rows.join(sized, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "shared-texts")

    stars = stored(shared.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("bands")), "stars")
    first = stars.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    links = _confirmed(first, reps, texts, percent, shingle, "first")

    # heads are smaller than members, so these links point upwards: two steps name most components
    up = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    above = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
    named = up.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    rest = _apart(stars.select("a", "b"), named).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(rest, reps, texts, percent, shingle, "stars"))
    parts = _components(links)

    placed = stored(shared.join(parts, "node", "left").select("band", "node", "n", "level", F.coalesce("component", "node").alias("component")), "placed-bands")
    largest = (
        placed.groupBy("band", "component").agg(F.count("*").alias("m")).groupBy("band")
        .agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main"))
    mixed = stored(placed.join(largest, "band"), "mixed-bands")
    with_planes = mixed.join(_planes(reps), ["node", "level"])
    minor = with_planes.where("component <> main").alias("x")
    fits = (f"x.component <> y.component AND (y.component = y.main OR x.node < y.node) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) "
            f"AND NOT ({planes_apart('x', 'y', percent)}) AND {masks_allow('x', 'y', percent)}")
    cross = minor.join(with_planes.alias("y"), F.expr(f"x.band = y.band AND {fits}")).select(
        F.expr("greatest(x.node, y.node)").alias("a"), F.expr("least(x.node, y.node)").alias("b")).distinct()
    cross = cross.join(stars.select("a", "b"), ["a", "b"], "left_anti")
    found = _confirmed(cross.select("a", "b"), reps, texts, percent, shingle, "cross")
    if not found.isEmpty():
        parts = _components(links.unionByName(found))

    named = classes.join(parts, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = usable.select("node", "n_shingles", "set_key").join(named, "set_key").select("node", "n_shingles", "component_id")
    alone = signed.where("node is null or n_shingles = 0").select("node", "n_shingles", F.col("node").alias("component_id"))
    return out.unionByName(alone)


def _components(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return connected_components(nodes, links)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = parts.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
    b = parts.select(F.col("node").alias("b"), F.col("component").alias("c_b"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"))
