"""Exact interpolated quantiles of groups of any size, also over overlapping windows.

The built-in exact percentile keeps all distinct values of a group in one buffer. That is
right for small groups (the months of a record) and is used there. Raw observations are
unbounded, so values are first counted in cells. The counts say which cell holds a wanted
rank, and only rows of such cells are ordered.

Cells are of equal depth, not of equal width: their cut points come from a mergeable quantile
summary of each key, so an outlier or a crowd of rows in a narrow range does not fill one
cell. Between two cut points lies a cell, and each cut point is a cell of its own, so a value
that a third of all rows repeat is set apart and needs no order. A cell that still holds more
than ``quantile_rows`` rows gets cut points of its own, until none does.

Windows overlap: with +/- 7 days every row belongs to 15 groups. It is the cell counts
that are copied to the 15 groups; of the rows only those in wanted cells are, and these
after equal values of a day were counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import DEFAULT_SCALE
from brinewave.functions import columns as C
from brinewave.operators.sizing import measured, small
from brinewave.session import cut_lineage

#: cut points asked of a summary: one less than a power of two, for the search
CUTS = 255
#: rank error of a summary, as a share of the rows
ACCURACY = 4096
#: wanted cells, each listed for its members, that are sent to the rows
NEED_ROWS = 100_000
#: a cell's place within the cell it was split from takes so many values
_WIDTH = 2 * CUTS + 2
#: rounds of splitting that a 64-bit cell number can tell apart
_ROUNDS = 6


@dataclass(frozen=True)
class Pool:
    """Rows placed in cells, and the cell counts of every (overlapping) group.

    ``rows``: keys, _m (member), _v, _b (cell, rising with the value). ``cells``: keys, _t
    (group), _b, _c, _min, _max. ``levels``: the cut points of the keys, then of the cells
    split in each round. ``spread`` lists the groups of a member and, being symmetric, the
    members of a group.
    """

    keys: tuple
    rows: DataFrame
    cells: DataFrame
    levels: tuple
    spread: Callable[[str], Column]

    def place(self, df: DataFrame, how: str = "inner") -> DataFrame:
        """``df`` (keys, _v) with the cell ``_b`` of each value, in the record or not.

        Other keys are dropped, or have a null cell if ``how`` is left.
        """
        return _placed(df, self.keys, self.levels, how)


def _searched(df: DataFrame) -> DataFrame:
    """``_cuts`` replaced by ``_at``: 2i between the i-th cut point and the next, 2i - 1 on the i-th.

    A column for each step of the search, as lambda functions are not compiled.
    """
    at = F.lit(0)
    for step in (1 << i for i in reversed(range(CUTS.bit_length()))):
        df = df.withColumn("_at", at + F.when(F.get("_cuts", at + (step - 1)) <= F.col("_v"), step).otherwise(0))
        at = F.col("_at")
    on_cut = F.coalesce(F.get("_cuts", at - 1) == F.col("_v"), F.lit(False))
    return df.withColumn("_at", 2 * at - on_cut.cast("int")).drop("_cuts")


def _placed(df: DataFrame, keys: Sequence[str], levels: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    first, *splits = levels
    known = first.withColumn("_known", F.lit(True))
    out = _searched(df.join(known, [*keys], how)).withColumn("_b", F.when(F.col("_known"), F.col("_at").cast("long"))).drop("_at", "_known")
    for cuts in splits:
        out = _searched(out.join(cuts, [*keys, "_b"], "left"))
        out = out.withColumn("_b", F.col("_b") * _WIDTH + F.col("_at")).drop("_at")
    return out


def _cut_points(df: DataFrame, by: Sequence[str], wanted: Column) -> DataFrame:
    """(by, _cuts): about ``wanted`` distinct cut points of equal depth, which may use the count ``_n``."""
    share = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    summary = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", share, ACCURACY).alias("_all"))
    every = F.greatest(F.lit(1), F.floor((CUTS + 1) / wanted)).cast("int")
    thinned = summary.withColumn("_every", every)
    return thinned.select(*by, F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % F.col("_every") == 0)).alias("_cuts"))


def build_pool(df: DataFrame, keys: Sequence[str], value: str, member: Column | None = None,
               members: int = 1, spread: Callable[[str], Column] | None = None,
               ranks: int = 2, most: int = DEFAULT_SCALE.quantile_rows) -> Pool:
    """Place rows in cells. ``ranks`` is how many order statistics will be asked for.

    The number of cells per key balances copied counts against fetched rows; it follows
    the key's own size. No cell of more than one value keeps more than ``most`` rows.
    """
    keys = list(keys)
    spread = spread or (lambda c: F.array(F.col(c)))
    base = df.select(*keys, (F.lit(0) if member is None else member).alias("_m"),
                     C.clean(value).alias("_v")).where(F.col("_v").isNotNull())
    wanted = F.least(F.lit(CUTS + 1), F.greatest(F.lit(8), F.ceil(F.sqrt(F.col("_n") * (ranks / members)))))
    levels = [small(_cut_points(base, keys, wanted))]
    while True:
        rows = _placed(base, keys, levels).select(*keys, "_m", "_b", "_v")
        total = Observation()
        counted = cut_lineage(rows.groupBy(*keys, "_m", "_b").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")).observe(total, F.sum("_c").alias("n")))
        if (total.get["n"] or 0) <= most:  # all rows together are no heavy cell
            break
        heavy = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max")).where(
            (F.col("_c") > most) & (F.col("_min") < F.col("_max"))).select(*keys, "_b")
        if len(levels) > _ROUNDS or heavy.isEmpty():
            break
        inside = rows.join(small(heavy), [*keys, "_b"], "left_semi")
        levels.append(small(_cut_points(inside, [*keys, "_b"], F.lit(CUTS + 1))))
    pooled = counted.withColumn("_t", F.explode(spread("_m"))).groupBy(*keys, "_t", "_b").agg(
        F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    return Pool(tuple(keys), rows, pooled, tuple(levels), spread)


def held_in(pool: Pool, wanted: DataFrame, rows: int) -> DataFrame:
    """(keys, _t, _b, _v, _c): values of the ``rows`` wanted cells (keys, _t, _b), copies counted within a member.

    The wanted cells are few; where their number allows it they go to the rows, which are
    shuffled only as counts of distinct values.
    """
    need = wanted.select(*pool.keys, "_t", "_b").distinct().withColumn("_m", F.explode(pool.spread("_t")))
    there = need.select(*pool.keys, "_m", "_b").distinct()
    if rows <= NEED_ROWS:
        need, there = F.broadcast(need), F.broadcast(there)
    held = pool.rows.join(there, [*pool.keys, "_m", "_b"], "left_semi").groupBy(*pool.keys, "_m", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return held.join(need, [*pool.keys, "_m", "_b"]).select(*pool.keys, "_t", "_b", "_v", "_c")


def fetch(pool: Pool, wanted: DataFrame, rows: int) -> DataFrame:
    """(keys, _t, _b, _v, _c): values of the ``rows`` wanted cells (keys, _t, _b), copies counted."""
    return held_in(pool, wanted, rows).groupBy(*pool.keys, "_t", "_b", "_v").agg(F.sum("_c").alias("_c"))


def _asked(probabilities) -> Column:
    """The ranks around each probability, some of them twice."""
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in probabilities]
    return F.array(*[side(a).cast("long") for a in at for side in (F.floor, F.ceil)])


def _pick(found: DataFrame, wanted: DataFrame, keys, probabilities, partition) -> DataFrame:
    """Interpolated quantiles from values and their counts.

    ``wanted`` has (partition, _start, _total, _rank): the values of a partition follow
    ``_start`` others of their group.
    """
    upto = W.partitionBy(*partition).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = found.withColumn("_to", F.sum("_c").over(upto)).join(wanted, list(partition)).where(
        (F.col("_rank") >= F.col("_start") + F.col("_to") - F.col("_c")) & (F.col("_rank") < F.col("_start") + F.col("_to")))
    # two order statistics per probability and group
    held = ranked.groupBy(*keys, "_t").agg(
        F.first("_total").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    out = []
    for p in probabilities:
        at = (F.col("_total") - 1) * F.lit(float(p))
        below = F.element_at("_at", F.floor(at).cast("long"))
        above = F.element_at("_at", F.ceil(at).cast("long"))
        out.append(below + (above - below) * (at - F.floor(at)))
    return held.select(*keys, "_t", F.col("_total").alias("n"), F.array(*out).alias("q"))


def pool_quantiles(pool: Pool, probabilities: Sequence[float]) -> DataFrame:
    """(keys, _t, n, q): ``q`` holds the quantiles of each group."""
    keys = list(pool.keys)
    group = W.partitionBy(*keys, "_t")
    placed = (
        pool.cells.select(*keys, "_t", "_b", "_c")
        .withColumn("_end", F.sum("_c").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_c").over(group))
    )
    wanted = placed.withColumn("_rank", F.explode(_asked(probabilities))).where(
        (F.col("_rank") >= F.col("_end") - F.col("_c")) & (F.col("_rank") < F.col("_end"))).select(
        *keys, "_t", "_b", (F.col("_end") - F.col("_c")).alias("_start"), "_total", "_rank").distinct()
    wanted, n = measured(wanted)
    return _pick(fetch(pool, wanted, n), F.broadcast(wanted) if n <= NEED_ROWS else wanted, keys, probabilities, [*keys, "_t", "_b"])


def pool_deviation(pool: Pool, centre: DataFrame) -> DataFrame:
    """(keys, _t, spread): median of |v - centre| per group; ``centre`` has (keys, _t, centre).

    The smallest and largest value of a cell bound its deviations. The bounds enclose the
    median; cells wholly below are counted, cells wholly above ignored, the rest fetched.
    """
    keys = list(pool.keys)
    low = F.greatest(F.lit(0.0), F.col("_min") - F.col("centre"), F.col("centre") - F.col("_max"))
    high = F.greatest(F.abs(F.col("_min") - F.col("centre")), F.abs(F.col("_max") - F.col("centre")))
    group = W.partitionBy(*keys, "_t")
    middle = (F.col("_total") - 1) * F.lit(0.5)
    bounded = (
        pool.cells.join(centre, [*keys, "_t"]).withColumn("_low", low).withColumn("_high", high)
        .withColumn("_total", F.sum("_c").over(group))
        .withColumn("_sure", F.sum("_c").over(group.orderBy("_high").rangeBetween(W.unboundedPreceding, 0)))
        .withColumn("_atleast", F.sum("_c").over(group.orderBy(F.desc("_low")).rangeBetween(W.unboundedPreceding, 0)))
    )
    upper = F.min(F.when(F.col("_sure") >= F.ceil(middle) + 1, F.col("_high"))).over(group)
    lower = F.max(F.when(F.col("_atleast") >= F.col("_total") - F.floor(middle), F.col("_low"))).over(group)
    bounded = bounded.withColumn("_u", upper).withColumn("_l", lower)
    bounded = bounded.withColumn("_start", F.sum(F.when(F.col("_high") < F.col("_l"), F.col("_c")).otherwise(0)).over(group))
    wanted, n = measured(bounded.where((F.col("_high") >= F.col("_l")) & (F.col("_low") <= F.col("_u"))).select(
        *keys, "_t", "_b", "_start", "_total", "centre"))
    found = fetch(pool, wanted, n).join(centre, [*keys, "_t"])
    deviations = found.withColumn("_v", F.abs(F.col("_v") - F.col("centre"))).groupBy(*keys, "_t", "_v").agg(F.sum("_c").alias("_c"))
    ranks = wanted.select(*keys, "_t", "_start", "_total").distinct().withColumn("_rank", F.explode(_asked([0.5]))).distinct()
    return _pick(deviations, ranks, keys, [0.5], [*keys, "_t"]).select(
        *keys, "_t", F.element_at("q", 1).alias("spread"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: Sequence[float]) -> DataFrame:
    """(keys, n, q) for plain groups."""
    pool = build_pool(df, keys, value, ranks=2 * len(probabilities))
    return pool_quantiles(pool, probabilities).drop("_t")
