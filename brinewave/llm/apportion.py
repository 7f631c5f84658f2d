"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

1. Each document has a size in words. Sources, ordered by code point with null last, have
   weights 1, 2, 3, repeating, and share the total; a target stops at ``cap`` times the
   source's size and the excess is shared again by weight until none is above.
2. Sources are dealt into shards of about ``shard_words`` words by a seeded hash of the
   key, and each shard, in the order of that hash, is cut into blocks of ``block_words``.
3. Blocks are apportioned to sources, then each source's blocks to its shards, by the
   highest quotients votes / (2k - 1): integer quotas that sum to the seats. Votes count
   in blocks of the source, so a capped source gets every block ``cap`` times.
4. A shard of N blocks with quota q takes each block ``q div N`` times and ``q mod N`` of
   them once more, evenly spaced from a seeded start. A document's words taken follow from
   its range in the shard by arithmetic; blocks are never listed.

A hot source only has more shards. Only sums per source and shard meet in one place, and
the driver sees a few scalars. Results depend on the rows alone, not on their order.

Null or empty texts have size 0 and nothing is taken of them. Repeated rows are separate
documents. A null key is hashed like any value. Empty tables give no rows. If all sizes
are 0, targets are 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.llm.common import BLANK_WORD, stored

BLOCK_WORDS = 64
SHARD_WORDS = 250_000
#: a table of sums with at most this many rows is broadcast
SUMS_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sums.withColumn("source_no", F.row_number().over(order) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = stored(numbered.withColumn("weight", turn), "mix-sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * cap
    share, closed = 0.0, F.lit(False)
    while total:
        facts = sources.agg(F.sum(F.when(closed, limit).otherwise(0.0)).alias("given"), F.sum(F.when(closed, 0.0).otherwise(F.col("weight"))).alias("open"),
                            F.sum(closed.cast("int")).alias("n")).first()
        if not facts["open"]:
            break
        share = (total - facts["given"]) / facts["open"]
        after = closed | (F.col("weight") * share > limit)
        if sources.where(after).count() == facts["n"]:
            break
        closed = F.col("weight") * share > limit  # shares only rise, so what is closed stays closed
    return sources.select("source", "source_no", "source_size", F.when(closed, limit).otherwise(F.col("weight") * share).alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], order: list[str], votes: str = "votes", seats: str = "seats") -> DataFrame:
    """Adds ``quota``: the party's number of the ``seats`` highest votes / (2k - 1) in its group.

    Equal quotients go by ``order``. Two divisors, one surely too large and one surely too
    small, bracket each quota, so only about two quotients for each party are ranked.
    """
    own = Window.partitionBy(*group)
    known = parties.withColumns({
        "_v": F.sum(votes).over(own), "_n": F.sum((F.col(votes) > 0).cast("int")).over(own)})
    few, many = F.col(seats) - F.col("_n") / 2 - 1, F.col(seats) + F.col("_n") / 2 + 1
    ideal = F.col(votes) / F.col("_v")
    live = (F.col("_v") > 0) & (F.col(votes) > 0) & (F.col(seats) > 0)
    bounded = known.withColumns({
        "_lo": F.when(live & (few > 0), F.floor(ideal * few + 0.5)).otherwise(F.lit(0)),
        "_hi": F.when(live, F.floor(ideal * many + 0.5)).otherwise(F.lit(0))})
    bounded = bounded.withColumn("_open", F.col(seats) - F.sum("_lo").over(own))
    ranked = (
        bounded.where("_hi > _lo").select(*group, *[c for c in order if c not in group], F.col(votes).alias("_votes"), "_open",
                                          F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
        .withColumn("_rank", F.row_number().over(own.orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") - 1)), *order)))
        .where("_rank <= _open"))
    keys = list(dict.fromkeys([*group, *order]))
    won = ranked.groupBy(*keys).agg(F.count("*").alias("_won"))
    return bounded.join(won, keys, "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop(
        "_v", "_n", "_lo", "_hi", "_open", "_won")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of sums if its row count allows it; else the join shuffles."""
    return F.broadcast(df) if df.count() <= SUMS_ROWS else df


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
                cap: float = 3.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """(key, source, size, source_size, target, shard, blocks, quota, taken) for each document."""
    sizes = stored(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(BLANK_WORD)), F.lit(0)).cast("bigint").alias("size")), "mix-sizes")
    sources = stored(targets(sizes, weights, cap), "mix-targets")
    known = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    placed = sizes.alias("d").join(_small(known).alias("s"), F.expr("d.source <=> s.source")).select(
        "key", "d.source", "size", "source_no", "source_size", "target", F.xxhash64(F.lit(seed), "key").alias("mark"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("shards")).alias("shard"))

    shards = stored(
        placed.groupBy("source_no", "shard").agg(F.sum("size").alias("words"))
        .withColumn("blocks", F.ceil(F.col("words") / block_words)), "mix-shards")
    votes = (
        shards.groupBy("source_no").agg(F.sum("blocks").alias("all_blocks"))
        .join(sources.select("source_no", "source_size", "target"), "source_no")
        .withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("all_blocks")).otherwise(0.0))
        .withColumn("all", F.lit(0)))
    votes = stored(votes.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("all")))), "mix-votes")
    by_source = highest_quotients(votes, ["all"], ["source_no"]).select("source_no", F.col("quota").alias("seats"))
    quotas = stored(
        highest_quotients(shards.join(by_source, "source_no").withColumn("votes", F.col("blocks").cast("double")), ["source_no"], ["shard"])
        .select("source_no", "shard", "blocks", F.least("quota", (F.col("blocks") * cap).cast("bigint")).alias("quota")), "mix-quotas")

    ordered = Window.partitionBy("source_no", "shard").orderBy("mark", "key", "size")
    spread = (
        placed.join(quotas, ["source_no", "shard"])
        .withColumn("stop", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.greatest("blocks", F.lit(1)))
        .withColumns({"whole": F.expr("quota div n"), "extra": F.expr("quota % n"),
                      "turn": F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "shard"), F.col("n"))}))

    def before(at: str):
        """Words in blocks taken once more, up to word ``at`` of the shard."""
        chosen = f"(({{j}}) * extra + turn) div n"
        j = f"(({at}) div {block_words})"
        return F.expr(f"{block_words} * ({chosen.format(j=j)}) + (({at}) % {block_words}) * (({chosen.format(j=j + ' + 1')}) - ({chosen.format(j=j)}))")

    return spread.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "shard", "blocks", "quota",
        (F.col("whole") * F.col("size") + before("stop") - before("stop - size")).cast("bigint").alias("taken"))
