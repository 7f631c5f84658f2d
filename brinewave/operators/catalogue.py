"""Deployment catalogue: selection, mission collapse, snapshot diff, ledger, track facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import STUDY_BOX, Box, Recency
from brinewave.functions import columns as C
from brinewave.operators import chunked


def find_deployments(catalogue: DataFrame, hits: DataFrame, mode: str, institution: str,
                     id_col: str = "dataset_id") -> DataFrame:
    """Catalogue restricted to search hits of exactly one institution, then by mode.

    The search behind ``hits`` is free text, so the institution is compared again.
    """
    exact = hits.where(F.col("institution") == institution).select(id_col)
    found = catalogue.join(exact, id_col, "left_semi")
    delayed = C.is_delayed(id_col)
    return found.where(delayed if mode == "delayed" else ~delayed).withColumn(
        "glider", C.glider_of(id_col))


def assign_group(catalogue: DataFrame, groups, default=None) -> DataFrame:
    """First matching (folder, field, value) wins; values match exactly after trimming."""
    rule = None
    for folder, name, value in groups:
        hit = F.trim(F.coalesce(F.col(name), F.lit(""))) == value
        rule = F.when(hit, folder) if rule is None else rule.when(hit, folder)
    return catalogue.withColumn("group", rule.otherwise(F.lit(default).cast("string")))


def collapse_missions(catalogue: DataFrame) -> DataFrame:
    """One directory per (glider, start): the latest end (any end beats none), the first name on equal ends.

    A null start is a start of its own, as for any other value. Rows are compared by a
    combinable maximum, so a mission with many directories is never gathered.
    """
    lowest = catalogue.groupBy("glider", "start", "end").agg(F.min("name").alias("name"))
    winner = lowest.groupBy("glider", "start").agg(F.max_by("name", F.struct(F.col("end").isNotNull().alias("known"), "end")).alias("name"))
    return catalogue.join(winner.select("name"), "name", "left_semi")


def superseded(catalogue: DataFrame, parts: int | None = None) -> DataFrame:
    """Directories that lost, in name order, with the name that replaced each.

    Read in name order a later end replaces the incumbent: a replaced one names its
    replacement, a newcomer that does not beat the incumbent names the incumbent.

    A scan over range parts of (glider, start, name): inside a part windows, between parts a
    row per part and mission that carries the latest end so far, the last incumbent before
    the part and the first winner after it. A mission of any size is many tasks. Null gliders
    or starts are values of their own; of rows with equal names the earlier end comes first.
    """
    mission = ["glider", "start"]
    cut = chunked.range_parts(catalogue, [*mission, "name"], parts)
    local = W.partitionBy(chunked.PART, *mission)
    before = local.orderBy("name", "end").rowsBetween(W.unboundedPreceding, -1)
    # read backwards: a frame to the end of the part would be walked anew for each row
    after = local.orderBy(F.desc("name"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*mission).orderBy(chunked.PART).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*mission).orderBy(F.desc(chunked.PART)).rowsBetween(W.unboundedPreceding, -1)
    keys = [chunked.PART, *mission]

    ends = cut.groupBy(*keys).agg(F.max("end").alias("_end")).withColumn("_carried", F.max("_end").over(earlier)).drop("_end")
    marked = chunked.join_null_safe(cut, ends, keys)
    best = F.greatest(F.col("_carried"), F.max("end").over(before))
    marked = marked.withColumn("_winner", F.when(best.isNull() | (F.col("end") > best), F.col("name"))).drop("_carried")
    rank = F.struct("name", "end")
    won = F.col("_winner").isNotNull()
    winners = marked.groupBy(*keys).agg(
        F.max_by("_winner", F.when(won, rank)).alias("_last"), F.min_by("_winner", F.when(won, rank)).alias("_first"))
    winners = winners.select(*keys, F.last("_last", ignorenulls=True).over(earlier).alias("_held"),
                             F.last("_first", ignorenulls=True).over(later).alias("_coming"))
    seen = marked.withColumns({"_incumbent": F.last("_winner", ignorenulls=True).over(before),
                               "_next": F.last("_winner", ignorenulls=True).over(after)})
    seen = chunked.join_null_safe(seen, winners, keys)
    by = F.when(won, F.coalesce("_next", "_coming")).otherwise(F.coalesce("_incumbent", "_held"))
    return seen.withColumn("superseded_by", by).where(F.col("superseded_by").isNotNull()).select(
        "name", "glider", "start", "end", F.concat(F.lit("superseded by "), F.col("superseded_by")).alias("skip"))


def available_now(catalogue: DataFrame, vertices: DataFrame, now, days: float = Recency().live_days,
                  box: Box = STUDY_BOX) -> DataFrame:
    """Missions with a recent last fix and any vertex in the box. ``now`` is a parameter."""
    touching = vertices.where(C.in_box("lon", "lat", box)).select("name").distinct()
    return collapse_missions(catalogue).where(C.since("end", now, days)).join(touching, "name", "left_semi")


def describe_tracks(vertices: DataFrame, box: Box = STUDY_BOX, key: str = "name") -> DataFrame:
    """Vertices in total and in the box, rounded bounds of those inside (null when none)."""
    inside = C.in_box("lon", "lat", box)
    out = vertices.groupBy(key).agg(
        F.count(F.lit(1)).alias("profiles_total"), F.count_if(inside).alias("profiles_in_box"),
        *[fn(F.when(inside, F.col(c))).alias(f"{c}_{tag}")
          for c in ("lon", "lat") for fn, tag in ((F.min, "min"), (F.max, "max"))])
    return out.withColumns({c: C.tidy_round(c, 4) for c in ("lon_min", "lon_max", "lat_min", "lat_max")})


def snapshot_diff(previous: DataFrame, current: DataFrame, ledger: DataFrame,
                  key: str = "deployment") -> DataFrame:
    """(key, change): new, returned, advanced or departed since the previous snapshot."""
    was = previous.select(key, F.col("last_fix").alias("_was"), F.lit(True).alias("_had"))
    now = current.select(key, F.col("last_fix").alias("_now"), F.lit(True).alias("_has"))
    known = ledger.select(key, F.lit(True).alias("_known")).distinct()
    change = (
        F.when(F.col("_had").isNull() & F.col("_known").isNull(), "new")
        .when(F.col("_had").isNull(), "returned")
        .when(F.col("_has").isNull(), "departed")
        .when(~F.col("_now").eqNullSafe(F.col("_was")), "advanced")
    )
    return was.join(now, key, "full").join(known, key, "left").select(
        key, change.alias("change")).where(F.col("change").isNotNull())


def merge_ledger(ledger: DataFrame, current: DataFrame, now: str,
                 key: str = "deployment") -> DataFrame:
    """Carry ``first_seen`` forward, take new values, never remove an entry."""
    new = current.select(key, F.col("last_fix").alias("_fix"), F.col("profiles_in_box").alias("_n"),
                         F.lit(True).alias("_new"))
    return ledger.join(new, key, "full").select(
        key, F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(F.col("_new"), F.col("_fix")).otherwise(F.col("last_fix")).alias("last_fix"),
        F.when(F.col("_new"), F.col("_n")).otherwise(F.col("profiles_in_box")).alias("profiles_in_box"))


def resolve_candidates(deployments: DataFrame, files: DataFrame, ranked_suffixes,
                       key: str = "name") -> DataFrame:
    """Best file of each deployment, or null.

    Exact names by rank of their suffix first; else any file with the deployment's own
    prefix that is not a delayed one, in name order. ``files`` has (key, file): the
    directory listing of that deployment.
    """
    exact = F.lit(None).cast("int")
    for rank in range(len(ranked_suffixes) - 1, -1, -1):
        exact = F.when(F.col("file") == F.concat(F.col(key), F.lit(ranked_suffixes[rank])), rank).otherwise(exact)
    loose = F.startswith(F.col("file"), F.col(key)) & ~F.contains(F.col("file"), F.lit("delayed"))
    rank = F.coalesce(exact, F.when(loose, len(ranked_suffixes)))
    best = files.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).groupBy(key).agg(
        F.min(F.struct("_rank", "file")).alias("_b"))
    return deployments.select(key).distinct().join(best, key, "left").select(key, F.col("_b.file").alias("file"))


def match_wanted(deployments: DataFrame, files: DataFrame, suffix: str = "_grid_adjusted",
                 extension: str = ".nc", key: str = "name") -> DataFrame:
    """(key, file, skip): the wanted file if published, else what is published instead.

    Only files with the deployment's own prefix are named; strays of others are ignored.
    A directory listing holds the handful of products of one deployment.
    """
    wanted = F.concat(F.col(key), F.lit(suffix + extension))
    mine = files.where(F.startswith(F.col("file"), F.col(key))).groupBy(key).agg(
        F.max(F.when(F.col("file") == wanted, F.col("file"))).alias("file"),
        F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("_mine"))
    return deployments.select(key).distinct().join(mine, key, "left").select(key, "file", F.when(
        F.col("file").isNull(), F.concat(F.lit(f"no {suffix}{extension} (publishes: "),
                                         F.coalesce("_mine", F.lit("nothing")), F.lit(")"))).alias("skip"))


def pair_modes(observations: DataFrame, key: str = "deployment") -> DataFrame:
    """Deployments present in both feeds with their counts and density ratio."""
    delayed = C.is_delayed(key)
    counts = observations.groupBy(C.base_id(key).alias(key)).agg(
        F.count_if(~delayed).alias("realtime"), F.count_if(delayed).alias("delayed"))
    return counts.where((F.col("realtime") > 0) & (F.col("delayed") > 0)).withColumn(
        "ratio", F.bround(F.col("delayed") / F.col("realtime"), 0))


def modal_month(fixes: DataFrame, key: str = "deployment", time: str = "time") -> DataFrame:
    """Month most fixes fall in; on a tie the month met first in time."""
    months = fixes.groupBy(key, F.date_format(time, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_t"))
    return months.groupBy(key).agg(
        F.max_by("month", F.struct(F.col("_n"), -C.micros("_t"))).alias("observed_month"))


def track_statistics(fixes: DataFrame, key: str = "deployment", time: str = "time") -> DataFrame:
    """Count, span and months of each track; notes data older than the name's own stamp."""
    months = fixes.groupBy(key, F.date_format(time, "yyyy-MM").alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    stamp = C.stamp_of(C.base_id(key))
    per = months.groupBy(key).agg(
        F.sum("_n").alias("n_points"), F.min("_a").alias("first_profile"), F.max("_b").alias("last_profile"),
        F.sort_array(F.collect_set("_m")).alias("_months"))
    early = F.filter("_months", lambda m: m < F.date_format(F.col("stamp"), "yyyy-MM"))
    return per.withColumn("stamp", stamp).select(
        key, "n_points", "first_profile", "last_profile", "stamp",
        F.array_join("_months", ",").alias("months"), F.array_join(early, ",").alias("early_months"))


def epoch_days(tracks: DataFrame, key: str = "deployment", stamp: str = "stamp") -> DataFrame:
    """Days since the earliest deployment, and the upper end of that domain."""
    earliest = tracks.agg(F.min(stamp).alias("v")).scalar()
    latest = tracks.agg(F.max(stamp).alias("v")).scalar()
    return tracks.select(
        key, F.datediff(F.col(stamp), earliest).alias("epoch_days"), earliest.alias("epoch_start"),
        F.datediff(latest, earliest).alias("epoch_days_max"))
