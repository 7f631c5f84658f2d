"""URL rules by host-suffix and path-prefix expressions, joined on short hashes.

Every URL is expanded into the expressions that could be a rule: each suffix of its host at
label boundaries, up to the number of labels the rules have, with each prefix of its path
at the lengths the rules have. Expressions meet rules on the first 32 bits of a SHA-256;
the full digest confirms, and the longest rule wins. SQL functions only.

The work is done once per distinct URL, so a host or URL that holds a third of the rows
costs nothing extra; verdicts return to the rows in a join that adaptive execution can
split. Rules are broadcast while their expressions fit ``RULE_BYTES``; beyond that the join shuffles, with the
rules copied to a fixed number of salts so that a common expression is spread.

Null URLs, and URLs without ``://``, have empty host and path and get the default verdict.
Repeated rows each get a row. Empty tables give empty results; without rules every row gets
the default. Rules with a null host or path are ignored. Of equally long rules, block wins,
then a fixed order. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: broadcast rules up to this many bytes
RULE_BYTES = 8 << 20
SALTS = 16


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(_rest(url), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    end = F.length(F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1))
    tail = F.substring(rest, end + 1, F.length(rest))
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with text, digest, short hash and lengths; one row for each text."""
    text = F.concat(F.lower(F.col("host")), F.col("path"))
    return (
        rules.select(F.lower("host").alias("host"), F.col("path"), F.col("verdict"), text.alias("rule"))
        .where("rule is not null and verdict is not null and host <> ''")
        .groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict", "rule")).alias("b"))
        .select("path", F.col("b.verdict").alias("verdict"), F.col("b.rule").alias("rule"),
                F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"),
                F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("path_length"))
        .withColumn("short", F.substring("digest", 1, 8)))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
               rule_bytes: int = RULE_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``; ``rules`` has host, path and verdict."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    known = prepared_rules(rules).select("rule", "verdict", "digest", "short", "labels", "path_length")
    facts = known.agg(F.count("*").alias("n"), F.max("labels").alias("labels"),
                      F.sum(F.length("rule") + 120).alias("bytes"),
                      F.array_sort(F.collect_set("path_length")).alias("lengths")).first()
    if not facts["n"]:
        return rows.select(F.col("key").alias(key), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    distinct = rows.where("url is not null").groupBy("url").agg(F.lit(1).alias("one")).select(
        "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, facts["labels"])
    lengths = F.filter(F.array(*[F.lit(n) for n in facts["lengths"]]), lambda n: n <= F.length("path"))
    expressions = (
        distinct.where("host <> ''").withColumn("labels", labels).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .withColumn("suffix", F.concat_ws(".", F.reverse(F.slice("labels", F.lit(1), F.col("k")))))
        .withColumn("n", F.explode(lengths))
        .select("url", F.sha2(F.concat("suffix", F.lit("\n"), F.expr("left(path, n)")), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, 8)))
    if facts["bytes"] <= rule_bytes:
        met = expressions.join(F.broadcast(known), "short")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    best = (
        met.where(F.col("full") == F.col("digest"))
        .groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(
            F.length("rule"), F.col("verdict") == "block", F.hash("rule"))).alias("b"))
        .select("url", "b.rule", "b.verdict"))
    judged = rows.where("url is not null").join(best, "url", "left").unionByName(
        rows.where("url is null").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}))
    return judged.select(
        F.col("key").alias(key), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
