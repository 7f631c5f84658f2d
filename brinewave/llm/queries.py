"""The operators' queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm import (
    apportion,
    collocations,
    hyperminhash,
    language_zstd,
    pii_lstm,
    quality_gbt,
    quality_pu,
    shared_search,
    token_counts,
    toxicity_mil,
    url_rules,
    warc_normalise,
    winnowing,
)
from brinewave.llm.common import crc_mod, table

QUERIES = {}
ORACLE: dict[str, str] = {}

#: (host, path, verdict)
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def query(fn=None, *, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add(fn) if fn else add


# -- op1 ---------------------------------------------------------------------------------


@query
def op1_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_gbt.train_quality(docs, table(spark, folder, "labels"))
    failed = quality_gbt.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return quality_gbt.judge_quality(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= 0.5)).alias("kept"), "score")


# -- op2 ---------------------------------------------------------------------------------


def _listed(spans: str) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in pii_lstm.KINDS]), s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op2_bilstm_crf_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii_lstm.find_spans(docs, pii_lstm.train_tagger(docs)).withColumn("every", F.concat("base", "added"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in pii_lstm.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("every").alias("spans"),
                        F.size("added").alias("n_added"))


# -- op3 ---------------------------------------------------------------------------------

TOXIC_AT = 0.7


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity_mil.Toxicity:
    return toxicity_mil.train_toxicity(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)


@query
def op3_multiple_instance_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity_mil.score_toxicity(docs, toxicity_model(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


# -- op4 ---------------------------------------------------------------------------------


@query
def op4_viterbi_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), token_counts.load_vocabulary())


# -- op5 ---------------------------------------------------------------------------------

_LETTER_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_LETTER_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LETTER_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query(sql=OP5_SQL)
def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.match_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# -- op6 ---------------------------------------------------------------------------------

_BLANK_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')")

OP6_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest(
       CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE ['x'] END) END AS g
       FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query(sql=OP6_SQL)
def op6_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


# -- op7 ---------------------------------------------------------------------------------

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""


@query(sql=OP7_SQL)
def op7_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return warc_normalise.round_trip(table(spark, folder, "pages"))


# -- op8 ---------------------------------------------------------------------------------

@query
def op8_apportionment(spark: SparkSession, folder: str) -> DataFrame:
    return apportion.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


# -- op9 ---------------------------------------------------------------------------------


@query
def op9_zstd_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    dictionaries = language_zstd.train_dictionaries(docs, crc_mod(F.col("doc_id"), 4) != 2)
    found = language_zstd.identify(docs, dictionaries)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("best").alias("lang_pred"), "score", "rejected")


# -- op10 --------------------------------------------------------------------------------

OP10_SQL = f"""
WITH r(rh, rp, v) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


@query(sql=OP10_SQL)
def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS r(host, path, verdict)")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


# -- op11 --------------------------------------------------------------------------------

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _cut_sql(size: int, k: int) -> str:
    return (f"SELECT c.lang, c.phrase, c.a, {k} AS k, x.a AS l, y.a AS r FROM c JOIN f x ON x.key = c.lang || chr(1) || array_to_string(c.w[1:{k}], ' ') "
            f"JOIN f y ON y.key = c.lang || chr(1) || array_to_string(c.w[{k + 1}:{size}], ' ') WHERE len(c.w) = {size}")


OP11_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents)),
o AS (SELECT piece, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
t AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER pieces AS w2, lead(w1, 2) OVER pieces AS w3 FROM o WINDOW pieces AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM t UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM t WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM t WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang || chr(1) || phrase AS key, lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS ({_cut_sql(2, 1)} UNION ALL {_cut_sql(3, 1)} UNION ALL {_cut_sql(3, 2)}),
s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE len(w) = 3
                UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE len(w) = 3),
longer AS (SELECT lang, phrase, max(a) AS m FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query(sql=OP11_SQL)
def op11_tiled_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


# -- op12 --------------------------------------------------------------------------------

OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_LETTER_WORDS} AS w FROM documents),
o AS (SELECT row, doc_id, unnest(w) AS t FROM d),
tf AS MATERIALIZED (SELECT row, doc_id, t, count(*) AS tf FROM o GROUP BY ALL),
s AS MATERIALIZED (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
m AS (SELECT row, 100 - 50 + ((50 * len(w) * nd) // nt) AS m FROM d, s WHERE len(w) > 0),
wt AS (SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, s GROUP BY t, nd),
q AS (SELECT DISTINCT item_id, unnest({_LETTER_WORDS}) AS t FROM benchmark),
x AS (SELECT item_id, row, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""


@query(sql=OP12_SQL)
def op12_shared_subexpressions(spark: SparkSession, folder: str) -> DataFrame:
    return shared_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# -- op13 --------------------------------------------------------------------------------

GOOD_AT = 0.3


@query
def op13_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    training = crc_mod(F.col("doc_id"), 5) != 0
    model = quality_pu.train_quality(docs, table(spark, folder, "labels"), training)
    return quality_pu.score_quality(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))
