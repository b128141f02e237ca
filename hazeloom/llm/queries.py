"""One query per operator, over the whole of its table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunk_dedup,
    crf_language,
    divergence,
    license_scan,
    mixing,
    quality_lines,
    quality_model,
    segmentation,
    simhash,
    table_kmeans,
    token_counts,
    url_rules,
    vptree,
)
from .common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lines.judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_failed_lines lost_chars"
    return judged.select("doc_id", *[f"quality.{c}" for c in fields.split()])


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM d),
pos AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
jl AS (
    SELECT r, l, regexp_matches(right(l, 8), '[.!?…。！？]["'')\\]»”’]*\\s*$')
        AND (m < 2 OR m * 4 <= len(regexp_extract_all(l, '[\\x20\\x09-\\x0D]+')) + 1)
        AND NOT regexp_matches(l, '(?i)\\b(?:@BOILER@)\\b') AS ok
    FROM (SELECT r, l, len(regexp_extract_all(l, '[|»›·•]|@RUNS@')) AS m FROM ln
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]'))
),
la AS (
    SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (NOT ok) AS failed,
        coalesce(sum(length(l)) FILTER (NOT ok), 0) AS lost, sum(length(l)) AS total
    FROM jl GROUP BY r
),
base AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(ws) < 50 OR 100 * coalesce(cov.n, 0) > 50 * len(ws) AS base_failed,
        coalesce(failed, 0)::INT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(total, 0) AS total
    FROM w LEFT JOIN cov USING (r) LEFT JOIN la USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND lost_chars <= 0.5 * total AS kept, n_failed_lines, lost_chars
FROM base
""".replace("@BOILER@", "|".join(quality_lines.BOILERPLATE)).replace(
    "@RUNS@", "|".join(f"[{m}]{{2,}}" for m in ["!", "#", "$", "%", "&", "*", "+", "/", "<", "=", ">", "?", "@", "\\^", "_", "~", "\\\\", "\\-"])
)


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.mixed(docs, "doc_id", "text", "source", carry=["doc_id"])
    return found.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


#: The given rules, (action, host/path).
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)
    return judged.select("page_id", "judged.*")


OP4_SQL = """
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, url,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
),
t AS (
    SELECT r, list_sort(list_distinct(list_concat(list_concat(
        ['scheme:' || x FOR x IN regexp_split_to_array(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)), '[^\\p{L}\\p{M}]+') IF x <> ''],
        ['host:' || x FOR x IN string_split(host, '.') IF x <> '']), list_concat(
        ['path:' || x FOR x IN regexp_split_to_array(lower(path), '[^\\p{L}\\p{M}]+') IF x <> ''],
        ['query:' || lower(x) FOR x IN regexp_extract_all(url, '[?&]([^=&#]+)=', 1)])))) AS items
    FROM p
),
lab AS (
    SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
    WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1
),
tx AS (SELECT r, bad FROM p JOIN lab USING (page_id)),
least AS (SELECT ceil(greatest(0.002, 5.0 / count(*)) * count(*) - 1e-9) AS n FROM tx),
often AS (
    SELECT token FROM (SELECT r, unnest(items) AS token FROM t) JOIN tx USING (r) GROUP BY token HAVING sum(bad) >= (SELECT n FROM least)
),
f AS (SELECT r, list(token ORDER BY token) AS items FROM (SELECT r, unnest(items) AS token FROM t) SEMI JOIN often USING (token) GROUP BY r),
sub AS (
    SELECT r, array_to_string([items[i + 1] FOR i IN range(len(items)) IF (m >> i) & 1 = 1], chr(1)) AS s
    FROM (SELECT r, items, unnest(range(1, (1 << len(items))::BIGINT)) AS m FROM f)
),
rules AS (
    SELECT s FROM sub JOIN tx USING (r) GROUP BY s
    HAVING sum(bad) >= (SELECT n FROM least) AND sum(bad) >= 0.6 * count(*)
),
fire AS (SELECT DISTINCT r FROM sub JOIN rules USING (s)),
given AS (
    SELECT r, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
    FROM p, (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'),
        ('block', 'example.net/de/8'), ('block', 'org/es/')) AS v(action, rule)
    WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
        AND starts_with(path, substr(rule, strpos(rule, '/')))
    GROUP BY r
)
SELECT page_id, host, path, rule,
    coalesce(action, CASE WHEN r IN (SELECT r FROM fire) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN given USING (r)
"""


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunk_dedup.without_repeats(docs, "doc_id", "text")
    return found.select(
        "doc_id",
        F.col("dedup.text").alias("text"),
        F.col("dedup.n_runs").alias("removed_runs"),
        F.col("dedup.n_words").alias("removed_words"),
        F.col("dedup.n_bytes").alias("removed_bytes"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, bits=64, radius=3)
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = segmentation.segmented(docs, "doc_id", "text", PIECES)
    return coded.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("restored").alias("lossless"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(F.col("text"), PIECES).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels, "doc_id", "text", "quality")
    scored = docs.select(
        "doc_id",
        F.coalesce(quality_model.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        quality_model.score(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("key", "doc_id").withColumnRenamed("template", "license")


def op11_table_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_kmeans.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    digest = table_kmeans.centroid_digest(F.col("centroid")).alias("centroid_sha256")
    return found.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


OP11_ROUND = """,
n@i@ AS MATERIALIZED (
    SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
    FROM (SELECT r, c, list_sum([(q[i] - m[i]) * (q[i] - m[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM kept, c@i@)
    GROUP BY r
)"""
OP11_MOVE = """,
c@j@ AS MATERIALIZED (
    SELECT c, coalesce(new, m) AS m FROM c@i@ LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new
        FROM (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM n@i@ JOIN kept USING (r), range(1, 65) AS t(i) GROUP BY c, i)
        GROUP BY c
    ) USING (c)
)"""
OP11_SQL = """
WITH raw AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
kept AS MATERIALIZED (
    SELECT r, vec_id, [floor(1024 * x)::BIGINT FOR x IN e] AS q FROM raw
    WHERE len(e) = 64 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1)::INT AS c, q AS m
    FROM kept QUALIFY c < 8
)@ROUNDS@
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM n10 JOIN kept USING (r) JOIN c10 USING (c)
""".replace(
    "@ROUNDS@",
    "".join(
        (OP11_ROUND + (OP11_MOVE if i < 10 else "")).replace("@i@", str(i)).replace("@j@", str(i + 1)) for i in range(11)
    ),
)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "lang", "source", "text")


OP12_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
w AS (
    SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT r, lang, source, unnest(terms) AS t FROM d)
),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
gp AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
    FROM g JOIN v USING (lang) JOIN kept k USING (lang)
        LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source
),
f AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM gp WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts
) WHERE part = 'pair' OR rank <= 200
"""


def op13_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = crf_language.fit(docs, "doc_id", "text", "lang")
    labelled = docs.select(
        "doc_id",
        F.coalesce(crf_language.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        crf_language.language(F.col("text"), field).alias("found"),
    )
    return labelled.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        "found.score",
        "found.n_words",
        F.size("found.spans").cast("long").alias("n_spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_lines,
        op2_vptree,
        op3_mixing,
        op4_url_rules,
        op5_chunk_dedup,
        op6_simhash,
        op7_segmentation,
        op8_token_counts,
        op9_quality_model,
        op10_license_scan,
        op11_table_kmeans,
        op12_divergence,
        op13_crf_language,
    )
}
#: The others draw at random, hash with functions that SQL lacks, or search approximately.
ORACLE_SQL = {"op1_quality_lines": OP1_SQL, "op4_url_rules": OP4_SQL, "op11_table_kmeans": OP11_SQL, "op12_divergence": OP12_SQL}
