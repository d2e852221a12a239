"""The registered queries of this subpackage and their SQL.

Each query is thin: it applies an operator, with production parameters, to its whole table and derives the columns that
are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, common, decontamination, hard_negatives, harmonic, html_extract, langid, ngram_join, packing, periodic, suffix_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), window=100)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.train(url_filter.LABELLED))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), common.crc32_fold("doc_id", 4) != 2)
    return toxicity.score(documents, model).select(
        "doc_id", (common.crc32_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.train(documents, common.crc32_fold("doc_id", 5) != 0)
    return langid.predict(documents, model).select("doc_id", (common.crc32_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), num=9, den=10, n=3)


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer())


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near(_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(scanned).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(_table(spark, sf_dir, "documents"), rewrite=periodic.echoed)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_url_filter, op3_html_extraction, op4_warc, op5_toxicity, op6_language_id, op7_ngram_jaccard_join, op8_best_fit_packing, op9_embedding_near_dedup, op10_decontamination,
    op11_hard_negatives, op12_periodic_runs, op13_harmonic_packing,
)}


_CASE = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach AS (SELECT {id} AS s, {id} AS t FROM {of} UNION SELECT r.s, e.v FROM reach r JOIN edges e ON r.t = e.u)"

WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, upper(sha1(h)) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS target FROM d),
g AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(x, CAST(5 * k + 1 AS INT), 5) AS INT)) AS v FROM m)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n >> b) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to FROM g"""

JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_CASE}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)), edges AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
{_REACH.format(id="doc_id", of="documents")} SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(t) FROM reach WHERE s = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

VECTOR_SQL = f"""WITH RECURSIVE w AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS most FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
g AS (SELECT vec_id, label, CASE WHEN most > 0 AND (most > 1e100 OR most < 1e-100) THEN list_transform(e, lambda x: x / most) ELSE e END AS e FROM w), x AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS norm FROM g), pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98), edges AS (SELECT u, v FROM pairs), {_REACH.format(id="vec_id", of="embeddings")},
c AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY s) SELECT vec_id, (SELECT count(*) FROM pairs WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""

NEGATIVES_SQL = """WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INT) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3"""

BENCHMARK_SQL = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_CASE}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_CASE}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM win), dg AS (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, ls)),
found AS (SELECT DISTINCT doc_id, i, dg.l, item_id FROM dg JOIN win ON dg.g = win.g AND dg.l = win.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {
        "op2_url_filter": url_filter.oracle(url_filter.train(url_filter.LABELLED)),
        "op4_warc": WARC_SQL,
        "op7_ngram_jaccard_join": JOIN_SQL,
        "op9_embedding_near_dedup": VECTOR_SQL,
        "op10_decontamination": BENCHMARK_SQL,
        "op11_hard_negatives": NEGATIVES_SQL,
    }
