"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, licenses, lm, neardup, packing, sharding, topk, toxicity, warc
from .common import crc_mod, long_texts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return long_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(warc.page_captures(table(spark, sf_dir, "pages")))


def op5_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 100 = 0"), rows, 10)


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op1_lbl_nce_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_lbl_nce_scores, op2_qgram_decontamination, op3_license_digests, op4_warc_revisits, op5_nra_topk, op6_lsh_forest_dedup, op7_bounded_ring, op8_language_id, op9_toxicity, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_digests": licenses.scan_sql(), "op4_warc_revisits": warc.page_revisits_sql(), "op5_nra_topk": TOPK_SQL}
