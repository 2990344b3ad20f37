"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, itq, langid, minhash, mixing, ngram, pfor, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with all cells visited, which is exact: ids divisible by 20 against all rows."""
    found = ann.neighbours(_read(spark, sf_dir, "embeddings"), queries=lambda i: i % 20 == 0, share=1.0)
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", F.round("distance", 4).alias("distance"))


def queries() -> dict[str, Query]:
    docs = lambda s, d: _read(s, d, "documents")
    return {
        "op1_inverted_multi_index": lambda s, d: ann.neighbours(_read(s, d, "embeddings"), queries=lambda i: i % 20 == 0),
        "op2_minhash_forest": lambda s, d: minhash.near_duplicates(docs(s, d)),
        "op3_ngram_scoring": lambda s, d: ngram.score_documents(docs(s, d)),
        "op4_itq_near_dedup": lambda s, d: itq.near_duplicates(_read(s, d, "embeddings")),
        "op5_byte_bpe": lambda s, d: bpe.encode(docs(s, d)),
        "op6_cube_mixing": lambda s, d: mixing.mix_sources(docs(s, d)),
        "op7_warc_captures": lambda s, d: warc.assemble(warc.parse_records(warc.records_of_pages(_read(s, d, "pages")))),
        "op8_ppm_language": lambda s, d: langid.identify(docs(s, d)),
        "op9_pfor_tokens": lambda s, d: pfor.tokenize_and_pack(docs(s, d)),
        "op10_sampled_splitters": lambda s, d: sharding.shard(docs(s, d)),
        "warc_capture_summary": lambda s, d: warc.capture_summary(warc.assemble(warc.parse_records(warc.records_of_pages(_read(s, d, "pages"))))),
        "ann_all_cells": _all_cells,
        "mixing_units": lambda s, d: mixing.mix_sources(docs(s, d)).select("doc_id", "source", "n_tokens"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "warc_capture_summary": r"""
            SELECT '<urn:page:response:' || page_id || '>' AS capture_id, url AS target_uri, 1 AS n_requests, 1 AS n_responses, 1 AS n_metadata,
                   200 AS status, length(html) AS body_chars, sha256(html) AS body_sha256,
                   CASE WHEN regexp_replace(url, '^[a-z]+://[^/?#]*|#.*$', '', 'g') = '' THEN '/' ELSE regexp_replace(url, '^[a-z]+://[^/?#]*|#.*$', '', 'g') END AS path
            FROM pages""",
        "ann_all_cells": f"""
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
            d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
            SELECT vec_id, rank, neighbour_id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= {ann.K}""",
        "mixing_units": r"""
            SELECT doc_id, min(source) AS source, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY doc_id""",
    }
