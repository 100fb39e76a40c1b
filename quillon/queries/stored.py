"""Queries of what is written and read back: chunk lines and the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.queries.retrieval import BASE, chunks, matrix
from quillon.queries.text import table
from quillon.sources import files
from quillon.storage import shared_dir


def _path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    path, i = _path(spark, "chunk-lines"), F.col("doc_id")
    c = table(spark, d, "documents").select(i.cast("string").alias("chunk_id"), F.concat(F.lit("a/"), "source").alias("source_path"), F.lit(None).cast("string").alias("title"), F.array("lang", "source").alias("heading_path"), "text", (i % 9).cast("int").alias("start_char"), "n_chars")
    files.write_chunks(c.withColumn("end_char", F.col("n_chars").cast("int")), path)
    got = files.read_chunks(spark, path)
    return got.select("chunk_id", "source_path", "title", F.array_join("heading_path", ">").alias("heading"), F.md5("text").alias("md5"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "index")
    files.write_index(chunks(spark, d), matrix(spark, d), path, "m", "w")
    c, e = files.read_index(spark, path)
    return c.join(e, "chunk_idx").select("chunk_idx", "source_path", F.md5("text").alias("md5"), F.size("embedding").cast("long").alias("dim"))


QUERIES: dict[str, tuple] = {
    "chunk_lines": (_chunk_lines, "SELECT doc_id::VARCHAR AS chunk_id, 'a/' || source AS source_path, NULL::VARCHAR AS title, lang || '>' || source AS heading, md5(text) AS md5, doc_id % 9 AS start_char, n_chars::BIGINT AS end_char FROM documents"),
    "index_round_trip": (_index, BASE + "SELECT c.id AS chunk_idx, path AS source_path, md5(text) AS md5, len(embedding) AS dim FROM c JOIN m USING (id)"),
}
