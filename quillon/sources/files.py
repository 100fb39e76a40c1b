"""Text files, chunk and index tables, chat events, logs."""

from __future__ import annotations

import logging
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.chat import audit_rows, log_rows

CHUNK_SCHEMA = "chunk_id string, source_path string, title string, heading_path array<string>, text string, start_char int, end_char int"
EVENT_SCHEMA = "event_id long, ts timestamp, type string, message string"
LOG_SCHEMA = "rank string, user string, queries string, reply string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def any_below(spark: SparkSession, pattern: str) -> bool:
    """Whether a path fits the pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or ()) > 0


def relative_path(path: Column, root: str) -> Column:
    """A file's path below ``root``, whatever scheme its address shows."""
    tail = PurePosixPath(root.split("://", 1)[-1]).as_posix().strip("/")
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), rf"^.*?{_quote(tail)}/", "")


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_ /" else "\\" + c for c in s)


def read_files(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """path, text of each file below ``root`` that a glob names, once; broken bytes become U+FFFD."""
    out = None
    for name, whole in dict.fromkeys((PurePosixPath(g).name, g) for g in globs):
        # the last part of a glob prunes the listing, the folders before it what is read
        got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        got = got.withColumn("below", relative_path(F.col("path"), root)).filter(F.col("below").rlike(glob_pattern(whole)))
        out = got if out is None else out.unionByName(got)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return out.dropDuplicates(["path"]).select(F.col("below").alias("path"), text.alias("text"))


def glob_pattern(g: str) -> str:
    """A glob as a pattern of relative paths: ``**`` is any number of folders, ``*`` and ``?`` stay in one."""
    out = []
    parts = PurePosixPath(g).parts
    for i, part in enumerate(parts):
        if part == "**":
            out.append("(?:[^/]+/)*" if i < len(parts) - 1 else "[^/]+")
            continue
        for piece in re.findall(r"\*+|\?|\[!?\]?[^\]]*\]|.", part):
            out.append("[^/]*" if piece[0] == "*" else "[^/]" if piece == "?" else "[^" + piece[2:] if piece.startswith("[!") else piece if piece[0] == "[" and len(piece) > 1 else _quote(piece))
        out.append("/" if i < len(parts) - 1 else "")
    return r"\A" + "".join(out) + r"\z"


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]).write.json(path, ignoreNullFields=False)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a line that is no chunk fails the read; blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)


def write_index(chunks: DataFrame, embeddings: DataFrame, path: str, model: str, source: str) -> None:
    """Chunks, matrix and a one-row description."""
    chunks.write.parquet(f"{path}/chunks")
    embeddings.write.parquet(f"{path}/embeddings")
    index_meta(embeddings, model, source).coalesce(1).write.json(f"{path}/meta")


def index_meta(embeddings: DataFrame, model: str, source: str) -> DataFrame:
    return embeddings.agg(F.count(F.lit(1)).alias("chunk_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim")).select(F.lit(model).alias("embedding_model"), "chunk_count", "embedding_dim", F.lit(source).alias("wiki_dir"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, embeddings); fails if the index is missing, or a chunk and the matrix don't match."""
    for part in ("chunks", "embeddings", "meta"):
        if not _exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"no index at {path}: {part} is missing")
    chunks, embeddings = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/embeddings")
    odd = chunks.select("chunk_idx").join(embeddings.select("chunk_idx"), "chunk_idx", "left_anti").unionByName(embeddings.select("chunk_idx").join(chunks.select("chunk_idx"), "chunk_idx", "left_anti"))
    if not odd.isEmpty() or chunks.count() != embeddings.count():
        raise ValueError(f"chunks and embeddings of {path} don't match")
    return chunks, embeddings


def chat_events(events: DataFrame) -> DataFrame:
    return events.filter(F.upper("type") == "CHAT")


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    return chat_events(spark.readStream.schema(EVENT_SCHEMA).parquet(path))


def append_log(replies: DataFrame, path: str, max_chat_chars: int) -> None:
    write_log(replies, path, max_chat_chars, "append")


def write_log(replies: DataFrame, path: str, max_chat_chars: int, mode: str = "overwrite") -> None:
    log_rows(replies, max_chat_chars).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_audit(dispatched: DataFrame, path: str) -> None:
    audit_rows(dispatched).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def logger(name: str, path: str | None = None, level: str = "INFO") -> logging.Logger:
    """A driver-side log to the console and, if named, a file; made once."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(level)
        for h in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            h.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
            log.addHandler(h)
    return log
