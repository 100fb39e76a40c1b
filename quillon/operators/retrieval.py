"""Hybrid retrieval: a cosine gate, BM25, reciprocal rank fusion, and what follows.

A batch of queries is one job. Texts are left out of every ranking: pairs carry
ids and numbers, and texts are joined to the few results at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.operators import index as I
from quillon.storage import dealt, materialize

# Fixed values
RRF_K = 60
RECENCY_K = 2
DATED_PENALTY = 1.0
RARE_DF = 8
RARE_CAP = 3
RARE_FLOOR = 0.10
SIBLING_CAP = 12
TOP_K = 5
MIN_SCORE = 0.18
#: Rows of a block of queries and of the matrix: bounds what one product holds.
QUERY_ROWS = 512
MATRIX_ROWS = 2048


def dense_pairs(embeddings: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, chunk_idx, dense of pairs with dense >= least.

    ``embeddings``: chunk_idx, embedding. ``queries``: query_id, embedding. Both are
    packed into blocks; the matrix's blocks are dealt into slots and each block of
    queries goes to every slot by a join, so neither passes through the driver.
    """
    slots = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _packed(queries, "query_id", QUERY_ROWS).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    e = _packed(embeddings, "chunk_idx", MATRIX_ROWS).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, q_ids, y in zip(*(b.column(c).to_pylist() for c in ("ids", "vectors", "q_ids", "q_vectors")), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                s = np.frombuffer(x, np.float64).reshape(len(ids), -1) @ np.frombuffer(y, np.float64).reshape(len(q_ids), -1).T
                at, qi = np.nonzero(s >= least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(ids[at]), pa.array(s[at, qi])], ["query_id", "chunk_idx", "dense"])

    return e.join(q, "slot").select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(scan, "query_id long, chunk_idx long, dense double")


def _packed(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """ids, vectors: one row for every ``rows`` rows of a task that have a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), rows):
                part = b.slice(lo, rows)
                ids, x = part.column(0).to_numpy(), np.asarray(part.column(1).flatten(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["ids", "vectors"])

    held = df.filter("embedding is not null").select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return held.mapInArrow(run, "ids binary, vectors binary")


def _even(c: str) -> Column:
    """A score for ordering: sums in another order are ties."""
    return F.desc(F.round(c, 9))


def cosine_of(pairs: DataFrame, embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` with dense, for few pairs: by joins, whatever the score."""
    d = pairs.join(embeddings.select(F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("embedding").cast("array<double>").alias("__e")), "chunk_idx")
    d = d.join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("__q")), "query_id")
    return d.withColumn("dense", F.aggregate(F.zip_with("__e", "__q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)).drop("__e", "__q")


def _rank(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def dense_rank(pairs: DataFrame, gate: float = MIN_SCORE) -> DataFrame:
    """Pairs at or above the gate, with rank_dense."""
    return pairs.filter(F.col("dense") >= gate).withColumn("rank_dense", _rank(_even("dense"), F.col("chunk_idx")))


def scored_pairs(dense: DataFrame, parts: DataFrame) -> DataFrame:
    """query_id, chunk_idx, dense, lex (null: no term is shared) of ``dense_pairs``.

    ``parts``: see ``posting_parts``. Both are dealt by chunk and summed there, in one
    pass: pairs that share a term, which are most of all, are never exchanged.
    """
    null = F.lit(None).cast("double")
    d = dealt(dense, "chunk_idx").select("query_id", "chunk_idx", "dense", null.alias("part"))
    both = d.unionByName(parts.select("query_id", F.col("id").alias("chunk_idx"), null.alias("dense"), "part"))
    return both.groupBy("query_id", "chunk_idx").agg(F.max("dense").alias("dense"), F.sum("part").alias("lex")).filter("dense is not null")


def named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with source_path, heading_path and date of ``names``, a row a chunk, joined where pairs are dealt by chunk.

    A chunk's date is read from its path once, not for each of its pairs.
    """
    dated = dealt(names.select("chunk_idx", "source_path", "heading_path"), "chunk_idx").withColumn("date", P.source_date(F.col("source_path")))
    return pairs.join(dated.hint("shuffle_hash"), "chunk_idx")


def lexical_rank(ranked: DataFrame) -> DataFrame:
    """Of ``scored_pairs`` with rank_dense: lex (0 if no term is shared) and rank_lex (null then)."""
    d = ranked.withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    # pairs without a lexical score sort last, so the others' numbers are their ranks
    return d.withColumn("rank_lex", F.when(F.col("lex") > 0, _rank(_even("lex"), F.col("rank_dense"))))


def recency_rank(ranked: DataFrame) -> DataFrame:
    """With rank_date among dated sources, newest first (null: undated). Needs date (see ``named``)."""
    return ranked.withColumn("rank_date", F.when(F.col("date").isNotNull(), _rank(F.desc_nulls_last("date"), F.col("rank_dense"))))


def fuse(ranked: DataFrame) -> DataFrame:
    """With fused and rank_fused. Needs rank_dense, rank_lex, rank_date, date, recency."""
    lex = F.coalesce(1.0 / (RRF_K + F.col("rank_lex")), F.lit(0.0))
    dated = F.when(F.col("date").isNull(), 0.0).when(F.col("recency"), 1.0 / (RECENCY_K + F.col("rank_date"))).otherwise(-DATED_PENALTY)
    d = ranked.withColumn("fused", 1.0 / (RRF_K + F.col("rank_dense")) + lex + dated)
    return d.withColumn("rank_fused", _rank(_even("fused"), _even("dense"), F.col("rank_dense")))


def diverse_topk(fused: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k by rank_fused, of which a source and heading fills at most the first half twice.

    A row stays if it is in the first half or the first of its source and heading;
    of these, the first k. With pos from 1.
    """
    # a source and heading is one row of sums: its first, and what it has in the first half. Pairs aren't sorted by these names
    key = ["query_id", "source_path", "heading_path"]
    others = [c for c in fused.columns if c not in (*key, "rank_fused")]
    rank, places = F.col("rank_fused"), range(2, math.ceil(k / 2) + 1)
    sums = [F.struct(F.min(rank).alias("rank_fused"), *[F.min_by(c, rank).alias(c) for c in others])]
    sums += [F.struct(F.max(F.when(rank == n, rank)).alias("rank_fused"), *[F.max(F.when(rank == n, F.col(c))).alias(c) for c in others]) for n in places]
    kept = fused.groupBy(*key).agg(F.array(*sums).alias("rows"))
    rows = F.filter("rows", lambda r, i: (i == 0) | (r["rank_fused"] > F.col("rows")[0]["rank_fused"]))
    kept = kept.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")
    return kept.withColumn("pos", _rank(rank)).filter(F.col("pos") <= k)


def rare_rescue(results: DataFrame, pairs: DataFrame, postings: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """query_id, chunk_idx, dense, pos (from 1) of chunks that hold a rare query term no result holds.

    ``results``: query_id, chunk_idx. ``pairs``: see ``scored_pairs``. ``postings``: id, term, df of the queries' terms.
    """
    q = I.query_tokens(queries).select("query_id", "term")
    rare = postings.filter(F.col("df") <= RARE_DF).select("term", F.col("id").alias("chunk_idx"))
    holding = rare.join(q, "term")
    covered = holding.join(results.select("query_id", "chunk_idx"), ["query_id", "chunk_idx"], "left_semi").select("query_id", "term").distinct()
    cands = holding.join(covered, ["query_id", "term"], "left_anti").select("query_id", "chunk_idx").distinct()
    cands = cands.join(results.select("query_id", "chunk_idx"), ["query_id", "chunk_idx"], "left_anti")
    # few: at most RARE_DF chunks of each term of a query
    cands = pairs.filter((F.col("dense") >= floor) & F.col("lex").isNotNull()).join(F.broadcast(cands), ["query_id", "chunk_idx"])
    return cands.withColumn("pos", _rank(_even("lex"), F.col("chunk_idx"))).filter(F.col("pos") <= RARE_CAP).select("query_id", "chunk_idx", "dense", "pos")


def table_siblings(results: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, chunk_idx, trigger (the result's pos), nth: table chunks to add after the first result of their heading.

    ``results``: query_id, pos, chunk_idx, source_path, heading_path.
    """
    key = ["source_path", "heading_path"]
    trigger = results.groupBy("query_id", *key).agg(F.min("pos").alias("trigger"))
    more = trigger.join(groups, key).join(results.select("query_id", "chunk_idx"), ["query_id", "chunk_idx"], "left_anti")
    return more.withColumn("nth", _rank(F.col("trigger"), F.col("start_char"), F.col("chunk_idx"))).filter(F.col("nth") <= SIBLING_CAP).select("query_id", "chunk_idx", "trigger", "nth")


def scored(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """``scored_pairs`` with dense >= floor, and the postings (id, term, df) of the queries' terms."""
    texts = dealt(chunks.select("chunk_idx", "title", "source_path", "heading_path", "text"), "chunk_idx")
    tokens = I.tokenized(texts, "chunk_idx", I.embed_text(F.col("title"), F.col("source_path"), F.col("heading_path"), F.col("text")))
    postings, stats = I.hits(tokens, I.query_tokens(queries))
    return scored_pairs(dense_pairs(embeddings, queries, floor), I.posting_parts(postings, stats, queries)), postings.select("id", "term", "df")


def fused_pairs(pairs: DataFrame, names: DataFrame, queries: DataFrame, gate: float = MIN_SCORE) -> DataFrame:
    """``scored_pairs`` at or above the gate with all ranks. ``names``: chunk_idx, source_path, heading_path."""
    d = named(pairs.filter(F.col("dense") >= gate), names)
    # one exchange by query for all ranks
    d = d.join(queries.select("query_id", P.recency_query(F.col("query")).alias("recency")), "query_id")
    return fuse(recency_rank(lexical_rank(dense_rank(d, gate))))


def top_pairs(pairs: DataFrame, names: DataFrame, queries: DataFrame, k: int = TOP_K, gate: float = MIN_SCORE) -> DataFrame:
    d = fused_pairs(pairs, names, queries, gate)
    return diverse_topk(d.select("query_id", "chunk_idx", "dense", "source_path", "heading_path", "rank_fused"), k)


def search(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = TOP_K, gate: float = MIN_SCORE) -> DataFrame:
    """query_id, pos (from 1), chunk_idx, score (always the cosine): all steps.

    ``chunks``: chunk_idx, source_path, title, heading_path, text, start_char.
    ``queries``: query_id, query, embedding. Blank queries have no results.
    """
    asked = queries.filter(F.length(F.trim("query")) > 0)
    floor = min(gate, RARE_FLOOR)
    # what several steps read is computed once
    pairs, postings = scored(chunks, embeddings, asked, floor)
    pairs = materialize(pairs, "pairs")
    names = chunks.select("chunk_idx", "source_path", "heading_path")
    top = materialize(top_pairs(pairs, names, asked, k, gate).select("query_id", "chunk_idx", "dense", "pos"), "top")
    rescued = rare_rescue(top, pairs, postings, asked, floor)
    both = materialize(top.unionByName(rescued.withColumn("pos", F.col("pos") + k)), "found")
    added = cosine_of(table_siblings(both.join(names, "chunk_idx"), I.table_groups(chunks)), embeddings, asked)
    out = both.select("query_id", "chunk_idx", "dense", F.col("pos").alias("trigger"), F.lit(0).alias("nth")).unionByName(added.select("query_id", "chunk_idx", "dense", "trigger", "nth"))
    return out.withColumn("pos", _rank(F.col("trigger"), F.col("nth"))).select("query_id", "pos", "chunk_idx", F.col("dense").alias("score"))
