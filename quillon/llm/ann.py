"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its ``LISTED`` nearest pivots in order. Pivot
inverted files hold, for a pivot, the rows that list it and at which place; a
query reads the files of the pivots it lists itself, ranks rows by footrule
distance between the two orders (a pivot that a row does not list counts as
place ``LISTED``), and reranks the best by exact Euclidean distance.

The pivots are drawn from a bounded sample (``PIVOTS`` vectors out of at most
``PIVOT_SAMPLE``); every row is indexed. The index is a table of blocks of rows,
each with its own inverted files, in shared storage, which is read where it lies and
never dealt again. Queries are packed into blocks as well, and taken a chunk of at most
``CHUNK_BYTES`` at a time: a chunk is broadcast, and each task keeps the best of
each of its queries over all index blocks that it reads, so what is shuffled
grows with the tasks and not with the pairs of blocks.

A block's candidates are those within the footrule of its ``RERANK_SHARE``-th
share, ties at that footrule included, so no cap cuts copies of a vector apart.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; a query with vectors of two lengths among the rows is
an error; repeated ids are rows of their own, but a query id is answered once, for its
smallest vector, and finds no row of its own id; with fewer than k other rows, all are returned; ties
go to the smaller id; an empty table gives no rows; other columns are ignored,
whatever their names. Texts take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, pick, table

PIVOTS = 512
PIVOT_SAMPLE = 8192
#: Places kept of each order: a row is in a quarter of the inverted files.
LISTED = 128
#: Share of an index block that is reranked.
RERANK_SHARE = 0.2
INDEX_ROWS = 4096
QUERY_ROWS = 512
#: Vectors of queries that are broadcast at once.
CHUNK_BYTES = 1 << 25
#: Tasks that read the index: each gives the k best of every query.
TASKS = 128
#: Index blocks of a Parquet row group, which a reader holds whole.
GROUP_ROWS = 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part."""
    v = pick(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(finite & F.exists("embedding", lambda x: x != 0))


def choose_pivots(v: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Spread pivots over a bounded sample: farthest-first among random candidates."""
    got = v.select("embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(sample).collect()
    dims = {len(r[0]) for r in got}
    if len(dims) > 1:
        raise ValueError(f"vectors differ in length: {sorted(dims)}")
    if not got:
        return np.zeros((0, 1))
    x = np.unique(np.array([r[0] for r in got]), axis=0)
    rng = np.random.default_rng(11)
    x = x[rng.permutation(len(x))]
    if len(x) <= pivots:
        return x
    # half farthest-first (covers the space), half at random (follows the density)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    for _ in range(pivots // 2 - 1):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    rest = [i for i in range(len(x)) if i not in set(chosen)]
    return x[chosen + rest[: pivots - len(chosen)]]


def orders(x: np.ndarray, pivots: np.ndarray, listed: int = LISTED) -> np.ndarray:
    """The nearest pivots of each row, nearest first: a quarter of few pivots, ``listed`` of many."""
    listed = min(listed, -(-len(pivots) // 4))
    d = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    near = np.argpartition(d, listed - 1, axis=1)[:, :listed]
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1).astype(np.int32)


def _packed(v: DataFrame, rows: int, make, schema: str) -> DataFrame:
    """One row for every ``rows`` rows of a task, made of their ids and vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), rows):
                part = b.iloc[i : i + rows]
                yield make(part.vec_id.to_numpy(np.int64), np.array(part.embedding.tolist(), dtype=np.float64))

    return v.select("vec_id", "embedding").mapInPandas(run, schema)


def _stored(x: np.ndarray, dims: int) -> np.ndarray:
    """The vectors as single floats where these hold the same numbers."""
    if x.shape[1] != dims:
        raise ValueError(f"vectors differ in length: {sorted({x.shape[1], dims})}")
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return narrow if (narrow == x).all() else x


def _vectors(raw: bytes, n: int, dims: int) -> np.ndarray:
    """What ``_stored`` gave, in double precision."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dims else np.float64).reshape(n, dims).astype(np.float64)


def build_index(v: DataFrame, pivots: np.ndarray, rows: int = INDEX_ROWS) -> DataFrame:
    """Blocks of rows: ids, vectors and, by pivot, the posting lists of (row, place)."""
    if rows > 1 << 16 or LISTED > 1 << 8:
        raise ValueError("posting lists hold 65,536 rows and 256 places at most")

    def block(ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        near = orders(x, pivots)
        flat, n = near.ravel(), near.shape[1]
        by = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1)).astype(np.int32)
        return pd.DataFrame({"n": [len(ids)], "ids": [ids.tobytes()], "vectors": [_stored(x, len(pivots[0])).tobytes()], "rows": [(by // n).astype(np.uint16).tobytes()], "places": [(by % n).astype(np.uint8).tobytes()], "starts": [starts.tobytes()]})

    return _packed(v, rows, block, "n int, ids binary, vectors binary, rows binary, places binary, starts binary")


def _footrules(n: int, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Footrule distance of each row of a block to an order, read from that order's inverted files alone."""
    listed = len(order)
    ends = list(zip(starts[order].tolist(), starts[order + 1].tolist(), strict=True))
    mine = np.repeat(np.arange(listed, dtype=np.int16), [b - a for a, b in ends])
    read = np.concatenate([places[a:b] for a, b in ends]).astype(np.int16)
    gain = np.bincount(np.concatenate([rows[a:b] for a, b in ends]), weights=listed - mine - np.abs(read - mine), minlength=n)
    # a row that lists none of the pivots misses each by what its place could be off
    return listed * (listed + 1) // 2 - gain.astype(np.int32)


def _search(batches: Iterator[pd.DataFrame], pivots: np.ndarray, k: int, share: float) -> Iterator[pd.DataFrame]:
    """For each query of a task's pairs of blocks, the k nearest of all reranked rows."""
    dims = pivots.shape[1]
    asked, found = {}, {}
    for b in batches:
        for n, ids, vectors, rows, places, starts, q_block, q_ids, q in zip(b.n, b.ids, b.vectors, b.rows, b.places, b.starts, b.q_block, b.q_ids, b.q_vectors, strict=True):
            ids, x = np.frombuffer(ids, np.int64), _vectors(vectors, n, dims)
            rows, places, starts = np.frombuffer(rows, np.uint16), np.frombuffer(places, np.uint8), np.frombuffer(starts, np.int32)
            q_ids = np.frombuffer(q_ids, np.int64)
            q = _vectors(q, len(q_ids), dims)
            if q_block not in found:
                asked[q_block] = (q_ids.copy(), orders(q, pivots).astype(np.int16 if len(pivots) < 1 << 15 else np.int32))
                found[q_block] = (np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64))
            keep = max(1, int(np.ceil(share * n)))
            # the k-th candidate and the query's own row come first where a block is small
            at = min(n - 1, max(keep, k + 1) - 1)
            near_d, near_v = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
            for i, (qid, vector, order) in enumerate(zip(q_ids, q, asked[q_block][1], strict=True)):
                foot = _footrules(n, rows, places, starts, order)
                c = np.flatnonzero(foot <= np.partition(foot, at)[at])
                c = c[ids[c] != qid]
                d = np.sqrt(((x[c] - vector) ** 2).sum(1))
                best = np.lexsort((ids[c], d))[:k]
                near_d[i, : len(best)], near_v[i, : len(best)] = d[best], ids[c][best]
            # what no row fills yet is infinitely far
            far, at_v = (np.concatenate(x, axis=1) for x in zip(found[q_block], (near_d, near_v), strict=True))
            best = np.lexsort((at_v, far), axis=1)[:, :k]
            found[q_block] = (np.take_along_axis(far, best, 1), np.take_along_axis(at_v, best, 1))
    for q_block, (d, v) in found.items():
        i, j = np.nonzero(d < np.inf)
        yield pd.DataFrame({"query_id": asked[q_block][0][i], "vec_id": v[i, j], "score": d[i, j]})


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, share: float = RERANK_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row."""
    spark, v = vectors.sparkSession, usable(vectors)
    p = choose_pivots(v, pivots)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(p):
        return spark.createDataFrame([], schema)
    index = materialize(build_index(v, p), "permutations", **{"parquet.block.row.count.limit": GROUP_ROWS})
    index = index.coalesce(TASKS)
    one = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = _packed(one, QUERY_ROWS, lambda ids, x: pd.DataFrame({"q_ids": [ids.tobytes()], "q_vectors": [_stored(x, len(p[0])).tobytes()]}), "q_ids binary, q_vectors binary")
    # blocks are numbered in shared storage, so a number stays whatever runs again
    asked = materialize(asked.withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    chunks = max(1, -(-(asked.agg(F.sum(F.length("q_vectors"))).first()[0] or 0) // CHUNK_BYTES))
    hits = None
    for chunk in range(chunks):
        now = asked.filter(F.pmod(F.xxhash64("q_block"), F.lit(chunks)) == chunk)
        got = index.crossJoin(F.broadcast(now)).mapInPandas(lambda batches: _search(batches, p, k, share), "query_id long, vec_id long, score double")
        if chunks > 1:  # one chunk is in memory at a time
            got = materialize(got, "hits")
        hits = got if hits is None else hits.unionByName(got)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return knn(v, v.filter(F.col("vec_id") % 100 == 0))
