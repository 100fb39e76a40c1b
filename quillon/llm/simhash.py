"""SimHash near-duplicate classes by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its
3-word shingles. Distinct fingerprints are compared, never documents: copies
cost nothing more. Candidates share two of four 16-bit blocks, which any two
fingerprints at 2 or fewer differing bits do. A bucket of more than
``BUCKET_ROWS`` is dealt again by two of the four 8-bit blocks of the remaining
32 bits; such a bucket fixes 48 bits, so it holds at most 65,536 distinct
fingerprints. That is the exact way for hot buckets; nothing is capped.

Buckets are compared many at a time. Their fingerprints are stored as bit
planes: one machine word holds a bit of 64 fingerprints of a bucket. Distances to
a fingerprint grow in two bitwise counters and an overflow mask, by carry-save
addition plane by plane, and a word is abandoned once all of its 64 distances
exceed the radius. Close pairs are merged into classes as they come.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and links like any other; a very long text is read whole, its shingles'
bits counted ``COUNT_ROWS`` at a time; a bit set in exactly half the hashes is 0; a null doc_id never is a component's id unless no
other is there; repeated rows are rows of one class; an empty table gives no
rows; other columns are ignored, and ``keep_one`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import hot_keys, materialize, pick, spread_join, table, text_of, whole
from quillon.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BUCKET_ROWS = 4096
#: Shingles whose bits are counted at once: bounds memory on very long texts.
COUNT_ROWS = 1 << 16
#: Cells (a fingerprint and 64 others) that are compared at once, and fingerprints of a batch of buckets.
CELLS = 1 << 16
BATCH_ROWS = 1 << 16

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    h = xxhash.xxh64_intdigest
    if n == 1:
        return h(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ones = np.zeros(64, np.int64)
    for i in range(0, n, COUNT_ROWS):
        j = min(n, i + COUNT_ROWS)
        got = np.array([h(joined[s : e - 1], SEED) for s, e in zip(starts[i:j], starts[i + SHINGLE_WORDS : j + SHINGLE_WORDS], strict=True)], dtype="<u8")
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64))

    return of(text)


def planes_of(fps: np.ndarray, slots: np.ndarray, words: int, bits: np.ndarray) -> np.ndarray:
    """(bits, words) uint64: bit j of word w of a plane is that bit of the fingerprint in slot 64 w + j."""
    out = np.zeros((len(bits), words), np.uint64)
    for i, b in enumerate(bits):
        plane = np.zeros(words * 64, np.uint8)
        plane[slots] = (fps >> np.uint64(b)) & np.uint64(1)
        out[i] = np.packbits(plane, bitorder="little").view("<u8")
    return out


def close_chunks(fps: np.ndarray, sizes: list[int], radius: int = RADIUS, step: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one bucket at ``radius`` (1 to 3) or fewer differing bits.

    ``fps``: the buckets end to end, ``sizes`` their lengths.
    """
    if not 1 <= radius <= 3:
        raise ValueError("the counters hold a radius of 1 to 3")
    fps, size = fps.astype(np.uint64), np.asarray(sizes, np.int64)
    m = len(fps)
    if m < 2:
        return
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    varying = int(np.bitwise_or.reduce(fps ^ fps[begin[of]]))
    bits = np.array([b for b in range(64) if varying >> b & 1], np.int64)
    per = -(-size // 64)  # a bucket begins with a word of its own
    first_word = np.cumsum(per) - per
    slots = first_word[of] * 64 + np.arange(m) - begin[of]
    words = int(per.sum())
    at_slot = np.full(words * 64, -1, np.int64)
    at_slot[slots] = np.arange(m)
    planes = planes_of(fps, slots, words, bits)
    # a word before the fingerprint's own holds pairs seen already
    cells = first_word[of] + per[of] - slots // 64
    ends = np.cumsum(cells)
    lo = 0
    while lo < m:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
        n = cells[lo:hi]
        qi = np.repeat(np.arange(lo, hi), n)
        wi = np.repeat(slots[lo:hi] // 64, n) + np.arange(len(qi)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi
        f = fps[qi]
        c0 = np.zeros(len(qi), np.uint64)
        c1, over = c0.copy(), c0.copy()
        beyond = c0
        for i, b in enumerate(bits):
            d = planes[i][wi] ^ (np.uint64(0) - ((f >> np.uint64(b)) & np.uint64(1)))
            carry = c0 & d
            c0 ^= d
            over |= c1 & carry
            c1 ^= carry
            if i % step == step - 1 or i == len(bits) - 1:
                beyond = over | (c1 & c0 if radius == 2 else c1 if radius == 1 else np.uint64(0))
                live = beyond != _ONES
                if not live.all():
                    qi, wi, f, c0, c1, over, beyond = qi[live], wi[live], f[live], c0[live], c1[live], over[live], beyond[live]
                    if not len(qi):
                        break
        if not len(qi):
            continue
        inside = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, bit = np.nonzero(inside)
        i, j = qi[cell], at_slot[wi[cell] * 64 + bit]
        ok = j > i
        yield i[ok], j[ok]


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All close index pairs of one bucket."""
    got = list(close_chunks(fps, [len(fps)], radius))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(x[side] for x in got)]) for side in (0, 1))


def bucket_roots(fps: np.ndarray, sizes: list[int], radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the index of the first one of its bucket that close pairs lead to."""
    root = np.arange(len(fps))
    for i, j in close_chunks(fps, sizes, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def linked(held: list[np.ndarray]) -> pd.DataFrame:
        fps = np.concatenate(held)
        root = bucket_roots(fps.view(np.uint64), [len(x) for x in held])
        other = root != np.arange(len(fps))
        return pd.DataFrame({"a": fps[other], "b": fps[root[other]]})

    for b in batches:
        held, rows = [], 0
        for fps in b.fps:
            held.append(np.sort(np.asarray(fps, dtype=np.int64)))
            rows += len(fps)
            if rows >= BATCH_ROWS:
                yield linked(held)
                held, rows = [], 0
        if held:
            yield linked(held)


def _keys(blocks: list[tuple[int, int]], width: int) -> Column:
    """For each choice of two blocks (shift, shift): its number and their bits."""
    mask = (1 << width) - 1
    part = lambda s: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(mask))
    return F.array(*[F.struct(F.lit(n).alias("t"), (F.shiftleft(part(s), width) + part(t)).alias("k")) for n, (s, t) in enumerate(blocks)])


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) fingerprints that connect all within the radius. ``distinct``: column fp, each once."""
    keyed = distinct.select("fp", F.explode(_keys([(16 * i, 16 * j) for i, j in _PAIRS], 16)).alias("x")).select("fp", "x.t", "x.k")
    sizes = materialize(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    shared = materialize(spread_join(keyed, sizes, ["t", "k"], hot_keys(sizes, ["t", "k"], "n"), ["fp"], "inner"), "buckets")
    cool = shared.filter(F.col("n") <= bucket_rows).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    # hot buckets: the two blocks outside the key are 32 bits, dealt again by two of their four bytes
    hot = shared.filter(F.col("n") > bucket_rows)
    fine = F.lit(None)
    for n, (i, j) in reversed(list(enumerate(_PAIRS))):
        rest = [16 * b + h for b in range(4) if b not in (i, j) for h in (0, 8)]
        fine = F.when(F.col("t") == n, _keys([(rest[a], rest[b]) for a, b in _PAIRS], 8)).otherwise(fine)
    split = hot.select("fp", "t", "k", F.explode(fine).alias("y")).groupBy("t", "k", F.col("y.t").alias("t2"), F.col("y.k").alias("k2")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return cool.select("fps").unionByName(split.select("fps")).mapInPandas(_link_batches, "a long, b long")


def classes(prints: DataFrame) -> tuple[DataFrame, list[int]]:
    """fp, root, component_id of each distinct fingerprint, and the hashes of hot ones. ``prints``: doc_id, fp (stored, as it is read twice)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    # roots with one fingerprint need no join: their first id is the component's
    many = roots.select(F.col("root")).distinct()
    ids = rooted.join(many, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("least_id"))
    return rooted.join(ids, "root", "left").select("fp", "root", F.coalesce("least_id", "first_id").alias("component_id")), hot_keys(distinct, ["fp"], "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    prints = materialize(pick(docs, doc_id="long", text="string").select("doc_id", fingerprint_column(F.col("text")).alias("fp"), F.monotonically_increasing_id().alias("at")), "prints")
    found, hot = classes(prints)
    joined = spread_join(prints, found, ["fp"], hot, ["at"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; of each class the row with the smallest doc_id (one of repeated rows) stays."""
    doc_id = (F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long")
    marked = docs.select(whole(docs), doc_id.alias("doc_id"), fingerprint_column(text_of(docs)).alias("fp"))
    prints = materialize(marked.select("doc_id", "fp"), "prints")
    found, _ = classes(prints)
    # a class's row is known by its fingerprint and id, so whole rows never meet a hot fingerprint
    missing = F.col("doc_id").isNull()
    asked = found.select("fp", "root", F.col("component_id").alias("doc_id")).withColumn("missing", missing).fillna(0, "doc_id")
    return marked.withColumn("missing", missing).fillna(0, "doc_id").join(asked, ["fp", "doc_id", "missing"]).dropDuplicates(["root"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
