"""Token ids, packed by best-fit decreasing and written as binary matrices.

Each task tokenizes its documents, ends each with the separator id, cuts those
longer than a row into row-long parts and a rest (lossless), and packs a buffer
of at most ``BUFFER_TOKENS`` at a time: longest first, each into the open row
with the least room that still holds it. A segment tree over the possible rooms
finds that row in log2(capacity) steps. No shuffle is needed, a hot source is
only more buffers, and memory is bounded by the buffer and the longest document.

What is written is a table of rows: the id matrix row (little-endian uint16,
padded with the separator), cumulative segment lengths, and the offsets where
positions restart at 0.

A long text is tokenized in pieces of about ``CALL_CHARS`` characters, cut only
between a letter and what is no letter: no pre-token of the vocabulary crosses
such a place, on one line or many, so the ids are those of the whole text. Only
a word longer than that goes in one call.

Defined results: a null or empty text is one segment that holds the separator
alone; null doc_ids stay null; repeated rows are packed each; of equal lengths
the earlier document goes first, of rows with equal room the last that got it; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, pick, table

BYTE_BPE = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
BUFFER_TOKENS = 1 << 22
#: The first free id of the vocabulary: ends documents and pads rows.
SEPARATOR = 50256
#: A longer text is tokenized in pieces: what one call may hold.
CALL_CHARS = 1 << 20

_SCHEMA = "shard int, row long, n_tokens int, n_segments int, doc_ids array<string>, parts array<int>, cu_seqlens array<int>, resets array<int>, ids binary"


class RoomTree:
    """Rows by free room: the least room of at least so much that some row has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.most = [-1] * (2 * self.size)  # largest room with a row in each subtree
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _update(self, room: int, value: int) -> None:
        i = self.size + room
        self.most[i] = value
        i //= 2
        while i:
            a, b = self.most[2 * i], self.most[2 * i + 1]
            self.most[i] = b if b > a else a
            i //= 2

    def add(self, room: int, row: int) -> None:
        if not self.rows[room]:
            self._update(room, room)
        self.rows[room].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room >= need, removed; None if there is none."""
        if self.most[1] < need:
            return None
        i, low, width = 1, 0, self.size
        while i < self.size:
            width //= 2
            # rooms of the left half are low .. low + width - 1
            if self.most[2 * i] >= need:
                i = 2 * i
            else:
                i, low = 2 * i + 1, low + width
        row = self.rows[low].pop()
        if not self.rows[low]:
            self._update(low, -1)
        return low, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; no row's lengths sum to more than the capacity."""
    tree, rows = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        if not 0 < need <= capacity:
            raise ValueError(f"an item of {need} in rows of {capacity}")
        got = tree.take(need)
        if got is None:
            rows.append([])
            got = capacity, len(rows) - 1
        room, row = got
        rows[row].append(item)
        if room > need:
            tree.add(room - need, row)
    return rows


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def pieces(text: str, chars: int) -> Iterator[str]:
    """``text`` in pieces of ``chars`` characters or a little more, each cut after a letter and before a known character that is none."""
    at = 0
    while at < len(text):
        end = at + chars
        while end < len(text) and not (text[end - 1].isalpha() and not text[end].isalpha() and unicodedata.category(text[end]) != "Cn"):
            end += 1
        yield text[at:end]
        at = end


def token_ids(encoding, text: str | None) -> np.ndarray:
    parts = [np.array(encoding.encode_ordinary(p), dtype="<u2") for p in pieces(text or "", CALL_CHARS)]
    return np.concatenate([*parts, np.array([SEPARATOR], dtype="<u2")])


def _pack(items: list[tuple[str | None, int, np.ndarray]], capacity: int) -> list[tuple]:
    out = []
    for row in best_fit_decreasing([len(x[2]) for x in items], capacity):
        parts = [items[i] for i in row]
        ids = np.full(capacity, SEPARATOR, dtype="<u2")
        cu = np.cumsum([0, *(len(p[2]) for p in parts)])
        ids[: cu[-1]] = np.concatenate([p[2] for p in parts])
        out.append((int(cu[-1]), len(parts), [p[0] for p in parts], [p[1] for p in parts], cu.tolist(), cu[:-1].tolist(), ids.tobytes()))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """The packed rows (see ``_SCHEMA``; doc_ids as long)."""
    with open(path or public_tokenizers.path(BYTE_BPE), "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, items, held, n = _encoding(ranks.value), [], 0, 0
        shard = 0

        def flush() -> pd.DataFrame:
            nonlocal items, held, n
            rows = _pack(items, capacity)
            out = pd.DataFrame(rows, columns=["n_tokens", "n_segments", "doc_ids", "parts", "cu_seqlens", "resets", "ids"])
            out.insert(0, "row", range(n, n + len(rows)))
            out.insert(0, "shard", shard)
            items, held, n = [], 0, n + len(rows)
            return out

        for b in batches:
            for p, d, t in zip(b.shard, b.doc_id, b.text, strict=True):
                shard = p
                ids = token_ids(encoding, t)
                for part, i in enumerate(range(0, len(ids), capacity)):
                    items.append((None if pd.isna(d) else d, part, ids[i : i + capacity]))
                held += len(ids)
                if held >= buffer_tokens:
                    yield flush()
        if items:
            yield flush()

    d = pick(docs, doc_id="string", text="string").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    return d.mapInPandas(run, _SCHEMA).withColumn("doc_ids", F.expr("transform(doc_ids, x -> cast(x as long))"))


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """0, 1, 2 ... restarting at each segment; the padding is a segment of its own."""
    edges = np.array([*cu_seqlens, capacity] if cu_seqlens[-1] < capacity else cu_seqlens)
    return np.arange(capacity) - np.repeat(edges[:-1], np.diff(edges))


def segments(packed: DataFrame) -> DataFrame:
    """doc_id, part, shard, row, start, n_tokens, ids_sha256 of every segment, read from the matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard, row, docs, parts, cu, ids in zip(b.shard, b.row, b.doc_ids, b.parts, b.cu_seqlens, b.ids, strict=True):
                ids = np.frombuffer(ids, "<u2")
                for d, p, s, e in zip(docs, parts, cu[:-1], cu[1:], strict=True):
                    out.append((d, p, shard, row, s, e - s, hashlib.sha256(" ".join(map(str, ids[s:e].tolist())).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "part", "shard", "row", "start", "n_tokens", "ids_sha256"])

    cols = packed.select("shard", "row", F.expr("transform(doc_ids, x -> cast(x as string))").alias("doc_ids"), "parts", "cu_seqlens", "ids")
    return cols.mapInPandas(run, "doc_id string, part int, shard int, row long, start int, n_tokens int, ids_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(materialize(pack(table(spark, sf_dir, "documents")), "packed"))
