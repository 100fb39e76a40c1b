"""Language-model scores of whole documents, and a counted baseline.

Two passes over the documents, and two over what they are to the model:

* word counts of all training documents (each task counts, then words meet);
* encoding: of each document its symbols, what the counts alone say of its score,
  and its words beyond the frequent ones, written once;
* training: steps on every window of every training document, the same windows
  that scoring uses, so each id is learned from once. Tasks take steps on
  their own documents, and weights are averaged over tasks by windows seen,
  ``ROUNDS`` times over as many shares of the documents. Averages are taken in
  two levels, so at most ``GROUPS`` weight vectors reach the driver;
* scoring: symbols of each document run through overlapping windows, each
  scored once.

Words are split, and equal ones of a few documents found, by Arrow; Python sees each of these once.

Id counts, classes and the table of classes after classes come from the exact
word counts. The ``FREQUENT`` most frequent words (of at most ``FREQUENT_BYTES``)
are broadcast with their counts: those whose count is at least the lowest that
keeps within that number. Every other word of a document is a row
that meets its count by a join; where such a word (a very long one) is hot, its rows
are dealt over many tasks.

The model knows the ``attention.SYMBOLS`` - 1 most frequent subword ids apart; all
others are one symbol to it, and share that symbol's probability by their counts.

Defined results: a null or empty text is the end token alone; very long texts are
scored whole, and a word over ``WORD_CHARS`` characters is encoded in pieces; null doc_ids count
as the empty text in the split; with nothing to learn from the model is its
smoothed table; of equally frequent words all or none are broadcast; repeated rows are scored each (and learned from each); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import attention as A
from quillon.llm.common import bucket, hot_keys, materialize, most_frequent, pick, release, spread_join, table

RANKS = "byte_bpe_multi_50k.tiktoken"
FREQUENT = 262_144
FREQUENT_BYTES = 64
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 400_000
ROUNDS = 3
GROUPS = 32
#: Documents whose windows are mixed with one another.
DOCS = 128
#: Text whose words are counted, or encoded, together (or one document).
COUNT_BYTES = 1 << 23
ENCODE_BYTES = 1 << 21
#: Symbols as they are stored.
STORED = np.dtype("<u2")
#: A longer word is encoded in pieces.
WORD_CHARS = 4096
#: Words that one call encodes.
CALL_WORDS = 4096
#: The document end, as a word: no word is empty.
END = b""


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of documents, the words as numbers of these, and where each document begins, and the length. ``END`` ends each."""
    texts = texts.cast(pa.binary()).fill_null(END).view(pa.string())  # the bytes of A-Z and ASCII white space alone are looked at
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = split.flatten().dictionary_encode()
    # by way of numpy, as to_pylist makes an Arrow scalar of each
    words, codes = found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False)
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if END in words:  # before white space that begins a text, and behind what ends it
        end = words.index(END)
        kept = codes != end
        size = np.bincount(np.repeat(np.arange(len(size)), size)[kept], minlength=len(size))
        codes = codes[kept]
    else:
        end = len(words)
        words.append(END)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(starts[-1], end, np.int64)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = codes
    return words, out, starts


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_ids(encoding, word: bytes) -> list[int]:
    """Subword ids of a word after a space; the end is the first id that the vocabulary doesn't use."""
    if not word:
        return [encoding.n_vocab]
    text = " " + word.decode("utf-8", "replace")
    if len(text) <= WORD_CHARS:
        return encoding.encode_ordinary(text)
    return [i for at in range(0, len(text), WORD_CHARS) for i in encoding.encode_ordinary(text[at : at + WORD_CHARS])]


@functools.lru_cache(2)
def _opens(ranks: bytes) -> np.ndarray:
    """Whether an id's piece begins with a space."""
    out = np.zeros(_encoding(ranks).n_vocab + 1, bool)
    for line in ranks.splitlines():
        piece, i = line.split()
        out[int(i)] = base64.b64decode(piece)[:1] == b" "
    return out


class WordIds:
    """Subword ids of words. Those of the given words are found once."""

    def __init__(self, ranks: bytes, words: list[bytes]) -> None:
        self.known = {w: i for i, w in enumerate(words)}
        self.encoding, self.opens = _encoding(ranks), _opens(ranks)
        self.lengths, self.flat = self.encode(words)
        self.begin = np.cumsum(self.lengths) - self.lengths

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length and ids of each word. Many words are encoded in one call: a space begins each, and none is inside."""
        odd = {i: word_ids(self.encoding, w) for i, w in enumerate(words) if not 0 < len(w) <= WORD_CHARS}
        lengths = np.zeros(len(words), np.int64)
        plain = [w for w in words if 0 < len(w) <= WORD_CHARS]
        got = [np.array(self.encoding.encode_ordinary((b" " + b" ".join(plain[lo : lo + CALL_WORDS])).decode("utf-8", "replace")), np.int32) for lo in range(0, len(plain), CALL_WORDS)]
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        usual = np.array([i not in odd for i in range(len(words))], bool) if odd else np.ones(len(words), bool)
        lengths[usual] = np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
        for i, x in odd.items():
            lengths[i] = len(x)
        if odd:
            out = np.zeros(lengths.sum(), np.int32)
            out[np.repeat(usual, lengths)] = flat
            begin = np.cumsum(lengths) - lengths
            for i, x in odd.items():
                out[begin[i] : begin[i] + len(x)] = x
            flat = out
        return lengths, flat

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word among the given ones, or -1."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes], numbers: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that ``codes`` say, and where each word's begin (and the length). ``numbers`` are those of ``words``."""
        old, new = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        lengths, flat = self.encode(list(map(words.__getitem__, new.tolist())))
        n = self.lengths[numbers[old]]
        size, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[old], size[new] = n, lengths
        begin[old] = np.cumsum(n) - n
        begin[new] = n.sum() + np.cumsum(lengths) - lengths
        flat = np.concatenate([self.flat[_ranges(self.begin[numbers[old]], n)], flat])
        n = size[codes]
        return flat[_ranges(begin[codes], n)], np.concatenate([[0], np.cumsum(n)])


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``begin`` on, one range after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


_last: dict[str, WordIds] = {}


def _table(frequent, ranks) -> WordIds:
    """The broadcast words' table: made once in a worker process, which runs many tasks."""
    name, words, _ = frequent.value
    if name not in _last:
        _last.clear()
        _last[name] = WordIds(ranks.value, words)
    return _last[name]


def training(name: str = "doc_id") -> Column:
    return bucket(7, name) != 2


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: exact counts over ``docs``, the document end as the empty word. Written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for lo, hi in _parts(b.column(0), COUNT_BYTES):
                words, codes, _ = split_words(b.column(0)[lo:hi])
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
                if len(total) >= COUNT_WORDS:
                    yield out()
                    total = {}
        if total:
            yield out()
        total = {}
        release()

    rows = _texts(docs).select("text").mapInArrow(count, "word binary, n long")
    return materialize(rows.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


def _steps(counts: DataFrame, ranks) -> DataFrame:
    """a, b, n: ids next to each other within words; the end id stands for the borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = WordIds(ranks.value, [])
        end = at.encoding.n_vocab
        for b in batches:
            size, ids = at.encode(b.word.tolist())
            starts = np.concatenate([[0], np.cumsum(size)])
            weight = np.repeat(b.c.to_numpy(), size)
            before = np.concatenate([[end], ids[:-1]]).astype(np.int64)
            before[starts[:-1]] = end
            a = np.concatenate([before, ids[starts[1:] - 1]])
            z = np.concatenate([ids, np.full(len(b), end)]).astype(np.int64)
            n = np.concatenate([weight, b.c.to_numpy()])
            key, place = np.unique(a * (end + 1) + z, return_inverse=True)
            yield pd.DataFrame({"a": (key // (end + 1)).astype(np.int32), "b": (key % (end + 1)).astype(np.int32), "n": np.bincount(place, n, len(key)).astype(np.int64)})

    return counts.filter(F.octet_length("word") > 0).mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, ranks, end: int, n_docs: int) -> A.Vocabulary:
    steps = materialize(_steps(counts, ranks), "steps")
    size = end + 1
    got = steps.filter(F.col("b") != end).groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    n = np.zeros(size)
    n[got.b.to_numpy(np.int64)] = got.n
    n[end] = n_docs
    # steps between the ids that matter: a bound of SYMBOLS x SYMBOLS, whatever the corpus
    top = sorted(range(end), key=lambda i: (-n[i], i))[: A.SYMBOLS - 1]
    known = counts.sparkSession.createDataFrame(pd.DataFrame({"id": [*map(int, top), end]}), "id int")
    kept = steps.join(F.broadcast(known.select(F.col("id").alias("a"))), "a").join(F.broadcast(known.select(F.col("id").alias("b"))), "b").select("a", "b", "n").toPandas()
    return A.vocabulary(size, n, tuple(kept[c].to_numpy(np.int64) for c in ("a", "b", "n")))


def encode(docs: DataFrame, vocabulary, frequent, ranks, unit: float, rounds: int) -> DataFrame:
    """Of each row: row, doc_id, share (of the training documents; -1: held out), n_tokens, found and base (of frequent words), fixed, symbols, rare words. Written once."""
    have = [F.col(f"`{x}`") for x in ("doc_id", "text") if x in docs.columns]
    learn = training() if "doc_id" in docs.columns else F.lit(True)
    share = F.when(learn, F.pmod(F.xxhash64(*have), F.lit(max(rounds, 1))).cast("int")).otherwise(-1)
    texts = pick(docs.select(*have, share.alias("share")), doc_id="long", share="int", text="string").withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = _table(frequent, ranks), vocabulary.value
        logs = np.append(np.log10(frequent.value[2] + 1.0) - unit, 0.0)  # the last is that of a word beyond
        for b in batches:
            for lo, hi in _parts(b.column("text"), ENCODE_BYTES):
                part = b.slice(lo, hi - lo)
                words, codes, starts = split_words(part.column("text"))
                numbers = table.numbers(words)
                ids, at = table.ids(words, numbers, codes)
                doc = np.repeat(np.arange(len(part)), np.diff(starts))
                often = (numbers >= 0)[codes]
                base = np.bincount(doc, logs[numbers][codes], len(part))
                found = np.bincount(doc[often], minlength=len(part))
                pair, tf = np.unique(doc[~often] * len(words) + codes[~often], return_counts=True)
                of, which = pair // len(words), pair % len(words)
                offsets = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(list(map(words.__getitem__, which.tolist())), pa.binary()), pa.array(tf, pa.int64())], ["word", "tf"]))
                begin = at[starts]
                symbols = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((begin * STORED.itemsize).astype(np.int32)), pa.py_buffer(v.symbol_of[ids].astype(STORED))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("share"), pa.array(np.diff(starts)), pa.array(found), pa.array(base), pa.array(v.fixed(ids, begin)), symbols, rare],
                    ["doc_id", "share", "n_tokens", "found", "base", "fixed", "symbols", "rare"],
                )
        release()

    rows = texts.mapInArrow(run, "doc_id long, share int, n_tokens long, found long, base double, fixed double, symbols binary, rare array<struct<word:binary,tf:long>>")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of documents one after the other, and where each begins, and the length."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // STORED.itemsize
    return np.frombuffer(data, STORED)[at[0] : at[-1]], at - at[0]


def train_round(rows: DataFrame, vocabulary, flat: np.ndarray, rate: float = A.RATE) -> np.ndarray:
    """Weights after a pass over all windows of the encoded ``rows``: the tasks' averages, by windows seen."""
    start = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, part = None, 0
        for b in batches:
            for lo in range(0, len(b), DOCS):
                some = b.slice(lo, DOCS)
                if trainer is None:
                    part = some.column("part")[0].as_py()
                    trainer = A.Trainer(vocabulary.value, start.value, rate, part)
                trainer.symbols(*_symbols(some.column("symbols")))
        if trainer is not None and trainer.seen:
            trainer.step()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([trainer.seen], pa.int64()), "w": pa.array([trainer.p.flat.tobytes()], pa.binary())})

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(start.value)), 0
        for b in batches:
            for k, w in zip(b.n, b.w, strict=True):
                total += np.frombuffer(w, np.float32) * float(k)
                n += k
        if n:
            yield pd.DataFrame({"n": [n], "w": [(total / n).astype(np.float32).tobytes()]})

    local = rows.select("symbols", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, n long, w binary")
    # written first: training is not repeated when an executor is lost
    got = materialize(local, "weights").repartition(GROUPS, "part").sortWithinPartitions("part").mapInPandas(average, "n long, w binary").collect()
    if not got:
        return flat
    n = np.array([float(r["n"]) for r in got])
    return (np.stack([np.frombuffer(bytes(r["w"]), np.float32) for r in got]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)


def score(docs: DataFrame, ranks_path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. Without ``rounds`` the model is its counted table."""
    spark = docs.sparkSession
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    end = _encoding(ranks.value).n_vocab
    learn = docs.filter(training()) if "doc_id" in docs.columns else docs
    counts = count_words(learn)
    n, v, n_docs = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.octet_length("word") == 0, F.col("c")))).first())
    unit = math.log10(n + v + 1) if n else 0.0
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    least = most_frequent(short, "c", FREQUENT)
    top = short.filter(F.col("c") >= least).toArrow().sort_by([("c", "descending")])  # the words that are looked up most lie together
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    frequent = spark.sparkContext.broadcast((uuid.uuid4().hex, words, c))
    vocabulary = learn_vocabulary(counts, ranks, end, n_docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = encode(docs, shared, frequent, ranks, unit, rounds)
    flat = A.Parameters(vocabulary.symbols).flat
    for r in range(rounds):
        flat = train_round(encoded.filter(F.col("share") == r), shared, flat, A.RATE * (1 - r / rounds))
    weights = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = A.Scorer(shared.value, weights.value)
        for b in batches:
            for lo in range(0, len(b), DOCS):
                part = b.slice(lo, DOCS)
                lp = model.symbols(*_symbols(part.column("symbols"))) + part.column("fixed").to_numpy()
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(lp / math.log(10))], [*kept, "score"])

    kept = ["row", "doc_id", "n_tokens", "found", "base"]
    rows = encoded.select(*kept, "fixed", "symbols").mapInArrow(run, "row long, doc_id long, n_tokens long, found long, base double, score double")
    rows = materialize(rows, "scored")
    asked = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tf")
    # words of the broadcast table are asked for by no row; a word may be hot only if it is long
    rest = counts.filter((F.col("c") < least) | (F.octet_length("word") > FREQUENT_BYTES))
    met = spread_join(asked, rest, ["word"], hot_keys(rest, ["word"], "c"), ["row"]).groupBy("row").agg(F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - unit)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_found"))
    return rows.join(met, "row", "left").select(
        "doc_id", (~training()).alias("held_out"), "n_tokens", (F.col("found") + F.coalesce("more_found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
