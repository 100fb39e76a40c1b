"""BPE encoding and decoding over a distinct-word table.

A text splits into words that the tokenizer treats apart: its own pre-tokens,
lower-cased, where all characters are plain ASCII or Latin-1 letters, else whole
runs between ASCII white space, encoded as they stand. Each distinct word is
encoded once and its ids are joined back by position:

* the ``FREQUENT`` most frequent words of a bounded sample (of at most
  ``FREQUENT_CHARS`` characters) are encoded once and broadcast with their ids;
* every other word of a document is a row (document, word); rows are dealt by
  word, each distinct word is encoded where its rows are, and (document, word,
  ids) rows meet the document's positions, kept as compact word numbers.

The sample takes documents by their place, not by what they hold, so it shows
copies in proportion. It only decides which way a word takes, and which long
words are hot: the rows of these are dealt over ``SALTS`` tasks, and such a word is
encoded in each. Results don't depend on it.

Decoding joins ids to pieces: the table of the vocabulary's pieces by id is
broadcast, each id of a row takes its piece, and a row's pieces are joined in order.

Defined results: a null or empty text, or one of white space, has no ids and
decodes to the empty text; very long texts and words are encoded whole; special tokens in a text become their ids; null
doc_ids stay null; repeated rows are rows, and rows with equal ids and texts share
the rows of their words; of words equally frequent in the sample all or none are
broadcast; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import HOT_PARTS, SALTS, materialize, most_frequent, pick, release, table

WORD_BPE = "word_bpe_49k.json"
FREQUENT = (1 << 18) - 1
FREQUENT_CHARS = 64
SAMPLE_DOCS = 20000
_RARE = FREQUENT
SLICE_ROWS = 256
CALL_WORDS = 4096

_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters that neither normalization nor lower-casing joins to their neighbours.
_UNSAFE = re.compile(rf"[^\x09-\x0D\x20-\x7E{_LETTERS}]|<\|")
# letters stand first as most words are of these; no other form begins with one
_WORD = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x20\x09-\x0Da-zß-öø-ÿ0-9]+")
_SAFE = bytes(i for i in range(256) if not _UNSAFE.search(chr(i)))


def safe(text: str) -> bool:
    """Whether ``_UNSAFE`` finds nothing, by the text's Latin-1 bytes at once."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, _SAFE) and b"<|" not in raw



def split_words(text: str | None) -> list[str]:
    """The words of a text in order; encoding them one by one encodes the text."""
    if not text:
        return []
    if safe(text):
        return _WORD.findall(text.lower())
    out: list[str] = []
    for run in _RUN.findall(text):
        if _UNSAFE.search(run):
            out.append(run)
        else:
            out += _WORD.findall(run.lower())
    return out


@functools.lru_cache(2)
def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encode(source: str, words: list[str]) -> list[list[int]]:
    t, out = _tokenizer(source), []
    for lo in range(0, len(words), CALL_WORDS):  # what a call returns is much larger than its ids
        out += [e.ids for e in t.encode_batch(words[lo : lo + CALL_WORDS], add_special_tokens=False)]
    return out


def vocabulary(source: str) -> list[str]:
    """Piece by id."""
    got = _tokenizer(source).get_vocab(with_added_tokens=True)
    out = [""] * (max(got.values()) + 1)
    for piece, i in got.items():
        out[i] = piece
    return out


def _key() -> list[Column]:
    """What a document's rows meet by. Documents that share it share the rows of their words, which changes nothing."""
    return [F.coalesce("doc_id", F.lit(0)).alias("id"), F.pmod(F.xxhash64("text"), F.lit(1 << 15)).cast("short").alias("part")]


@functools.lru_cache(2)
def _pieces(source: str) -> tuple[pa.Array, pa.Array]:
    """By id: its decimal form, and its piece."""
    pieces = vocabulary(source)
    return pa.array([str(i) for i in range(len(pieces))]), pa.array(pieces, pa.string())


def _join_pieces(ids: pa.ListArray, of: pa.Array) -> pa.Array:
    """Each list's ids joined to the table ``of`` and set in order, with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, of.take(ids.values)), " ")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what is made of them in Python stays small."""
    for b in batches:
        for lo in range(0, len(b), SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS)


def frequent_words(docs: DataFrame, source, most: int | None = None, sample: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """The most frequent words of about ``sample`` documents, the lengths of their ids, the ids end to end, and hashes of hot long words."""
    every = max(1, docs.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[str] = Counter()
            for part in _slices(iter([b])):
                for t in part.column("text").to_pylist():
                    c.update(split_words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array([np.array(i, "<u2").tobytes() for i in _encode(source.value, words)], pa.binary())], ["word", "n", "ids"])

    some = docs.select("text", F.monotonically_increasing_id().alias("at")).filter(F.pmod("at", F.lit(every)) == 0).select("text")
    counts = materialize(some.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    short = counts.filter(F.length("word") <= FREQUENT_CHARS)
    chosen = short.filter(F.col("n") >= most_frequent(short, "n", FREQUENT if most is None else most))
    got = chosen.mapInArrow(encode, "word string, n long, ids binary").toArrow()
    # numbered by frequency: small numbers in a row compress well
    got = got.sort_by([("n", "descending"), ("word", "ascending")])
    ids = [np.frombuffer(x, "<u2") for x in got.column("ids").to_pylist()]
    lengths = np.array([len(x) for x in ids], np.int64)
    # words that are never broadcast and may have more than a share of all rows
    hot = counts.filter((F.length("word") > FREQUENT_CHARS) & (F.col("n") * HOT_PARTS > min(sample, docs.count()))).orderBy(F.desc("n"), F.xxhash64("word")).limit(HOT_PARTS).select(F.xxhash64("word")).collect()
    return got.column("word").to_pylist(), lengths, np.concatenate([np.zeros(0, "<u2"), *ids]), [r[0] for r in hot]


_made: dict[str, object] = {}


def made(frequent, what: str, make):
    """What is made of the broadcast words: once in a worker process, which runs many tasks."""
    name = frequent.value[0]
    if _made.get("name") != name:
        _made.clear()
        _made["name"] = name
    got = _made.get(what)
    if got is None:
        got = _made[what] = make(frequent.value[1])
        release()
    return got


def _numbers(words: list[str]) -> dict[str, int]:
    return {w: i for i, w in enumerate(words)}


def _coded(docs: DataFrame, frequent) -> tuple[DataFrame, DataFrame]:
    """(id, part, word) rows of the words outside the frequent table; (id, part, doc_id, code) of each document."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made(frequent, "numbers", _numbers)
        for b in _slices(batches):
            at, words = [], []
            for row, t in enumerate(b.column("text").to_pylist()):
                rare = [w for w in set(split_words(t)) if w not in known]
                words += rare
                at += [row] * len(rare)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("part").take(at), pa.array(words, pa.string())], ["id", "part", "word"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made(frequent, "numbers", _numbers)
        for b in _slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                words = split_words(t)
                at = np.fromiter(map(known.get, words, repeat(_RARE)), np.uint32, len(words))
                rare = [words[i] for i in np.flatnonzero(at == _RARE).tolist()]
                # low halves, then high bytes (few words have one): each compresses better by itself
                out.append(zlib.compress(at.astype("<u2").tobytes() + (at >> 16).astype(np.uint8).tobytes() + " ".join(rare).encode("utf-8", "surrogatepass"), 1) + len(words).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("doc_id"), pa.array(out, pa.binary())], ["id", "part", "doc_id", "code"])

    d = docs.select(*_key(), "doc_id", "text")
    return d.select("id", "part", "text").mapInArrow(requests, "id long, part short, word string"), d.mapInArrow(codes, "id long, part short, doc_id long, code binary")


def _answers(requests: DataFrame, source, hot: list[int]) -> DataFrame:
    """(id, part, word, ids): each distinct word encoded where all its rows are, or its share of them if it is hot."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, bytes] = {}
        for b in batches:
            at, unique = pd.factorize(b.word)
            new = [w for w in unique if w not in last]
            last = {w: last[w] for w in unique if w in last} | {w: np.array(i, dtype="<u2").tobytes() for w, i in zip(new, _encode(source.value, new), strict=True)}
            ids = np.array([last[w] for w in unique] + [b""], dtype=object)[:-1]
            yield pd.DataFrame({"id": b.id, "part": b.part, "word": b.word, "ids": ids[at]})

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["word"]
    if hot:
        by.append(F.when(F.xxhash64("word").isin(hot), F.pmod(F.xxhash64("id", "part"), F.lit(SALTS))).otherwise(0))
    return requests.repartition(n, *by).sortWithinPartitions("word").mapInPandas(encode, "id long, part short, word string, ids binary")


def _joined(docs: DataFrame, path: str) -> tuple[DataFrame, object, object]:
    spark = docs.sparkSession
    source_text = tokenizer_source(path)
    if len(vocabulary(source_text)) > 65536:
        raise ValueError("ids are kept in two bytes: a vocabulary of at most 65,536 pieces")
    d = pick(docs, doc_id="long", text="string")
    source = spark.sparkContext.broadcast(source_text)
    words, lengths, flat, hot = frequent_words(d, source)
    frequent = spark.sparkContext.broadcast((uuid.uuid4().hex, words, lengths, flat))
    requests, codes = _coded(d, frequent)
    # a set: documents that share a key ask for a word more than once
    found = _answers(requests, source, hot).groupBy("id", "part").agg(F.collect_set(F.struct("word", "ids")).alias("found"))
    return codes.join(found, ["id", "part"], "left").select("doc_id", "code", "found"), frequent, source


def _words_of(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], dict[str, bytes]]]:
    """Of each row: its words' numbers, the words that have none (in order), and the ids of these."""
    found = part.column("found")
    sizes = found.value_lengths().fill_null(0).to_pylist()
    pairs = found.drop_null().flatten()
    words, ids = pairs.field(0).to_pylist(), pairs.field(1).to_pylist()
    lo = 0
    for code, size in zip(part.column("code").to_pylist(), sizes, strict=True):
        n, raw = int.from_bytes(code[-4:], "little"), zlib.decompress(code[:-4])
        at = np.frombuffer(raw, "<u2", n) + (np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32) << 16)
        rare = raw[3 * n :].decode("utf-8", "surrogatepass").split(" ") if len(raw) > 3 * n else []
        yield at, rare, dict(zip(words[lo : lo + size], ids[lo : lo + size], strict=True))
        lo += size


def _ids_of(at: np.ndarray, rare: list[str], own: dict[str, bytes], lengths: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row's ids: those of its numbered words and its other words, by position."""
    other = at == _RARE
    mine = [np.frombuffer(own[w], "<u2").astype(np.int32) for w in rare]
    n = np.zeros(len(at), np.int64)
    n[~other] = lengths[at[~other]]
    n[other] = [len(x) for x in mine]
    ends = np.cumsum(n)
    out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
    usual = np.repeat(~other, n)
    # place in the words' own ids of each id of a numbered word
    src = np.repeat(np.where(other, 0, begin[np.where(other, 0, at)]) - (ends - n), n) + np.arange(len(out))
    out[usual] = flat[src[usual]]
    if mine:
        out[~usual] = np.concatenate(mine)
    return out


def _row_ids(part: pa.RecordBatch, frequent) -> pa.ListArray:
    """The ids of each row of codes."""
    _, _, lengths, flat = frequent.value
    lengths = np.append(lengths, 0)
    begin = np.cumsum(lengths) - lengths
    return _lists([_ids_of(*w, lengths, flat, begin) for w in _words_of(part)])


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of each row."""
    joined, frequent, _ = _joined(docs, path or public_tokenizers.path(WORD_BPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _row_ids(part, frequent)], ["doc_id", "ids"])

    return joined.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the pieces that the ids join to, in order. Null ids decode to the empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(tokenizer_source(path or public_tokenizers.path(WORD_BPE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = _pieces(source.value)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _join_pieces(_lists([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()]), pieces)], ["doc_id", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids decode to) of each row."""
    joined, frequent, source = _joined(docs, path or public_tokenizers.path(WORD_BPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = _pieces(source.value)
        for part in _slices(batches):
            ids = _row_ids(part, frequent)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.value_lengths().cast(pa.int64()), ids, _join_pieces(ids, pieces)], ["doc_id", "n_tokens", "ids", "decoded"])

    return joined.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, encoded and decoded in one pass."""
    joined, frequent, source = _joined(docs, path or public_tokenizers.path(WORD_BPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _pieces(source.value)
        for part in _slices(batches):
            ids = _row_ids(part, frequent)
            sha = [pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in _join_pieces(ids, of).to_pylist()], pa.string()) for of in tables]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.value_lengths().cast(pa.int64()), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
