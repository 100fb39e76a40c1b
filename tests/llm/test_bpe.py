import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import bpe


def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def expected(rows):
    t, out = library(), []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


def test_as_the_library_does(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(bpe.op4_bpe(spark, sf)) == expected([(r.doc_id, r.text) for r in d.collect()])


def test_trouble(docs):
    assert found(bpe.digests(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_rare_words_meet_by_join(docs, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT", 3)
    assert found(bpe.digests(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_copies_share_the_rows_of_their_words(spark, monkeypatch):
    """An id on many rows, and a long word in most of them: one entry for each word, and the word's rows are dealt."""
    monkeypatch.setattr(bpe, "FREQUENT", 3)
    rows = [(7, "x" * 80 + " and uncommon words")] * 600 + [(7, f"another text {i} " + "x" * 80) for i in range(40)] + [(None, "x" * 80)] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string")
    source = spark.sparkContext.broadcast(bpe.tokenizer_source(public_tokenizers.path(bpe.WORD_BPE)))
    words, lengths, flat, hot = bpe.frequent_words(d, source)
    assert len(words) == len(lengths) <= 3 and lengths.sum() == len(flat) and hot
    joined, _, _ = bpe._joined(d, public_tokenizers.path(bpe.WORD_BPE))
    assert max(len(r.found or []) for r in joined.collect()) < 10
    assert found(bpe.digests(d)) == expected(rows)


def test_round_trip(docs):
    t = library()
    both = bpe.encode_decode(docs).collect()
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()), key=repr)
    assert back == sorted(((r.doc_id, r.decoded) for r in both), key=repr)
    for r in both:
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids)


def test_empty_table(none):
    assert bpe.digests(none).collect() == []
