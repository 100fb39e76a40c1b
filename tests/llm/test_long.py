"""One document of 2,000,000 characters among short ones: read whole, by every operator that reads texts."""

import random

import pytest

from quillon.llm import bpe, minhash, mixing, packing, quality, rules, simhash


@pytest.fixture(scope="module")
def text():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    return " ".join(rng.choice(words) for _ in range(310_000)) + " last"


@pytest.fixture(scope="module")
def long_docs(spark, text):
    return spark.createDataFrame([(1, text, "en", "a"), (2, "a short text", "en", "a")], "doc_id long, text string, lang string, source string")


def test_plain_functions(text):
    assert len(text) > 2_000_000
    words = text.encode().split()
    assert len(minhash.shingles(text)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert simhash.fingerprint(text) != simhash.fingerprint(text[: len(text) // 2])
    x = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    assert x["distinct_words"] == len(set(words)) / len(words)
    assert mixing.words_and_topic(text) == (len(words), "long") and mixing.words_and_topic(text + " License")[1] == "legal"


def test_rules(spark, long_docs, text):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    r = {x.doc_id: x for x in rules.verdicts(long_docs, labels).collect()}[1]
    assert r.n_words == len(text.split()) and r.word_chars == len(text.replace(" ", "")) and r.kept


def test_bpe(long_docs, text):
    both = {r.doc_id: r for r in bpe.encode_decode(long_docs).collect()}
    # lower case and one space after each piece: without them the texts are the same
    assert both[1].decoded.replace(" ", "").replace("</w>", "") == text.replace(" ", "") and both[1].n_tokens == len(both[1].ids)


def test_packing(long_docs, text):
    rows = [r for r in packing.segments(packing.pack(long_docs)).collect() if r.doc_id == 1]
    assert [r.part for r in sorted(rows, key=lambda r: r.part)] == list(range(len(rows))) and len(rows) > 100
