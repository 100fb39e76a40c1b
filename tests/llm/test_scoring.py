import math
import pickle
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import attention as A
from quillon.llm import scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def slow_base(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def check(rows, got):
    want = slow_base(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.score < 0 and math.isfinite(r.score)


def test_base_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = scoring.op3_scoring(spark, sf).collect()
    check(rows, got)
    # the trained model beats its counted table on documents that it hasn't seen
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    per = lambda rows: sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in held)
    table = scoring.score(spark.read.parquet(f"{sf}/documents.parquet"), rounds=0).collect()
    assert per(got) > per(table) + 0.2


def test_trouble(docs, none, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", 2)  # most words meet their counts by the join
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    check(rows, scoring.score(docs.filter("doc_id is not null")).collect())
    assert len(scoring.score(docs).collect()) == docs.count()
    assert scoring.score(none).collect() == []


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(8)
    size = 60
    counts = rng.integers(0, 50, size).astype(float)
    counts[size - 1] = 20
    a, b = np.divmod(np.arange(size * size), size)
    n = rng.integers(0, 9, size * size)
    keep = n > 0
    v = A.vocabulary(size, counts, (a[keep], b[keep], n[keep]))
    p = A.Parameters(v.symbols)
    p.flat += rng.normal(0, 0.2, len(p.flat)).astype(np.float32)
    return v, p


def test_probabilities_sum_to_one(small):
    v, p = small
    s = A.Scorer(v, p.flat)
    text = np.array([3, 9, 14, 2, 7, 7, 31] * 8, dtype=np.int32)
    for cut in (0, 5, 30, len(text)):
        prefix = text[:cut]
        before = s.documents(prefix, np.array([0, cut]))[0] if cut else 0.0
        total = sum(math.exp(s.documents(np.append(prefix, i).astype(np.int32), np.array([0, cut + 1]))[0] - before) for i in range(v.end + 1))
        assert abs(total - 1) < 1e-3


def test_each_id_once_whatever_the_batch(small):
    v, p = small
    s = A.Scorer(v, p.flat)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(0, v.end, n), v.end).astype(np.int32) for n in (0, 1, 23, 24, 25, 200, 3)]
    starts = np.cumsum([0, *map(len, docs)])
    together = s.documents(np.concatenate(docs), starts)
    alone = [s.documents(d, np.array([0, len(d)]))[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)
    # a place's score depends on nothing behind it
    d = docs[5]
    whole = np.array([0, len(d)])
    other = d.copy()
    other[150:] = docs[5][149::-1][: len(d) - 150]
    first = np.array([0, 150])
    assert np.isclose(s.documents(d[:150], first)[0], s.documents(other[:150], first)[0]) and s.documents(d, whole)[0] < s.documents(d[:150], first)[0]


def test_gradient(small):
    v, p = small
    rng = np.random.default_rng(2)
    symbol = rng.integers(0, 50, (3, A.WINDOW))
    target = rng.integers(-1, 20, (3, A.STRIDE))
    first = np.array([True, False, False])
    _, n, g = A.gradient(p, v.after, symbol, target, first)
    assert n == (target >= 0).sum()
    for i in [*rng.choice(np.flatnonzero(np.abs(g) > 1e-1), 12), len(g) - 5]:
        losses = []
        for step in (1e-2, -1e-2):
            q = A.Parameters(v.symbols, p.flat.copy())
            q.flat[i] += step
            losses.append(A.gradient(q, v.after, symbol, target, first)[0])
        assert abs((losses[0] - losses[1]) / 2e-2 - g[i]) < 5e-3 * max(1, abs(g[i])) + 5e-2


def test_training_sees_every_id_once(small, monkeypatch):
    v, p = small
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(0, v.end, n), v.end).astype(np.int32) for n in (0, 1, 23, 24, 25, 400, 3)]
    seen, real = [], A.gradient
    monkeypatch.setattr(A, "gradient", lambda p, after, symbol, target, first: seen.append(target[target >= 0]) or real(p, after, symbol, target, first))
    trainer = A.Trainer(v, p.flat, A.RATE, 0)
    trainer.documents(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    want = v.class_of[v.symbol_of[np.concatenate(docs)]]
    assert sorted(np.concatenate(seen).tolist()) == sorted(want.tolist())


def test_split_words():
    texts = [None, b"", b" \t\n\x0b\x0c\r ", bytes(range(256)), "Ä ÉCOLE  É\u00a0x\u2003y".encode(), b"\xff\xfe A a", b" lead The the", b"trail the ", b"one", b"x" * 9000]
    for column in (pa.array(texts, pa.binary()), pa.array([b"other", *texts], pa.binary())[1:]):
        words, codes, starts = scoring.split_words(column)
        assert len(set(words)) == len(words)
        for i, t in enumerate(texts):
            assert [words[c] for c in codes[starts[i] : starts[i + 1]]] == [*(t or b"").lower().split(), b""]
    assert scoring.split_words(pa.array([], pa.binary()))[2].tolist() == [0]


def test_training_reads_symbols_not_texts(docs, monkeypatch):
    seen, real = [], scoring.train_round
    monkeypatch.setattr(scoring, "train_round", lambda rows, *x: seen.append(rows) or real(rows, *x))
    scoring.score(docs)
    assert [("symbols" in r.columns, "text" in r.columns) for r in seen] == [(True, False)] * scoring.ROUNDS
    # each training document is in one share
    assert sum(r.count() for r in seen) == docs.filter(scoring.training()).count()


def test_gradient_keeps_its_memory(small):
    v, p = small
    rng = np.random.default_rng(4)
    q = A.Parameters(v.symbols, pickle.loads(pickle.dumps(p.flat)))  # as from a broadcast
    x = rng.integers(0, 50, (A.GRADIENT_WINDOWS, A.WINDOW)), rng.integers(-1, 20, (A.GRADIENT_WINDOWS, A.STRIDE)), rng.random(A.GRADIENT_WINDOWS) < 0.2
    first = A.gradient(q, v.after, *x)[2]
    kept = first.copy()
    tracemalloc.start()
    try:
        again = A.gradient(q, v.after, *x)[2]
        assert tracemalloc.get_traced_memory()[1] < q.flat.nbytes + 250_000
    finally:
        tracemalloc.stop()
    # numpy's fast way to add at places asks for this very type
    assert again.dtype is np.dtype(np.float32)
    A.gradient(p, v.after, x[0][:5], x[1][:5], x[2][:5])
    assert np.array_equal(first, kept) and np.array_equal(first, again)
