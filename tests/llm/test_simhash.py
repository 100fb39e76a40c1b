import random

import numpy as np
import xxhash

from quillon.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints):
    """Component by doc: smallest id reachable."""
    parent = {i: i for i in range(len(prints))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(prints)), key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert found(simhash.op5_simhash(spark, sf)) == slow_classes([(r.doc_id, slow_print(r.text)) for r in rows])


def test_trouble(docs, none):
    assert found(simhash.near_duplicates(docs)) == slow_classes([(r.doc_id, slow_print(r.text)) for r in docs.collect()])
    assert simhash.near_duplicates(none).collect() == []


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {(c, f) for _, f, c in found(simhash.near_duplicates(docs))}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c in {c for c, _ in classes} if c is not None)


def test_close_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_ = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)})
    for radius in (1, 2, 3):
        i, j = simhash.close_pairs(np.array(all_, dtype=np.uint64), radius)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(len(all_)) for b in range(a + 1, len(all_)) if (all_[a] ^ all_[b]).bit_count() <= radius]


def test_small_buckets_go_the_same_way(monkeypatch):
    """Buckets of two and three are compared by the bit-sliced counters too, many at once."""
    rng = random.Random(7)
    buckets, want = [], []
    for _ in range(300):
        base = rng.getrandbits(64)
        buckets.append(sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for _ in range(rng.randint(1, 5))} | {rng.getrandbits(64) for _ in range(rng.choice((0, 0, 70)))}))
    fps, calls, real = np.array([x for b in buckets for x in b], dtype=np.uint64), [], simhash.close_chunks
    monkeypatch.setattr(simhash, "close_chunks", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(simhash, "CELLS", 500)
    root = simhash.bucket_roots(fps, [len(b) for b in buckets])
    assert calls
    at = 0
    for b in buckets:
        lead = list(range(len(b)))
        for _ in b:
            for i in range(len(b)):
                for j in range(len(b)):
                    if (b[i] ^ b[j]).bit_count() <= 2:
                        lead[i] = min(lead[i], lead[j])
        want += [at + x for x in lead]
        at += len(b)
    assert root.tolist() == want


def test_hot_fingerprint(spark):
    """Most rows share a fingerprint: their join is spread, and the classes stay whole."""
    texts = ["same words over and over"] * 500 + [f"text number {i} is another one" for i in range(50)] + [None] * 200
    d = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert found(simhash.near_duplicates(d)) == slow_classes([(r.doc_id, slow_print(r.text)) for r in d.collect()])


def test_hot_buckets_are_dealt_again(spark):
    rng = random.Random(6)
    fixed = rng.getrandbits(64)
    fps = sorted({(fixed & ~0xFFFFFFFF | rng.getrandbits(10) << 7 | rng.getrandbits(3)) & (1 << 64) - 1 for _ in range(600)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")

    def of(bucket_rows):
        links = simhash.components(simhash.links(prints.select("fp"), bucket_rows))
        return sorted(map(tuple, links.collect()))

    assert of(8) == of(1 << 20)
