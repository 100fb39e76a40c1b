import zlib

import numpy as np

from quillon.llm import quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    n1 = sum(y)
    return (sum(r for r, k in zip(ranks, y, strict=True) if k) - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op1_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(y[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in y]
    assert auc(*zip(*held, strict=True)) > 0.85


def test_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == (y > 0)).mean() > 0.9  # a pure interaction: the pairs find it
    by_hand = m.bias
    for j, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)):
        by_hand += t[np.searchsorted(e, x[7, j], side="right")]
    for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
        by_hand += t[np.searchsorted(m.pair_edges[a], x[7, a], side="right"), np.searchsorted(m.pair_edges[b], x[7, b], side="right")]
    assert abs(1 / (1 + np.exp(-by_hand)) - m.score(x[7:8])[0]) < 1e-12


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(tuple, quality.scores(docs, quality.train(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_trouble(docs, labels, none):
    rows = quality.scores(docs, quality.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.scores(none, quality.train(none, labels)).collect() == []
    unlabelled = quality.scores(docs, quality.train(docs, labels.limit(0))).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_trees_take_the_best_cuts():
    """A tree of two leaves, and one of a pair of features, against all cuts tried one by one."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        g, h = rng.normal(size=9), rng.uniform(0.2, 3, 9)
        gain = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
        best = max(((gain(g[:i], h[:i]) + gain(g[i:], h[i:]), i) for i in range(1, 9) if h[:i].sum() >= 1 and h[i:].sum() >= 1), default=None)
        if best is None or best[0] - gain(g, h) <= 1e-9:
            continue
        i = best[1]
        want = np.r_[np.full(i, g[:i].sum() / (h[:i].sum() + 1)), np.full(9 - i, g[i:].sum() / (h[i:].sum() + 1))]
        assert np.allclose(quality._tree(g, h, 2), want)
    for _ in range(60):
        g, h = rng.normal(size=(4, 5)), rng.uniform(0.2, 3, (4, 5))
        parts = lambda i, j: [np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:]]
        i, j = max(((sum(g[s].sum() ** 2 / (h[s].sum() + 5) for s in parts(i, j)), i, j) for i in range(1, 4) for j in range(1, 5)))[1:]
        want = np.empty((4, 5))
        for s in parts(i, j):
            want[s] = g[s].sum() / (h[s].sum() + 5)
        assert np.allclose(quality._pair_tree(g, h)[0], want)


def test_boosting_learns_an_interaction():
    """Labels that only a pair of features tells: the pair tables find it, the features' own tables can't."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0) == (x[:, 8] > 0)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    m.pair_tables = [t * 0 for t in m.pair_tables]
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.7
