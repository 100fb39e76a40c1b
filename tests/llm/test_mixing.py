import numpy as np
from pyspark.sql import functions as F

from quillon.llm import mixing


def test_marginals_are_met(spark):
    """Raking against the same fit by dense arrays."""
    rng = np.random.default_rng(2)
    w = rng.integers(1, 90, size=(6, 3, 4)).astype(float) * (rng.random((6, 3, 4)) < 0.8)
    rows = [(f"s{i}", j, k, float(w[i, j, k])) for i in range(6) for j in range(3) for k in range(4) if w[i, j, k]]
    cells = spark.createDataFrame(rows, "source string, lang int, topic int, w double")
    t, fl, ft = mixing.rake(cells, 3, 4)
    total = w.sum()
    want = [(w.sum(axis) ** 0.7) / (w.sum(axis) ** 0.7).sum() for axis in ((1, 2), (0, 2), (0, 1))]
    raked = {r.source: r for r in t.collect()}
    scaled = w * fl[None, :, None] * ft[None, None, :]
    for i in range(6):
        r = raked[f"s{i}"]
        scaled[i] *= r.target / r.mass / scaled[i].sum()
    for got, x in zip((scaled.sum((1, 2)), scaled.sum((0, 2)), scaled.sum((0, 1))), want, strict=True):
        assert np.allclose(got, x, atol=1e-5)
    x = w / total
    for _ in range(500):
        x *= (want[0] / x.sum((1, 2)))[:, None, None]
        x *= (want[1] / x.sum((0, 2)))[None, :, None]
        x *= (want[2] / x.sum((0, 1)))[None, None, :]
    assert np.allclose(scaled, x, atol=1e-5)


def test_sample_has_the_share(spark):
    sf = "/root/testdata/sf0.01"
    r = mixing.op7_mixing(spark, sf)
    row = r.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))), F.max("probability"), F.min("probability"), F.count(F.lit(1))).first()
    total, expected, got, high, low, n = row
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert abs(expected / total - mixing.KEEP) < 0.005 and abs(got / total - mixing.KEEP) < 0.06 and 0 <= low <= high <= 1


def test_trouble(docs, none):
    r = mixing.report(docs).collect()
    assert len(r) == docs.count() and all(x.n_tokens >= 1 and 0 <= x.probability <= 1 for x in r)
    assert len({(x.probability, x.sampled) for x in r if x.doc_id == 5}) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs, keep=1.0).count() <= docs.count()
    assert mixing.report(none).collect() == []


def test_copies_meet_the_targets(spark):
    """Source, language and topic shares of the expected copies, and of what is drawn, against the flattened marginals."""
    rows = mixing.op7_mixing(spark, "/root/testdata/sf0.01").toPandas()
    total = rows.n_tokens.sum()
    assert abs((rows.n_tokens * rows.expected_copies).sum() / total - mixing.KEEP) < 1e-4
    assert (rows.expected_copies > 1).any() and ((rows.copies - rows.expected_copies).abs() < 1).all()
    lang = rows.lang.where(rows.lang.isin(mixing.LANGUAGES), "other")
    for by in (rows.source.fillna(""), lang, rows.topic):
        seen = rows.n_tokens.groupby(by).sum() ** mixing.TEMPERATURE
        got = (rows.n_tokens * rows.expected_copies).groupby(by).sum()
        drawn = (rows.n_tokens * rows.copies).groupby(by).sum()
        assert np.allclose(got / got.sum(), seen / seen.sum(), atol=1e-4)
        assert np.allclose(drawn / drawn.sum(), seen / seen.sum(), atol=0.05)


def test_repeats(docs):
    want = {r.doc_id: 0 for r in docs.collect()}
    for r in mixing.report(docs).collect():
        want[r.doc_id] += r.copies
    out = mixing.sample(docs, repeats=True)
    got = dict.fromkeys(want, 0)
    for r in out.collect():
        got[r.doc_id] += 1
    assert out.columns == docs.columns and got == want
