from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from quillon.llm import bpe, minhash, mixing, quality, rules  # noqa: E402


def survivors(docs):
    """Brute force: the smallest id of each class of texts at a 5-word Jaccard similarity of 0.8 or more."""
    rows = sorted((r.doc_id, set(minhash.shingles(r.text).tolist())) for r in docs.select("doc_id", "text").collect())
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                lead[y] = x
    return Counter(rows[i][0] for i in range(len(rows)) if root(i) == i)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    want = [
        lambda d: Counter(r.doc_id for r in quality.scores(d, quality.train(d, labels)).collect() if r.score >= 0.5),
        lambda d: Counter(r.doc_id for r in rules.verdicts(d, labels).collect() if r.kept),
        survivors,
        lambda d: +Counter({r.doc_id: r.copies for r in mixing.report(d).collect()}),
        ids,
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert ids(out) == want[k](docs), name
        assert out.count() > 0
        if k < 4:
            assert out.columns == names
            docs = out
    one = {r.doc_id: r for r in out.collect()}
    plain = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert all(list(one[i].ids) == list(plain[i]) for i in one)
    again = {r.doc_id: (r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert again == {i: (r.n_tokens, r.decoded) for i, r in one.items()}


def test_trouble(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for d in (docs, none):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            # mixing repeats rows of rare classes; every other stage only takes away
            assert out.count() <= (sum(r.copies for r in mixing.report(d).collect()) if name == "mixing" else d.count()), name
            if k < 4:
                assert out.columns == d.columns
