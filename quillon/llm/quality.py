"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a few numeric features. Shallow trees, boosted in turn over
the features and then over chosen pairs, add up to lookup tables: one by the
bins of each feature, one by the bins of each pair. A score is the logistic of a
sum of table entries, added for a batch at once.

Labels are learned from at most ``TRAIN_ROWS`` labelled documents that a hash of
the id picks (the documented bound of the classifier's sample), none of them
held out. The id, language, source and labels never enter a score.

Defined results: a null or empty text has the features of no words and gets a
score like any other; labels that are null or not 0 or 1 are ignored, a document
with both labels counts by its mean (0.5: as 1), an id with several texts by the one
with the least hash; with no labels at all every
score is 0.5; a score of exactly 0.5 predicts 1; null doc_ids stay null and are not held out of scoring; very long
texts are read whole; repeated
rows get equal scores; an empty table gives no rows; other columns are ignored,
and ``keep_good`` keeps them, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bucket, pick, table, text_of, whole

TRAIN_ROWS = 40_000
BINS = 64
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 400
LEAVES = 4
RATE = 0.08
PATIENCE = 40

FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_sd", "upper", "digits", "symbols", "exclaims", "pipes", "commas", "stops", "high_bytes",
    "distinct_words", "top_word", "same_next", "title_words", "upper_words", "symbol_words", "lines_per_word", "dup_lines", "short_words", "long_words", "compression", "digit_words", "distinct_pairs", "once_words", "at_signs", "other_punct",
)

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "!?", "|", ",;:", ".", "@", "\"'()[]{}/\\_=+~^`-"], 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 10


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / size
    lengths = np.array([len(w) for w in words])
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    title = upper = symbol = digit = 0
    for w, k in counts.items():
        if w[0] < 128 and w[:1].isupper():
            title += k
            if len(w) > 1 and w.isupper():
                upper += k
        x = w[-1]
        if _CLASS[x] == 3 or _CLASS[w[0]] == 3 or x == 124:
            symbol += k
        if 48 <= w[0] <= 57:
            digit += k
    packed = len(zlib.compress(raw, 1)) / (size + 32)
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), c[1], c[2], c[3], c[4], c[5], c[6], c[7], c[10],
        len(counts) / n, max(counts.values()) / n, same / n, title / n, upper / n, symbol / n, len(lines) / n, 1 - len(set(lines)) / len(lines),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), packed, digit / n, (pairs + 1) / n, sum(k == 1 for k in counts.values()) / n, c[8], c[9],
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Bin additions for all rows at once."""
        total = np.full(len(x), self.bias)
        if not self.edges:
            return 1 / (1 + np.exp(-total))
        for j, (edges, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Best-first splits of one feature's bins: the value of each bin."""
    cuts = [(0, len(g))]
    cg, ch = np.concatenate([[0.0], g.cumsum()]), np.concatenate([[0.0], h.cumsum()])

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        at = np.arange(lo + 1, hi)
        gl, hl, gr, hr = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1)
        gain[(hl < 1) | (hr < 1)] = 0
        i = int(gain.argmax())
        return float(gain[i]), int(at[i])

    found = {c: best(*c) for c in cuts}
    while len(found) < leaves:
        c, (gain, at) = max(found.items(), key=lambda x: x[1][0])
        if gain <= 1e-9:
            break
        del found[c]
        for part in ((c[0], at), (at, c[1])):
            found[part] = best(*part)
    out = np.zeros(len(g))
    for lo, hi in found:
        out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut of each axis at the best place: four values over the (a, b) bins, and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((tg - sum(p[0] for p in parts), th - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 5.0) for x, y in parts) - tg**2 / (th + 5.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for s, (x, y) in zip((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), parts, strict=True):
        out[s] = x[i, j] / (y[i, j] + 5.0)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """Cyclic boosting; a fifth of the rows stops it."""
    if not len(y):
        return Model()
    p = (y.sum() + 1) / (len(y) + 2)
    m = Model(bias=float(np.log(p / (1 - p))))
    if len(y) < 20 or y.min() == y.max():
        return m if len(y) else Model()
    rng = np.random.default_rng(seed)
    stop = rng.random(len(y)) < 0.2
    go = ~stop
    d = x.shape[1]
    m.edges = [_edges(x[go][:, j], BINS) for j in range(d)]
    m.pair_edges = [_edges(x[go][:, j], PAIR_BINS) for j in range(d)]
    bins = [np.searchsorted(m.edges[j], x[:, j], side="right") for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    f = np.full(len(y), m.bias)
    prob = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    loss = lambda v: float(np.logaddexp(0, np.where(y[stop] > 0, -v[stop], v[stop])).mean())

    def boost(step, state) -> None:
        nonlocal f
        best, kept, kept_f, since = loss(f), [t.copy() for t in state], f.copy(), 0
        for _ in range(ROUNDS):
            step()
            now = loss(f)
            if now < best - 1e-6:
                best, kept, kept_f, since = now, [t.copy() for t in state], f.copy(), 0
            else:
                since += 1
                if since > PATIENCE:
                    break
        for t, k in zip(state, kept, strict=True):
            t[...] = k
        f = kept_f

    def mains() -> None:
        for j in range(d):
            q = prob(f[go])
            size = len(m.tables[j])
            t = RATE * _tree(np.bincount(bins[j][go], y[go] - q, size), np.bincount(bins[j][go], q * (1 - q), size))
            m.tables[j] += t
            f[...] += t[bins[j]]

    boost(mains, m.tables)
    coarse = [np.searchsorted(m.pair_edges[j], x[:, j], side="right") for j in range(d)]
    shape = lambda a, b: (len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)
    q = prob(f[go])
    g, h = y[go] - q, q * (1 - q)

    def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = shape(a, b)
        at = coarse[a][go] * s[1] + coarse[b][go]
        return np.bincount(at, g, s[0] * s[1]).reshape(s), np.bincount(at, h, s[0] * s[1]).reshape(s)

    gains = sorted(((_pair_tree(*grids(a, b, g, h))[1], a, b) for a in range(d) for b in range(a)), reverse=True)
    m.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    m.pair_tables = [np.zeros(shape(a, b)) for a, b in m.pairs]

    def interactions() -> None:
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            q = prob(f[go])
            step = RATE * _pair_tree(*grids(a, b, y[go] - q, q * (1 - q)))[0]
            t += step
            f[...] += step[coarse[a], coarse[b]]

    boost(interactions, m.pair_tables)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out: Column | None = None) -> Model:
    """Learn ``labels.quality`` from at most ``rows`` documents that are not held out."""
    held_out = bucket(3) == 1 if held_out is None else held_out
    y = pick(labels, doc_id="long", quality="int").filter("quality in (0, 1) and doc_id is not null").filter(~held_out)
    y = y.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # rows by a hash of the id: a bounded table, so it is broadcast to the documents
    some = y.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    joined = pick(docs, doc_id="long", text="string").join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")

    # an id counts once, by the text with the least hash: copies cost no features
    joined = joined.withColumn("h", F.xxhash64("text", F.lit(5))).groupBy("doc_id").agg(F.min_by("text", F.struct("h", "text")).alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "x": [r.tobytes() for r in feature_matrix(b.text)]})

    got = joined.mapInPandas(run, "doc_id long, y int, x binary").orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], dtype=np.float64))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(feature_matrix(s)))

    return score(text)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    d = pick(docs, doc_id="long", text="string")
    return d.select("doc_id", (bucket(3) == 1).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with its columns."""
    model = train(docs, labels)
    d = docs.select(whole(docs), score_column(docs.sparkSession, model, text_of(docs)).alias("score"))
    return d.filter(F.col("score") >= 0.5).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
