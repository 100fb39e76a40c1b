"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells (source, language, topic), weighted by words.
Raking scales the cells until their weights meet the source, language and topic
marginals. A document's expected copies are the wanted share times its cell's
factor, whatever the factor: that many whole copies, and one more by lot for the
rest, so the expected sample has both the share and the target marginals.

A sample without repeats cannot have both where a factor exceeds 1 / share. Its
probability is in proportion to the factor up to 1, at a rate set so that the
expected weight is the wanted share; what the clipped cells lose goes to others.

Languages and topics are named in the targets (others share one class), so a
source's cells are a vector of bounded length. Sources are rows of a table: a
hot source is summed before the shuffle, and no step needs all sources in one
place. An iteration is one aggregation to a (languages x topics) matrix. The
table of source factors is broadcast only where its counted rows are at most
``BROADCAST_SOURCES``, else it is joined by shuffle, hot sources dealt over many tasks.

Topics come from the text unless the caller names a column of them. Languages
outside ``LANGUAGES`` and topics outside ``TOPICS`` share a class each; both are parameters.

Defined results: a null source, language or text counts as a class of its own
(null text: no words); a document weighs at least 1; very long texts are read
whole; rows with equal ids and texts, repeated ones too, have equal lots and share their
fate; a class without weight has no target; an empty table gives no rows; the columns of a document, whatever their
names, are kept by ``sample``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import hot_keys, materialize, pick, spread_join, table, text_of, whole

#: Share of the weight that is kept, and the power that flattens observed marginals into targets.
KEEP = 0.8
TEMPERATURE = 0.7
LANGUAGES = ("en", "de", "fr", "es")
TOPICS = ("legal", "contact", "symbols", "short", "long", "prose")
ITERATIONS = 50
TOLERANCE = 1e-6
BROADCAST_SOURCES = 100_000
SEED = 20


_LEGAL = ("license", "licence", "copyright", "warrant")
_CONTACT = re.compile(r"[\w.]@[\w-]+\.\w")
_SYMBOLS = "#*$%&|<>{}[]=\\"


def words_and_topic(text: str | None) -> tuple[int, str]:
    """Words of a text, by runs of ASCII white space, and a coarse topic from what it holds."""
    text = text or ""
    words = len(text.encode("utf-8", "surrogatepass").split())  # of bytes: ASCII white space alone
    low = text.lower()
    if any(x in low for x in _LEGAL):
        return words, "legal"
    if "http://" in text or "https://" in text or ("@" in text and _CONTACT.search(text)):
        return words, "contact"
    if sum(map(text.count, _SYMBOLS)) * 50 > len(text):
        return words, "symbols"
    return words, "short" if words < 100 else "long" if words > 2000 else "prose"


def measured(text: Column) -> Column:
    @F.pandas_udf("words int, topic string")
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([words_and_topic(t) for t in s], columns=["words", "topic"])

    return of(text)


def with_cells(docs: DataFrame, langs: tuple[str, ...] = LANGUAGES, topics: tuple[str, ...] = TOPICS, topic: str | None = None) -> DataFrame:
    """row (all columns of ``docs``), lot, source, lang and topic (class numbers) and weight. ``topic``: a column of topics, instead of what the text tells."""
    have = set(docs.columns)
    col = lambda n: (F.col(f"`{n}`") if n in have else F.lit(None)).cast("string")
    d = docs.select(whole(docs), _lot(docs).alias("lot"), F.coalesce(col("source"), F.lit("")).alias("source"), col("lang").alias("lang"), (col(topic) if topic else F.lit(None).cast("string")).alias("given"), measured(text_of(docs)).alias("m"))
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)) - 1, F.lit(len(names))).cast("int")
    return d.select("row", "lot", "source", place(F.col("lang"), langs).alias("lang"), place(F.col("given") if topic else F.col("m.topic"), topics).alias("topic"), F.greatest(F.col("m.words"), F.lit(1)).cast("double").alias("weight"))


def _power(observed: np.ndarray, temperature: float) -> np.ndarray:
    p = np.where(observed > 0, observed, 0.0) ** temperature * (observed > 0)
    return p / p.sum() if p.sum() else p


def rake(cells: DataFrame, langs: int, topics: int, temperature: float = TEMPERATURE, lang_target: np.ndarray | None = None, topic_target: np.ndarray | None = None, source_target: DataFrame | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(source table with its vector w, share and target), and the language and topic factors.

    ``cells``: source, lang, topic, w. Targets default to the observed marginals
    to the power ``temperature``; a source without a target gets its observed share.
    """
    k = langs * topics
    by = cells.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct((F.col("lang") * topics + F.col("topic")).alias("k"), "w"))).alias("m"))
    # one entry per class pair: a bounded vector
    t = by.select("source", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("w"))
    t = t.withColumn("all", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    if source_target is not None:
        t = t.join(source_target.select("source", F.col("target").cast("double").alias("target")), "source", "left").withColumn("target", F.coalesce("target", "all"))
    else:
        t = t.withColumn("target", F.pow("all", F.lit(temperature)))
    t = materialize(t, "sources")
    mass = t.agg(F.sum("target")).first()[0] or 1.0

    def matrix(f: np.ndarray) -> np.ndarray:
        """The class pairs' weights with every source at its target, under the class factors ``f``."""
        scaled = F.transform(F.arrays_zip("w", F.array(*[F.lit(float(x)) for x in f.ravel()]).alias("f")), lambda x: x["w"] * x["f"])
        v = t.select("target", scaled.alias("v")).withColumn("s", F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).filter("s > 0")
        got = v.select(*[F.sum(F.col("v")[i] * F.col("target") / F.col("s") / mass).alias(f"c{i}") for i in range(k)]).first()
        return np.array([x or 0.0 for x in got]).reshape(langs, topics)

    seen = np.array([x or 0.0 for x in t.select(*[F.sum(F.col("w")[i]).alias(f"c{i}") for i in range(k)]).first()]).reshape(langs, topics)
    want_l = _power(seen.sum(1), temperature) if lang_target is None else np.asarray(lang_target, float) * (seen.sum(1) > 0)
    want_t = _power(seen.sum(0), temperature) if topic_target is None else np.asarray(topic_target, float) * (seen.sum(0) > 0)
    want_l, want_t = (x / x.sum() if x.sum() else x for x in (want_l, want_t))
    fl, ft = np.ones(langs), np.ones(topics)
    for _ in range(ITERATIONS):
        m = matrix(fl[:, None] * ft[None, :])
        gap = max(np.abs(m.sum(1) - want_l).max(), np.abs(m.sum(0) - want_t).max())
        if gap < TOLERANCE:
            break
        up = lambda want, have: np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
        a = up(want_l, m.sum(1))
        m = m * a[:, None]
        fl, ft = fl * a, ft * up(want_t, m.sum(0))
    return t.withColumn("mass", F.lit(mass)), fl, ft


def probabilities(d: DataFrame, keep: float = KEEP, temperature: float = TEMPERATURE, langs: int = len(LANGUAGES), topics: int = len(TOPICS), **targets) -> DataFrame:
    """``d`` (see ``with_cells``) with factor, copies, the expected copies of a row, and p, its probability in a sample without repeats."""
    langs, topics = langs + 1, topics + 1
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("weight").alias("w"))
    t, fl, ft = rake(cells, langs, topics, temperature, **targets)
    f = F.array(*[F.lit(float(x)) for x in (fl[:, None] * ft[None, :]).ravel()])
    scaled = F.aggregate(F.transform(F.arrays_zip("w", f.alias("f")), lambda x: x["w"] * x["f"]), F.lit(0.0), lambda a, x: a + x)
    total = t.agg(F.sum("all")).first()[0] or 1.0
    # a source's own factor, so that factor x weight is the raked weight on the scale of the observed total
    t = materialize(t.withColumn("s", scaled).select("source", "all", "w", F.when(F.col("s") > 0, F.col("target") / F.col("mass") * total / F.col("s")).otherwise(0.0).alias("factor")), "factors")
    pairs = t.select(F.explode(F.transform(F.arrays_zip("w", f.alias("f")), lambda x: F.struct(x["w"].alias("w"), (x["f"] * F.col("factor")).alias("r")))).alias("x")).select("x.w", "x.r").filter("w > 0")
    rate = _rate(pairs, keep, total)
    s = t.select("source", F.col("factor").alias("of_source"))
    if t.count() <= BROADCAST_SOURCES:
        j = d.join(F.broadcast(s), "source", "left")
    else:
        j = spread_join(d, s, ["source"], hot_keys(t, ["source"], "all"), ["lot"])
    factor = F.coalesce(F.col("of_source"), F.lit(0.0)) * F.element_at(f, F.col("lang") * topics + F.col("topic") + 1)
    j = j.withColumn("factor", factor).withColumn("copies", F.lit(float(keep)) * F.col("factor"))
    return j.withColumn("p", F.least(F.lit(1.0), F.lit(rate) * F.col("factor"))).drop("of_source")


def _rate(pairs: DataFrame, keep: float, total: float) -> float:
    """The c at which the weights w x min(1, c x r) sum to the share ``keep``; grids of 32, thrice."""
    low, high = 0.0, 1.0
    at = lambda cs: [x or 0.0 for x in pairs.agg(*[F.sum(F.col("w") * F.least(F.lit(1.0), F.col("r") * F.lit(float(c)))) for c in cs]).first()]
    while high < 2**40 and at([high])[0] < keep * total:
        low, high = high, high * 8
    for _ in range(3):
        grid = np.linspace(low, high, 33)
        over = [v >= keep * total for v in at(grid)]
        i = over.index(True) if True in over else 32
        low, high = float(grid[max(0, i - 1)]), float(grid[i])
    return high if math.isfinite(high) else 1.0


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that a row's values decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def _lot(docs: DataFrame) -> Column:
    have = set(docs.columns)
    return uniform(*[F.col(f"`{c}`") if c in have else F.lit(None) for c in ("doc_id", "text")])


def _drawn() -> Column:
    """Copies of a row: the whole ones, and one more if the lot falls in the rest."""
    n = F.floor("copies")
    return (n + (F.col("lot") < F.col("copies") - n).cast("long")).cast("int")


def sample(docs: DataFrame, keep: float = KEEP, repeats: bool = False, **more) -> DataFrame:
    """The sampled rows of ``docs``, with its columns; with ``repeats`` each as often as its copies say."""
    d = probabilities(with_cells(docs), keep, **more)
    if repeats:
        return d.withColumn("drawn", _drawn()).filter("drawn > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("drawn")))).select("row.*")
    return d.filter("lot < p").select("row.*")


def report(docs: DataFrame, keep: float = KEEP, **more) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, sampled, expected_copies, copies of each row."""
    d = with_cells(pick(docs, doc_id="long", text="string", lang="string", source="string"))
    # the texts are read once: what follows needs their measures alone
    d = probabilities(materialize(d.withColumn("row", F.col("row").dropFields("text")), "cells"), keep, **more)
    names = F.array(*map(F.lit, (*TOPICS, "other")))
    return d.select("row.doc_id", "row.source", "row.lang", names[F.col("topic")].alias("topic"), F.col("weight").cast("long").alias("n_tokens"), "factor", F.col("p").alias("probability"), (F.col("lot") < F.col("p")).alias("sampled"), F.col("copies").alias("expected_copies"), _drawn().alias("copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
