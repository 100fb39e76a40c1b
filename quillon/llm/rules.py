"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Rules are statistics of a whole text with a grid of cutoffs, mildest first. In
each language (the stratum) labelled documents are dealt by a hash of their text
into two halves. On the first, each of ``LEVELS`` gives every rule the strictest
cutoff that rejects at most that part of the good documents (the mildest of those
that reject as many bad ones; none that rejects no bad one): settings of all
rules together, each stricter than the one before. On the second half, the
holdout, the settings are tested in order by the exact binomial bound: one is
certified if the chance of so few rejections of good documents, were the true
rate ``ALPHA``, is at most ``DELTA`` / strata, a Bonferroni correction; testing
ends at the first that fails, which needs no further correction. The last
certified setting holds. So in every stratum at most ``ALPHA`` of good documents
fall to the rules, with confidence 1 - ``DELTA`` for all strata together. With
four strata it takes 144 good labels in a stratum's holdout to certify anything.

A document counts once, and so does a text, however often either occurs: trials
that repeat each other would certify anything.

Repeated windows are found within the row: no words are shuffled.

Defined results: a null or empty text has no words and fails the base rules; very
long texts are read whole; a
null language is a stratum of its own; a document or text labelled both ways counts as
good; an id with several texts is judged by the one with the least hash; without labels nothing but the base rules rejects; null doc_ids match no
label; a value at a cutoff is not beyond it; repeated rows get equal verdicts; an empty table gives no rows; columns
of a document, whatever their names, are kept by ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, materialize, pick, table, text_of, whole

ALPHA = 0.03
DELTA = 0.05
#: Parts of the good documents of the first half that a rule may reject, one setting each.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)
WINDOW = 8
_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rule: (statistic, +1 if high values are rejected, cutoffs from mild to strict).
RULES = {
    "symbols": ("r_symbols", 1, (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("r_dup_lines", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("r_repeat", 1, (0.29, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "upper": ("r_upper", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "variety": ("r_distinct", -1, (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3)),
    "long_words": ("word_length", 1, (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0)),
    "short_words": ("word_length", -1, (1.2, 1.5, 1.8, 2.0, 2.2, 2.5, 2.8, 3.0)),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    t = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def repeat_words(words: Column, n: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur twice or more; ``words`` and ``n`` are columns that exist."""

    def covered(pairs: Column) -> Column:
        # equal windows are neighbours once sorted
        same = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        again = F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))
        at = F.array_sort(F.transform(again, lambda p: p["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")), lambda a: a["total"])

    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    count = let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)),
    )
    return F.when(n <= WINDOW, F.lit(0)).otherwise(count)


def statistics(d: DataFrame) -> DataFrame:
    """``d`` (its own columns: text and others that aren't named below) with the base counts and rule statistics."""
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(bare)).cast("long"),
        "line_counts": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "n_upper": F.regexp_count("text", F.lit("[A-Z]")),
        "n_distinct": F.size(F.array_distinct("words")),
        "text_key": F.xxhash64("text"),
    })
    d = d.withColumns({"n_dup_lines": F.col("line_counts")["dup"].cast("long"), "n_repeat_words": repeat_words(F.col("words"), F.col("n_words").cast("int")).cast("long")})
    per = lambda a, b: F.when(b > 0, F.col(a) / b).otherwise(F.lit(0.0))
    d = d.withColumns({
        "r_symbols": per("n_symbols", F.col("word_chars")),
        "r_dup_lines": per("n_dup_lines", F.col("line_counts")["n"]),
        "r_repeat": per("n_repeat_words", F.col("n_words")),
        "r_upper": per("n_upper", F.col("word_chars")),
        "r_distinct": per("n_distinct", F.col("n_words")),
        "word_length": per("word_chars", F.col("n_words")),
        "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    })
    return d.drop("words", "line_counts", "text", "n_upper", "n_distinct")


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k), X binomial(n, rate), summed term by term in logarithms; 1 where k is at least the mean."""
    first = n * math.log1p(-rate)
    odds = math.log(rate / (1 - rate))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(-F.abs(a["s"] - t)))).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.struct(first.alias("t"), first.alias("s")), step, lambda a: F.exp(a["s"]))
    return F.when(k >= n * rate, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def beyond(statistic: Column, side: int, cutoff) -> Column:
    return statistic > cutoff if side > 0 else statistic < cutoff


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, text_key, good and the rule statistics: one row for each labelled text of a stratum."""
    y = pick(labels, doc_id="long", quality="int").filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    kept = ["text_key", "stratum", *STATISTICS]
    # an id's rows become one before they meet its label
    one = stats.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*kept)).alias("x"))
    j = one.join(y, "doc_id").select("x.*", "good")
    return j.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), *[F.max(c).alias(c) for c in STATISTICS])


def settings(tuning: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """stratum, level and c_<rule> (null: off) from the first half: a row per stratum and level with a rule."""
    counts = []
    for rule, (name, side, grid) in RULES.items():
        for i, c in enumerate(grid):
            out = beyond(F.col(name), side, F.lit(c))
            counts += [F.count_if(out & (F.col("good") == 1)).alias(f"{rule}_{i}_g"), F.count_if(out & (F.col("good") == 0)).alias(f"{rule}_{i}_b")]
    per = materialize(tuning.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n"), *counts), "counts")
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}_g").alias("good"), F.col(f"{rule}_{i}_b").alias("bad")) for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid)])
    tries = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x).alias("part")) for k, x in enumerate(levels)])
    long = per.select("stratum", "n", F.explode(rows).alias("x")).select("stratum", "n", "x.*").select("*", F.explode(tries).alias("y")).select("*", "y.level", "y.part")
    allowed = long.filter((F.col("good") <= F.col("part") * F.col("n")) & (F.col("bad") > 0))
    best = allowed.groupBy("stratum", "level", "rule").agg(F.min_by("cutoff", F.struct(-F.col("bad"), F.col("i"))).alias("cutoff"))
    return best.groupBy("stratum", "level").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES])


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per stratum that has a certified setting: stratum and c_<rule> (null: off).

    ``stats``: doc_id, stratum, text_key and the rule statistics.
    """
    y = materialize(labelled(stats, labels).withColumn("tuning", F.pmod(F.xxhash64("text_key", F.lit(11)), F.lit(2)) == 0), "labelled")
    tried = materialize(settings(y.filter("tuning")), "settings")
    held = y.filter("not tuning and good = 1")
    strata = max(1, tried.select("stratum").distinct().count())
    got = held.join(tried, "stratum").groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(rejected()).alias("k"))
    tested = got.withColumn("fails", binomial_tail(F.col("k"), F.col("n"), alpha) > delta / strata)
    ends = tested.groupBy("stratum").agg(F.min(F.when(F.col("fails"), F.col("level"))).alias("end"))
    last = tested.join(ends, "stratum").filter(F.col("end").isNull() | (F.col("level") < F.col("end"))).groupBy("stratum").agg(F.max("level").alias("level"))
    return materialize(tried.join(last, ["stratum", "level"], "left_semi").drop("level"), "cutoffs")


def rejected() -> Column:
    """Whether a rule rejects, given the statistics and the c_<rule> columns."""
    out = F.lit(False)
    for rule, (name, side, _) in RULES.items():
        out = out | F.coalesce(beyond(F.col(name), side, F.col(f"c_{rule}")), F.lit(False))
    return out


STATISTICS = list(dict.fromkeys(x[0] for x in RULES.values()))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the statistics and ``row`` (all columns of ``docs``), written once: texts are measured a single time."""
    have = set(docs.columns)
    col = lambda n, t: (F.col(f"`{n}`") if n in have else F.lit(None)).cast(t)
    d = docs.select(whole(docs), col("doc_id", "long").alias("doc_id"), text_of(docs).alias("text"), F.coalesce(col("lang", "string"), F.lit("")).alias("stratum"))
    return materialize(statistics(d), "statistics")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row."""
    d = pick(docs, doc_id="long", text="string", lang="string").withColumn("stratum", F.coalesce("lang", F.lit(""))).drop("lang")
    s = materialize(statistics(d), "statistics")
    j = s.join(cutoffs(s, labels), "stratum", "left")
    return j.select("doc_id", *_COUNTS, (~F.col("base_failed") & ~rejected()).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    s = measured(docs)
    return s.filter("not base_failed").join(cutoffs(s, labels), "stratum", "left").filter(~rejected()).select("row.*")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
