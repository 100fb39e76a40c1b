import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from quillon.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = rules.op2_rules(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == base(text[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_trouble(docs, labels, none):
    got = sorted((tuple(r[n] for n in ("doc_id", *NAMES)) for r in rules.verdicts(docs, labels).collect()), key=repr)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=repr)
    assert rules.verdicts(none, labels).collect() == []
    kept = rules.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in docs.collect() if not base(r.text)[5]), key=repr)


@pytest.mark.parametrize("n", [1, 40, 700])
def test_binomial_tail(spark, n):
    rate = 0.03 / 7
    got = spark.range(0, n + 1).select("id", rules.binomial_tail(F.col("id"), F.lit(n), rate).alias("p")).collect()
    p = Fraction(rate)
    for r in got[:30]:
        want = 1.0 if r.id >= n * rate else float(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(r.id + 1)))
        assert abs(r.p - want) < 1e-9


def certified(spark, n, copies=1, texts=None):
    """Cutoffs from n documents, odd ones bad and full of symbols, each row ``copies`` times, with ``texts`` different texts."""
    rows = [(i, "en", 0.9 if i % 2 else 0.0, (i if texts is None else i % texts) * 7919) for i in range(n)] * copies
    d = spark.createDataFrame([(i, s, x, 0.0, 0.0, 0.0, 1.0, 5.0, t) for i, s, x, t in rows], "doc_id long, stratum string, r_symbols double, r_dup_lines double, r_repeat double, r_upper double, r_distinct double, word_length double, text_key long")
    y = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)] * copies, "doc_id long, quality int")
    return rules.cutoffs(d, y).collect()


def test_no_certificate_without_evidence(spark):
    """Few labels certify nothing; many certify a cutoff that rejects almost no good document."""
    assert certified(spark, 120) == []
    many = certified(spark, 1200)
    assert len(many) == 1 and many[0]["c_symbols"] == 0.5 and many[0]["c_upper"] is None


def test_copies_are_no_evidence(spark):
    """Repeated rows, and equal texts under other ids, count once."""
    assert certified(spark, 120, copies=50) == []
    assert certified(spark, 6000, texts=120) == []


def test_risk_holds_on_fresh_documents(spark):
    """The cutoffs that op2 certifies, against labels it never saw: at most ALPHA of good documents, within chance."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = rules.verdicts(docs, labels.filter(half)).filter("not base_failed").join(labels.filter(~half).filter("quality = 1").select("doc_id").distinct(), "doc_id")
    n, bad = got.agg(F.count(F.lit(1)), F.count_if(~F.col("kept"))).first()
    assert bad <= rules.ALPHA * n + 3 * (rules.ALPHA * n) ** 0.5


def slow_cutoffs(rows):
    """{stratum: {rule: cutoff}} from labelled rows by plain loops and exact fractions."""
    out = {}
    strata = sorted({r["stratum"] for r in rows})
    tried = {}
    for s in strata:
        half = [r for r in rows if r["stratum"] == s and r["tuning"]]
        good, bad = [r for r in half if r["good"] == 1], [r for r in half if r["good"] == 0]
        for k, part in enumerate(rules.LEVELS):
            setting = {}
            for rule, (name, side, grid) in rules.RULES.items():
                beyond = lambda r, c, name=name, side=side: r[name] > c if side > 0 else r[name] < c
                found = [(-sum(beyond(r, c) for r in bad), i, c) for i, c in enumerate(grid) if sum(beyond(r, c) for r in good) <= part * len(good) and any(beyond(r, c) for r in bad)]
                if found:
                    setting[rule] = min(found)[2]
            if setting:
                tried.setdefault(s, []).append(setting)
    rejects = lambda r, setting: any(r[rules.RULES[x][0]] > c if rules.RULES[x][1] > 0 else r[rules.RULES[x][0]] < c for x, c in setting.items())
    for s, settings in tried.items():
        held = [r for r in rows if r["stratum"] == s and not r["tuning"] and r["good"] == 1]
        for setting in settings:
            n, k, p = len(held), sum(rejects(r, setting) for r in held), Fraction(rules.ALPHA)
            if not n or k >= n * p or sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > rules.DELTA / len(tried):
                break
            out[s] = setting
    return out


def test_kept_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # the small table certifies little, so its documents also count under one language
    for d in (docs, docs.withColumn("lang", F.lit("all"))):
        s = rules.measured(d).drop("row")
        y = rules.labelled(s, labels).withColumn("tuning", F.pmod(F.xxhash64("text_key", F.lit(11)), F.lit(2)) == 0)
        want = slow_cutoffs([r.asDict() for r in y.collect()])
        got = {r["stratum"]: {x: r[f"c_{x}"] for x in rules.RULES if r[f"c_{x}"] is not None} for r in rules.cutoffs(s, labels).collect()}
        assert got == want
        stats = {r["doc_id"]: r.asDict() for r in s.collect()}
        for r in rules.verdicts(d, labels).collect():
            x = stats[r.doc_id]
            cut = want.get(x["stratum"], {})
            beyond = any(x[rules.RULES[n][0]] > c if rules.RULES[n][1] > 0 else x[rules.RULES[n][0]] < c for n, c in cut.items())
            assert r.kept == (not x["base_failed"] and not beyond)
    assert want
