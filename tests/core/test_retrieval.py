import math
import random

from quillon.functions import text as T
from quillon.operators import index as I
from quillon.operators import retrieval as R


def corpus(spark, rows):
    c = spark.createDataFrame([(i, p, "T", h, t, s) for i, (p, h, t, s, _) in enumerate(rows)], "chunk_idx long, source_path string, title string, heading_path array<string>, text string, start_char int")
    e = spark.createDataFrame([(i, list(map(float, r[4]))) for i, r in enumerate(rows)], "chunk_idx long, embedding array<double>")
    return c, e


def found(spark, rows, query, q, k=5, gate=0.18):
    c, e = corpus(spark, rows)
    asked = spark.createDataFrame([(7, query, list(map(float, q)))], "query_id long, query string, embedding array<double>")
    return [(r.chunk_idx, round(r.score, 5)) for r in sorted(R.search(c, e, asked, k, gate).collect(), key=lambda r: r.pos)]


def prose(text, e, path=None, start=0, heads=("H",)):
    return (path or f"{text[:8]}.md", list(heads), text, start, e)


FLUFF = "Fluff cosmetics are visual only and do not change gameplay."


def test_words_reorder_within_the_gate(spark):
    rows = [prose(FLUFF, (0.6, 0.8, 0)), prose("/town set taxes {$} Sets daily taxes.", (0.5, 0.5, 0.7))]
    assert found(spark, rows, "set town taxes", (0.6, 0.8, 0), k=2) == [(1, 0.7), (0, 1.0)]


def test_gate_and_dense_order(spark):
    rows = [prose(FLUFF, (0.6, 0.8, 0)), prose("Cactus farms grow cactus.", (0, 0, 1))]
    assert [i for i, _ in found(spark, rows, "cactus farms unrelated topic", (0.6, 0.8, 0))] == [0]
    rows = [prose("a words here", (0.6, 0.8, 0)), prose("b words here", (0.55, 0.78, 0.1))]
    assert [i for i, _ in found(spark, rows, "zzz qqq", (0.6, 0.8, 0), gate=0.0)] == [0, 1]
    assert found(spark, rows, "  ", (0.6, 0.8, 0)) == []


TABLE = "Stars\n| 1 | silk touch |\n| 2 | more |"


def test_table_siblings(spark):
    rows = [prose(TABLE, (1, 0, 0), "s.md", 0), prose(TABLE.replace("1", "3"), (0, 1, 0), "s.md", 200), prose("Other prose text", (0, 1, 0), "o.md")]
    assert found(spark, rows, "star rank 3", (1, 0, 0)) == [(0, 1.0), (1, 0.0)]
    assert found(spark, rows[:1] + rows[2:], "star rank 3", (1, 0, 0)) == [(0, 1.0)]
    two = [prose("First prose part", (1, 0, 0), "s.md", 0), prose("Second prose part", (0, 1, 0), "s.md", 200)]
    assert [i for i, _ in found(spark, two, "zzz", (1, 0, 0))] == [0]
    intro = [prose("Baseline orb price list", (1, 0, 0), "s.md", 0), prose(TABLE, (0, 1, 0), "s.md", 200)]
    assert [i for i, _ in found(spark, intro, "zzz", (1, 0, 0))] == [0, 1]


def test_rare_words_are_rescued(spark):
    common = [prose(f"price list tier {i}", (x, math.sqrt(1 - x * x), 0), f"p{i}.md") for i, x in enumerate((0.9, 0.88, 0.86, 0.84, 0.82))]
    for x, gate, hit in ((0.25, 0.18, True), (0.15, 0.18, True), (0.05, 0.18, False)):
        rows = [*common, prose("Rush Slingshot costs gold", (x, math.sqrt(1 - x * x), 0), "z.md")]
        assert (5 in [i for i, _ in found(spark, rows, "price for slingshot", (1, 0, 0), k=2, gate=gate)]) is hit


def test_diversity_closed_form(spark):
    rng = random.Random(9)
    k, rows, want = 5, [], {}
    for q in range(60):
        keys = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        out, seen = [], set()
        for i, key in enumerate(keys, 1):
            if len(out) == k:
                break
            if key in seen and len(out) >= math.ceil(k / 2):
                continue
            seen.add(key)
            out.append(i)
        want[q] = out
        rows += [(q, i, key, ["x"], 0.5) for i, key in enumerate(keys, 1)]
    d = spark.createDataFrame(rows, "query_id int, rank_fused int, source_path string, heading_path array<string>, dense double")
    got = {}
    for r in R.diverse_topk(d, k).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.rank_fused))
    assert {q: [x for _, x in sorted(v)] for q, v in got.items()} == want


def test_dated_sources(spark):
    rows = [prose("old news entry", (0.9, 0.4, 0), "c/01-04-26.md"), prose("new news entry", (0.8, 0.6, 0), "c/10-06-26.md"), prose("plain wiki page", (0.5, 0.8, 0), "w.md")]
    assert [i for i, _ in found(spark, rows, "whats new", (1, 0, 0))][:2] == [1, 0]
    assert [i for i, _ in found(spark, rows, "news entry", (1, 0, 0))][0] == 2


def test_bm25(spark):
    docs = ["Town upkeep costs play a big part in the economy.", "/town set taxes {$} Sets daily taxes.", FLUFF, ""]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    tokens = I.tokenized(d, "id", d.text)
    q = spark.createDataFrame([(0, "how do i set town taxes"), (1, "zzz"), (2, "")], "query_id long, query string")
    got = {(r.query_id, r.id): r.lex for r in I.bm25_scores(tokens, q).collect()}
    assert max(got, key=got.get) == (0, 1) and {k[0] for k in got} == {0} and min(got.values()) > 0
    words = [T.py_compact(x).replace("-", " ").split() for x in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    for (_, i), s in got.items():
        want = 0.0
        for t in "how do i set town taxes".split():
            df = sum(t in w for w in words)
            tf = words[i].count(t)
            if tf:
                want += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[i]) / avg))
        assert abs(s - want) < 1e-9
    assert I.corpus_stats(tokens).first().n == 4 and I.corpus_stats(tokens.limit(0)).first().avgdl == 0.0
