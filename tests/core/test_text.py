import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import text as T
from quillon.operators import chat as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def many(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_normal_forms(spark):
    assert many(spark, ["§aHi  &lthere You", "A-b_c (d)!", "", "ＡＢ"], T.normalize) == ["hi there you", "a-b_c (d)!", "", "ａｂ"]
    assert many(spark, ["A-b_c (d)!", "Don't\tstop", "é"], T.compact) == ["a-b_c d", "don t stop", ""]
    assert one(spark, "ＡＢ ﬁ", lambda c: T.normalize(c, True)) == "ab fi"
    assert one(spark, "/town set taxes {$}", T.tokenize) == ["town", "set", "taxes"]
    assert one(spark, "/warp <warp-name>", T.tokenize) == ["warp", "warp", "name"]
    assert one(spark, "what is the star rank 5 x", T.query_terms) == ["star", "rank", "5"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB9 -_.,;  \x1c\x85é§&k|\t\n"), max_size=40), min_size=30, max_size=30))
def test_normal_forms_as_python_has_them(spark, texts):
    def norm(s):
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", re.sub("§.|&[0-9A-FK-ORa-fk-or]", "", s))).strip().lower()

    assert many(spark, texts, lambda c: T.normalize(c, True)) == [norm(s) for s in texts]
    assert many(spark, texts, lambda c: T.compact(c, True)) == [" ".join(re.sub(r"[^a-z0-9_\s-]", " ", norm(s)).split()) for s in texts]
    assert many(spark, texts, T.strip) == [s.strip() for s in texts]


def test_truncate_and_split(spark):
    assert one(spark, "short", lambda c: T.truncate(c, 10)) == "short"
    assert one(spark, "one two three four", lambda c: T.truncate(c, 12)) == "one two…"
    assert one(spark, "abcdefghijklmnop", lambda c: T.truncate(c, 8)) == "abcdefg…"
    parts = one(spark, "a " * 300, lambda c: T.split_for_chat(c, 80))
    assert len(parts) > 1 and all(len(p) <= 80 for p in parts) and " ".join(parts).split() == ["a"] * 300
    assert one(spark, " \n ", lambda c: T.split_for_chat(c, 80)) == []
    assert one(spark, "x" * 25, lambda c: T.split_for_chat(c, 10)) == ["x" * 10, "x" * 10, "x" * 5]
    assert one(spark, "hi @everyone\n@here", T.sanitize) == "hi everyone here"


def test_triggers(spark):
    assert one(spark, "zedric what is marriage", lambda c: T.strip_trigger(c, ["zed", "zedric"])) == "what is marriage"
    assert one(spark, "hey zed, hi", lambda c: T.contains_trigger(c, ["zed"])) is True
    assert one(spark, "zed2", lambda c: T.contains_trigger(c, ["zed"])) is False
    assert one(spark, "Hello!", lambda c: T.is_greeting(c, ["hello"])) is True


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<Steve> zed what is fluff?", ("Steve", None, "zed what is fluff?")),
        ("🏕 ➟ TOPAZ Zed [❄ '24] ➡ !askme whats bread", ("Zed", "TOPAZ", "!askme whats bread")),
        ("§a🏙 ➟ TOPAZ ➡ §f!askme status", ("TOPAZ", None, "!askme status")),
        ("🏕 ➟ TOPAZ Notch ➡ !askme status", ("Notch", "TOPAZ", "!askme status")),
        ("[World] Bob: hi there", ("Bob", None, "hi there")),
        ("Bob: hi", ("Bob", None, "hi")),
        ("no speaker here", (None, None, "no speaker here")),
        ("★ Bob»hi", ("Bob", None, "hi")),
        ("★ A Bob [x] [y] -> ", (None, None, "★ A Bob [x] [y] ->")),
    ],
)
def test_parse_line(spark, raw, want):
    assert tuple(one(spark, raw, C.parse_line)) == want


def test_prefix(spark):
    names = ["!askme"]
    strip = lambda c: C.strip_prefix(c, names)
    assert many(spark, ["!askme  what is x", "🏕 ➟ TOPAZ ➡ !ASKME what", "!askmea x", "nothing", "!askme"], strip) == ["what is x", "what", None, None, ""]


def test_urls_paths_sessions(spark):
    assert one(spark, "see https://a.b/c, and HTTPS://x.y/z). https://a.b/c.", T.urls) == ["https://a.b/c", "HTTPS://x.y/z"]
    url = lambda c: T.path_to_url(c, "https://w")
    assert many(spark, ["src/content/docs/earth/towny.mdx", "docs/home/index.md", "index.md", "a\\b.MD", "/"], url) == ["https://w/earth/towny/", "https://w/home/", "https://w/index/", "https://w/a/b/", "https://w/"]
    assert many(spark, [" a@b#c? ", "", "@@", "x" * 99], T.session_id) == ["abc", None, None, "x" * 80]
    assert one(spark, "x", lambda c: T.path_to_url(c, "")) is None


def test_generation(spark):
    text = "Based on the provided context, Use /t claim. It costs 5. Third one. Let me know if you need anything else!</s>junk"
    assert one(spark, text, T.clean_generation) == "Use /t claim. It costs 5."
    assert one(spark, "I dont know", T.clean_generation) == T.UNKNOWN_REPLY
    assert one(spark, "", T.clean_generation) == T.UNKNOWN_REPLY
    assert many(spark, ["2", "pick 0 now", "9", "none"], lambda c: T.selector_choice(c, 3)) == [2, 0, None, None]


def test_queries(spark):
    flag = lambda f, *qs: many(spark, qs, f)
    assert flag(P.price_query, "what's the price", "pricing?", "priced", "cost") == [True, True, False, False]
    assert flag(P.cost_query, "how much is x", "prices", "the tax") == [True, False, True]
    assert flag(P.howto_query, "how much to start", "how do i start", "what is it") == [False, True, False]
    assert flag(P.definition_query, "what's a town", "what is x", "what do x do", "what does pvp mean") == [True, True, False, True]
    assert flag(P.recency_query, "whats new", "how do capsules work") == [True, False]
    assert flag(P.has_cost_value, "costs $5,000", "250,000$", "5 dollars", "5 apples", "upkeep is 12") == [True, True, True, False, True]
    assert flag(P.has_command, "use /t claim", "and/or", "/warp") == [True, False, True]
    assert [tuple(x) if x else None for x in flag(P.source_date, "log/10-06-26.md", "31-02-26.md", "32-01-26.md", "x/towny.md", "1-2-03")] == [(26, 6, 10), (26, 2, 31), None, None, (3, 2, 1)]
    assert flag(P.pricelike, "| Detonate | 1,000,000$ |", "| Detonate | Chance to dig |", "| 5 xp", "| A | 10 exp |", "| A | words |") == [True, False, False, True, False]


def test_units(spark):
    text = "Stars\n| Rank | Perk |\n|---|---|\n| 5 | access. Then more |\nLine one. Line two - three\n\nlast"
    assert one(spark, text, T.candidate_units) == ["| Rank | Perk |", "| 5 | access.", "Then more |", "Stars Line one.", "Line two", "three last"]
    assert one(spark, "| {a} .. {b} | does it |", T.candidate_units) == ["| {a} .. {b} | does it |"]
    assert many(spark, ["## A  `b` c", "| x | y | |", "- item •"], T.reformat) == ["A b c", "x - y", "item"]
    assert one(spark, "A b. a B. C d.", T.dedupe_phrases) == "A b. C d."
    assert one(spark, "One. Two! Three?", lambda c: T.limit_sentences(c, 2)) == "One. Two!"
