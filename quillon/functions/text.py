"""Text functions as column expressions that stay in the JVM.

White space is what Unicode calls so, written out because Java's ``\\s`` is ASCII.
NFKC has no built-in: ``normalize`` takes it as an option, by an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and literals on which results depend.
#: White space, for use within a character class; a printable ASCII character is told from it by its range alone.
WS = r"[[^!-~]&&[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
FORMAT_CODES = "\u00a7[^\\n]|&[0-9A-FK-ORa-fk-or]"
SENTENCE_END = rf"(?<=[.!?])[{WS}]+"
SENTENCE_SPLIT = rf"(?<=[.!?])[{WS}]+|[{WS}]+-[{WS}]+|\n+"
ROW_SPLIT = rf"(?<![.][.!?])(?<=[.!?])[{WS}]+"
URL = r"""(?i)https?://[^\s)>"]+"""
DOC_PREFIXES = ("src/content/docs/", "content/docs/", "docs/")
TRUNCATE_RATIO = 0.55
SPLIT_RATIO = 0.45
UNKNOWN_REPLY = "I don't know from the wiki yet. Try /wiki or ask staff for further assistance."
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "can", "cant", "do", "does", "for", "from", "get", "how", "i", "if", "in", "into", "is", "it",
    "my", "of", "on", "or", "that", "the", "to", "use", "was", "were", "what", "wat", "whats", "wats", "when", "where", "which", "who", "with", "you", "your",
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def quoted(s: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", s)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return of(c)


def without_codes(c: Column) -> Column:
    return F.regexp_replace(c, FORMAT_CODES, "")


def normalize(c: Column, compatibility: bool = False) -> Column:
    c = without_codes(c)
    return F.lower(collapse(nfkc(c) if compatibility else c))


def compact(c: Column, compatibility: bool = False) -> Column:
    """a-z, 0-9, _ and - in single-spaced words; anything else separates."""
    c = without_codes(c)
    return F.trim(F.regexp_replace(F.lower(nfkc(c) if compatibility else c), r"[^\w-]+", " "))


def py_normalize(s: str) -> str:
    """``normalize`` of a parameter on the driver, with NFKC."""
    return " ".join(unicodedata.normalize("NFKC", re.sub(FORMAT_CODES, "", s)).split()).lower()


def py_compact(s: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9_\s-]", " ", py_normalize(s)).split())


def words(c: Column) -> Column:
    """Distinct words of a text by white space, hyphens kept inside."""
    return distinct_words(compact(c))


def distinct_words(compacted: Column) -> Column:
    """``words`` of a text that is compact already."""
    return F.array_distinct(F.array_remove(F.split(compacted, " "), ""))


def tokenize(c: Column) -> Column:
    return F.array_remove(F.split(compact(c), "[ -]+"), "")


def query_terms(c: Column) -> Column:
    """Distinct words that carry meaning: no stop word, and none of one letter."""
    return F.filter(words(c), lambda w: ~w.isin(*STOPWORDS) & ((F.length(w) >= 2) | w.rlike(r"^\d$")))


def rfind(c: Column, piece: str) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    at = F.instr(F.reverse(c), piece[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at + 1 - len(piece))


def truncate(c: Column, n: Column | int) -> Column:
    """At most n characters, cut at a late break if there is one, with an ellipsis."""
    n = F.lit(n) if isinstance(n, int) else n

    def cut(head: Column) -> Column:
        last = F.greatest(*[rfind(head, x) for x in (" ", ".", ",", ";")])
        return F.concat(F.when(last >= n * F.lit(TRUNCATE_RATIO), rstrip(F.substring(head, F.lit(1), last))).otherwise(head), F.lit("…"))

    return F.when(F.length(c) <= n, c).otherwise(let(rstrip(F.substring(c, F.lit(1), F.greatest(F.lit(0), n - 1))), cut))


def sanitize(c: Column) -> Column:
    """One line without pings."""
    return F.replace(F.replace(collapse(c), F.lit("@everyone"), F.lit("everyone")), F.lit("@here"), F.lit("here"))


def split_for_chat(c: Column, n: int) -> Column:
    """Messages of at most n characters, in order."""

    def step(a: Column, _: Column) -> Column:
        rest = a["rest"]
        head = F.substring(rest, 1, n)
        last = F.greatest(*[rfind(head, x) for x in (". ", "; ", ", ", " ")])
        at = F.when(F.length(rest) <= n, F.length(rest)).when(last < F.lit(n * SPLIT_RATIO), F.lit(n)).otherwise(last)
        return F.when(F.length(rest) == 0, a).otherwise(
            F.struct(F.trim(F.substring(rest, at + 1, F.length(rest))).alias("rest"), F.concat(a["parts"], F.array(F.trim(F.substring(rest, F.lit(1), at)))).alias("parts"))
        )

    def parts(text: Column) -> Column:
        steps = F.sequence(F.lit(1), F.ceil(F.length(text) / F.lit(n * SPLIT_RATIO)).cast("int") + 1)
        start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))
        return F.filter(F.aggregate(steps, start, step, lambda a: a["parts"]), lambda p: p != "")

    return let(sanitize(c), parts)


def word_pattern(word: str) -> str:
    return rf"(?i)(?<![a-z0-9_]){quoted(py_normalize(word))}(?![a-z0-9_])"


def contains_trigger(c: Column, triggers: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in triggers:
        out = out | normalize(c).rlike(word_pattern(t))
    return out


def strip_trigger(c: Column, triggers: Sequence[str]) -> Column:
    """Without the first occurrence of each trigger, longest first."""
    for t in sorted(triggers, key=len, reverse=True):
        c = F.regexp_replace(c, rf"(?s)\A(.*?){word_pattern(t)}", "$1 ")
    return collapse(F.regexp_replace(c, rf"\A[,;:!?.{WS}-]+", ""))


def is_greeting(c: Column, patterns: Sequence[str]) -> Column:
    return compact(c).isin(*[py_compact(p) for p in patterns]) if patterns else F.lit(False)


def cells(row: Column) -> Column:
    """The cells of a table row that hold something."""
    return F.filter(F.transform(F.split(row, "\\|"), strip), lambda x: x != "")


def is_row(c: Column) -> Column:
    return F.contains(c, F.lit("|"))


def is_table_line(stripped: Column) -> Column:
    return F.startswith(stripped, F.lit("|"))


def separator_like(stripped: Column) -> Column:
    return stripped.rlike(rf"\A\|?[{WS}:|-]+\|?\z")


def is_separator(stripped: Column) -> Column:
    return F.contains(stripped, F.lit("-")) & separator_like(stripped)


def reformat(c: Column) -> Column:
    """A unit as answer text: no heading marks, cells joined, no code marks, one line."""

    def joined(t: Column) -> Column:
        return let(cells(t), lambda x: F.when(is_row(t) & (F.size(x) > 0), F.array_join(x, " - ")).otherwise(t))

    bare = let(F.regexp_replace(c, rf"\A#+[{WS}]*", ""), joined)
    return F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("`"), F.lit("")), rf"[{WS}]+", " "), r"\A[ •-]+|[ •-]+\z", "")


def split_sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_SPLIT)


def candidate_units(c: Column) -> Column:
    """Table rows one by one, then the sentences of all other lines."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def units(ls: Column) -> Column:
        rows = F.flatten(F.transform(F.filter(ls, lambda x: is_table_line(x) & ~separator_like(x)), lambda x: F.split(x, ROW_SPLIT)))
        prose = F.array_join(F.filter(ls, lambda x: ~is_table_line(x)), " ")
        return F.filter(F.transform(F.concat(rows, split_sentences(prose)), strip), lambda x: x != "")

    return let(lines, units)


def dedupe_phrases(c: Column) -> Column:
    """Sentences in order, each once by its normal form."""
    parts = F.filter(F.transform(split_sentences(c), reformat), lambda p: normalize(p) != "")
    keyed = F.transform(parts, lambda p: F.struct(p.alias("p"), normalize(p).alias("k")))

    def step(a: Column, x: Column) -> Column:
        return F.when(F.array_contains(a["seen"], x["k"]), a).otherwise(F.struct(F.concat(a["seen"], F.array(x["k"])).alias("seen"), F.concat(a["out"], F.array(x["p"])).alias("out")))

    none = F.array().cast("array<string>")
    return F.trim(F.aggregate(keyed, F.struct(none.alias("seen"), none.alias("out")), step, lambda a: F.array_join(a["out"], " ")))


def limit_sentences(c: Column, n: int) -> Column:
    if n <= 0:
        return c
    parts = F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) <= n, c).otherwise(F.array_join(F.slice(p, 1, n), " ")))


def clean_generation(c: Column) -> Column:
    """A model's text as a reply: cut at markers, no preamble or closer, two sentences, else the unknown reply."""
    for marker in ("</s>", "<|user|>", "<|assistant|>", "Question:", "Answer:"):
        c = F.substring_index(c, marker, 1)
    c = sanitize(c)
    context = rf"(?:based on|according to)[{WS}]+(?:the[{WS}]+)?(?:provided[{WS}]+)?context"
    c = F.regexp_replace(c, rf"(?i)\A{context}[:,{WS}-]*", "")
    c = F.regexp_replace(c, rf"(?i)\b{context}\b[:,]?[{WS}]*", "")
    c = F.regexp_replace(c, r"(?i)\b(if you have any (?:other )?questions?.*|let me know if you need anything else.*)\z", "")
    c = limit_sentences(sanitize(c), 2)
    unknown = (c == "") | let(normalize(c), lambda t: F.contains(t, F.lit("dont know")) | F.contains(t, F.lit("don't know")))
    return F.when(unknown, F.lit(UNKNOWN_REPLY)).otherwise(c)


def selector_choice(c: Column, n: Column | int) -> Column:
    """The first number of a model's text if it is 0 to n, else null."""
    got = F.regexp_extract(c, r"\b(\d+)\b", 1)
    number = F.when(F.length(got).between(1, 9), got.try_cast("int"))
    return F.when(number <= (F.lit(n) if isinstance(n, int) else n), number)


def urls(c: Column) -> Column:
    """Distinct addresses in order, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:]+\z", "")))


def session_id(c: Column) -> Column:
    return F.nullif(F.substring(F.regexp_replace(strip(c), "[^a-zA-Z0-9_-]", ""), 1, 80), F.lit(""))


def new_session_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def path_to_url(path: Column, base_url: str) -> Column:
    if not base_url:
        return F.lit(None).cast("string")
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"\A/+|/+\z", "")
    # only the first prefix that fits goes
    p = F.regexp_replace(p, r"\A(?:" + "|".join(map(quoted, DOC_PREFIXES)) + ")", "")
    p = F.regexp_replace(F.regexp_replace(p, r"(?i)\.(md|mdx)\z", ""), r"/index\z", "")
    p = F.regexp_replace(p, r"\A/+|/+\z", "")
    return F.concat(F.lit(base_url + "/"), F.when(p == "", F.lit("")).otherwise(F.concat(p, F.lit("/"))))


def finalize(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), sanitize(c))
