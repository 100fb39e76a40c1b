"""Boolean classifiers of queries and sentences, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

# Word lists and weights on which results depend.
PRICE = r"\bpric(?:e|es|ing)\b"
RECENCY = r"\b(latest|newest|recent|recently|new|changed|change|changes|update|updates|updated|patch|changelog|announcement|announcements|roadmap|upcoming|coming soon|whats new)\b"
QUANTITY = r"\bhow (much|many)\b"
HOWTO = r"\b(how|create|make|join|claim|start|open|setup|set up|do i|how to)\b"
DEFINITION = r"\b(what is|what are|what s|whats|define|meaning of|what does .* mean)\b"
HOW_MUCH = r"\bhow much\b"
COST = r"\b(cost|price|upkeep|bankrupt|money|fee|tax|maintenance)\b"
COMMAND = r"\b(command|cmd|syntax|type|use|what is the command)\b"
NAVIGATION = r"\b(go|teleport|tp|warp|visit|get to|reach)\b"
WARNING = r"\b(failure|bankrupt|lose|penalty|upkeep|cost|warning|danger)\b"
SLASH_COMMAND = rf"(?:\A|[{T.WS}])/[a-z0-9_]+"
REQUIREMENT = r"\b(required|requirement|must|need|at least)\b"
ACTION = r"\b(use|type|run|go|teleport(?:s|ed|ing)?|tp|warp|portal|enter|visit|claim|create|join|buy|set)\b"
DEFINING = r"\b(is|are|allows?|lets?|refers?|means?|provides?|enables?|describes?|represents?|denotes?)\b"
STEPS = r"\b(use|type|run|create|join|claim|start|open|first|then|step)\b"
FAILING = r"\b(failure|bankrupt|lose|penalty|upkeep|cost)\b"
SETTING = r"\b(set|setting|configure|create)\b"
GOING = r"\b(spawn|warp|teleport|tp|go)\b"
DATED = r"^(\d{1,2})-(\d{1,2})-(\d{2})$"
W_STEP, W_SLASH, W_FAILING = 0.35, 0.25, 0.15
W_COMMAND, W_NO_COMMAND, W_SETTING, W_GOING = 0.45, 0.10, 0.30, 0.20
W_WARNING, W_COST_VALUE, W_COST_WARNING, W_PRICE_ROW = 0.18, 0.30, 0.12, 0.30
CONFIDENT_RATIO, CONFIDENT_SCORE = 0.34, 0.35


def looks(c: Column, pattern: str) -> Column:
    return T.compact(c).rlike(pattern)


def price_query(q: Column) -> Column:
    return looks(q, PRICE)


def recency_query(q: Column) -> Column:
    return looks(q, RECENCY)


def howto_query(q: Column) -> Column:
    return T.let(T.compact(q), lambda c: ~c.rlike(QUANTITY) & c.rlike(HOWTO))


def definition_query(q: Column) -> Column:
    return looks(q, DEFINITION)


def cost_query(q: Column) -> Column:
    return T.let(T.compact(q), lambda c: c.rlike(HOW_MUCH) | c.rlike(COST))


def command_query(q: Column) -> Column:
    return looks(q, COMMAND)


def navigation_query(q: Column) -> Column:
    return looks(q, NAVIGATION)


def warning_like(s: Column) -> Column:
    return looks(s, WARNING)


def has_command(s: Column) -> Column:
    return F.lower(s).rlike(SLASH_COMMAND)


def has_requirement(s: Column) -> Column:
    return looks(s, REQUIREMENT)


def has_action(s: Column) -> Column:
    return T.normalize(s).rlike(SLASH_COMMAND) | looks(s, ACTION)


def has_cost_value(s: Column) -> Column:
    return T.let(T.normalize(s), cost_value_in)


def cost_value_in(t: Column) -> Column:
    """``has_cost_value`` of a text in its normal form."""
    signed = t.rlike(rf"\$[{T.WS}]*\d") | t.rlike(rf"\d[\d,.{T.WS}]*\$")
    number = t.rlike(rf"\b\d[\d{T.WS},._]*\b")
    return signed | (number & (t.rlike(r"\b(cost|price|money|upkeep|fee|tax)\b") | t.rlike(r"\b(in-game money|dollars?)\b")))


def is_data_row(unit: Column) -> Column:
    return T.is_row(unit) & (F.size(T.cells(unit)) >= 2)


def key_cell(unit: Column) -> Column:
    """The first cell, null if none."""
    return F.get(T.cells(unit), F.lit(0))


def key_words(unit: Column) -> Column:
    return F.coalesce(T.words(key_cell(unit)), F.array().cast("array<string>"))


def key_is_command(unit: Column) -> Column:
    return F.coalesce(F.startswith(key_cell(unit), F.lit("/")), F.lit(False))


def pricelike(unit: Column) -> Column:
    """Whether the cells after the key hold hardly more than an amount."""
    return T.let(F.when(F.size(T.cells(unit)) > 0, T.cells(unit)).otherwise(F.array(F.lit(""))), pricelike_cells)


def pricelike_cells(x: Column) -> Column:
    """``pricelike`` of a row that is cut into cells."""
    tail = F.array_join(F.slice(x, 2, F.size(x)), " ")
    left = F.regexp_replace(F.regexp_replace(tail, rf"[\d,.{T.WS}$%]+", ""), r"(?i)\b(exp|xp)\b", "")
    return F.when(F.size(x) < 2, F.lit(False)).otherwise((F.contains(tail, F.lit("$")) | tail.rlike(r"\d")) & (F.length(left) <= 3))


def definition_match(terms: Column, sentence: Column) -> Column:
    """2: opens on the subject and defines; 1: defines and names it; else 0."""
    return T.let(T.compact(sentence), lambda s: definition_in(terms, s))


def definition_in(terms: Column, s: Column) -> Column:
    """``definition_match`` of a compact text."""
    w = F.array_remove(F.split(s, " "), "")
    return F.when((F.size(terms) == 0) | (s == "") | ~s.rlike(DEFINING), 0).when(F.arrays_overlap(terms, F.slice(w, 1, 4)), 2).when(F.arrays_overlap(terms, w), 1).otherwise(0)


def _if(when: Column, weight: float) -> Column:
    return F.when(when, F.lit(float(weight))).otherwise(F.lit(0.0))


def intent_score(sentence: Column, howto: Column) -> Column:
    return T.let(T.compact(sentence), lambda s: intent_in(s, sentence, howto))


def intent_in(s: Column, sentence: Column, howto: Column) -> Column:
    """``intent_score`` of a sentence and its compact form ``s``."""
    total = F.lit(0.0) + _if(s.rlike(STEPS), W_STEP) + _if(F.contains(sentence, F.lit("/")), W_SLASH) - _if(s.rlike(FAILING), W_FAILING)
    return F.when(howto & (s != ""), total).otherwise(F.lit(0.0))


def alignment(sentence: Column, command_q: Column, navigation_q: Column) -> Column:
    return T.let(T.compact(sentence), lambda s: alignment_in(s, has_command(sentence), command_q, navigation_q))


def alignment_in(s: Column, has_cmd: Column, command_q: Column, navigation_q: Column) -> Column:
    """``alignment`` of a compact text."""
    command = F.when(command_q, F.when(has_cmd, F.lit(W_COMMAND)).otherwise(F.lit(-W_NO_COMMAND))).otherwise(F.lit(0.0))
    return command - _if(navigation_q & s.rlike(SETTING), W_SETTING) + _if(navigation_q & s.rlike(GOING), W_GOING)


def low_confidence(terms: Column, text: Column, score: Column, key_match: Column, has_cmd: Column, command_q: Column, navigation_q: Column, howto_q: Column) -> Column:
    """Whether the best candidate is too weak to answer with; the first rule that applies decides."""
    matched = F.size(F.array_intersect(terms, T.words(text)))
    n = F.size(terms)
    action = has_action(text)
    return (
        F.when((n == 0) | key_match, False)
        .when(command_q & has_cmd & (matched >= 1), False)
        .when(navigation_q & ~action, True)
        .when(howto_q & ~has_cmd & ~action & (matched <= 1), True)
        .when((n >= 2) & (matched == 0), True)
        .when((n >= 3) & (matched / n < CONFIDENT_RATIO) & (score < CONFIDENT_SCORE), True)
        .otherwise(False)
    )


def source_date(path: Column) -> Column:
    """struct(yy, mm, dd) of a dated file name, else null; dates compare as tuples."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*\z", "")

    def of(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, DATED, i).try_cast("int")
        return F.when(s.rlike(DATED), F.struct(part(3).alias("yy"), part(2).alias("mm"), part(1).alias("dd")))

    return T.let(T.let(stem, of), lambda x: F.when(x["dd"].between(1, 31) & x["mm"].between(1, 12), x))


def blocked(c: Column, substrings: list[str]) -> Column:
    out = F.lit(False)
    for s in substrings:
        out = out | F.contains(T.normalize(c), F.lit(T.py_normalize(s)))
    return out


def is_admin(speaker: Column, rank: Column, command: Column, names: list[str], ranks: list[str], critical: list[str], need_rank: bool) -> Column:
    names, ranks, critical = ([T.py_normalize(x) for x in v] for v in (names, ranks, critical))
    among = lambda c, v: F.coalesce((c != "") & c.isin(*v), F.lit(False)) if v else F.lit(False)
    by_name, by_rank = among(T.normalize(speaker), names), among(T.normalize(rank), ranks)
    either = by_name | by_rank
    if need_rank and ranks and critical:
        return F.when(T.normalize(command).isin(*critical), by_rank).otherwise(either)
    return either
