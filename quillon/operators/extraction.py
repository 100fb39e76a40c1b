"""Extractive answers: candidate units, their features and rank, a confidence gate, a composed reply.

Units of a query's few results are ranked in a window by query; the ranked
candidates of a query are then one short array, in which the answer is composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import text as T

# Fixed values
PREFIX = "Wiki says: "
PRICE_PREFIX = "The pricing is set by the community (approx): "
UNITS = 12
MIN_UNIT = 20
CONTEXT_CHARS = 1800
CONTEXT_LEAST = 120


def with_flags(queries: DataFrame) -> DataFrame:
    """query_id, query, and what the query asks for."""
    q = F.col("query")
    return queries.select(
        "query_id", "query", T.query_terms(q).alias("terms"), P.howto_query(q).alias("howto"), P.definition_query(q).alias("definition"), P.cost_query(q).alias("cost"),
        P.command_query(q).alias("command"), P.navigation_query(q).alias("navigation"), P.price_query(q).alias("price"), P.recency_query(q).alias("recency"),
    )


def candidates(results: DataFrame, flagged: DataFrame) -> DataFrame:
    """Feature columns of each unit of each result.

    ``results``: query_id, pos, score, text. Adds unit_pos, unit, cleaned,
    key_cover, is_definition, overlap, intent and the flags of a candidate.
    """
    held = results.select("query_id", "pos", "score", "text").join(flagged.hint("merge"), "query_id")
    # what several features read is computed once: here within the array, so that no filter repeats it
    units = F.transform(T.candidate_units(F.col("text")), lambda u: F.struct(u.alias("unit"), T.reformat(u).alias("cleaned")))
    d = held.select("query_id", "pos", "score", *[c for c in flagged.columns if c != "query_id"], F.posexplode(units).alias("unit_pos", "u"))
    unit, terms, cost = F.col("unit"), F.col("terms"), F.col("cost")
    d = d.withColumns({"unit": F.col("u.unit"), "cleaned": F.col("u.cleaned")}).drop("u")
    d = d.filter((F.length("cleaned") >= MIN_UNIT) & ((F.col("unit_pos") < UNITS) | F.arrays_overlap(terms, T.words(unit))))
    cleaned, compact = F.col("cleaned"), F.col("compact")
    digit = lambda w: w.rlike(r"^\d+$")
    d = d.withColumns({"cells": F.when(T.is_row(unit), T.cells(unit)), "compact": T.compact(cleaned), "normal": T.normalize(cleaned), "has_command": P.has_command(cleaned)})
    key_cell = F.get("cells", F.lit(0))
    keyed = F.col("cells").isNotNull() & (F.size("cells") >= 2) & ~F.startswith(key_cell, F.lit("/"))
    d = d.withColumns({"keyed": keyed, "key": F.when(keyed, T.words(key_cell)).otherwise(F.array().cast("array<string>")), "words": T.distinct_words(compact), "has_requirement": compact.rlike(P.REQUIREMENT), "warning_like": compact.rlike(P.WARNING), "has_value": P.cost_value_in(F.col("normal"))})
    scoped = F.array_union(F.filter("words", lambda w: ~digit(w)), F.filter("key", digit))
    named = F.size(F.array_intersect(terms, F.col("key"))) / F.size("key")
    value, warning = F.col("has_value"), F.col("warning_like")
    steps = [
        F.when(warning & ~cost, F.lit(-P.W_WARNING)).otherwise(F.lit(0.0)),
        F.when(cost, F.when(value, F.lit(P.W_COST_VALUE)).when(warning, F.lit(-P.W_COST_WARNING)).otherwise(F.lit(0.0))).when(T.is_row(unit) & P.pricelike_cells(F.col("cells")), F.lit(-P.W_PRICE_ROW)).otherwise(F.lit(0.0)),
    ]
    return d.withColumns({
        "key_cover": F.when(F.col("keyed") & (F.size("key") > 0) & ~(cost & ~value), named).otherwise(F.lit(0.0)),
        "overlap": F.size(F.array_intersect(terms, F.when(F.col("keyed"), scoped).otherwise(F.col("words")))),
        "is_definition": F.when(F.col("definition"), P.definition_in(terms, compact)).otherwise(0),
        "intent": P.intent_in(compact, cleaned, F.col("howto")) + P.alignment_in(compact, F.col("has_command"), F.col("command"), F.col("navigation")) + steps[0] + steps[1],
    }).withColumn("key_match", F.col("key_cover") >= 1.0).drop("cells", "compact", "key", "words")


def rank_candidates(cands: DataFrame) -> DataFrame:
    """Each normal form once, best first: with rank from 1."""
    order = [F.desc("key_cover"), F.desc("is_definition"), F.desc("overlap"), F.desc(F.round("intent", 9)), F.desc("score"), F.length("cleaned"), F.col("pos"), F.col("unit_pos")]
    one = F.row_number().over(Window.partitionBy("query_id", "normal").orderBy(*order))
    d = cands.withColumn("nth", one).filter("nth = 1").drop("nth", "normal")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def debug_candidates(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.filter(F.col("rank") <= n).select("query_id", "rank", "overlap", F.bround("intent", 3).alias("intent"), F.bround("score", 3).alias("retrieval_score"), "has_command", "has_requirement", "warning_like", F.col("cleaned").alias("text"))


def _listed(ranked: DataFrame) -> DataFrame:
    """query_id, cands (a query's candidates as an array in order), and what the query asks for."""
    c = F.struct("rank", "overlap", "score", F.col("cleaned").alias("text"), "has_command", "has_requirement", "warning_like", "key_match")
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(c)).alias("cands"), *[F.first(x).alias(x) for x in ("terms", "howto", "cost", "command", "navigation", "price")])


def compose(cands: Column, howto: Column, command: Column, cost: Column) -> Column:
    """The answer text of ranked candidates."""
    first = lambda test: F.get(F.filter(cands, test), F.lit(0))
    top = cands[0]

    def with_second(p: Column) -> Column:
        fits = lambda c: (p["has_command"] & c["has_requirement"]) | (p["has_requirement"] & c["has_command"])
        second = first(lambda c: (c["text"] != p["text"]) & (c["overlap"] > 0) & ~(c["warning_like"] & ~cost) & fits(c))
        return T.let(second, lambda s: F.when(s.isNull(), p["text"]).otherwise(T.dedupe_phrases(F.concat(p["text"], F.lit(" "), s["text"]))))

    def promoted(p: Column) -> Column:
        # the best scored command that the embedder ranks at least as high, the first of ties
        rivals = F.filter(cands, lambda c: (c["overlap"] > 0) & c["has_command"] & (c["score"] >= p["score"]))
        best = F.array_max(F.transform(rivals, lambda c: F.struct(c["score"].alias("s"), (-c["rank"]).alias("r"), c.alias("c"))))
        return F.when(p["has_command"] | (F.size(rivals) == 0), p).otherwise(best["c"])

    helpful = first(lambda c: (c["overlap"] > 0) & (c["has_command"] | c["has_requirement"] | ~c["warning_like"]))
    steps = T.let(T.let(F.coalesce(helpful, top), promoted), with_second)
    plain = F.when(command, F.coalesce(first(lambda c: c["has_command"] & (c["overlap"] > 0))["text"], top["text"])).otherwise(top["text"])
    return F.when(howto, steps).otherwise(plain)


def answer_prefix(price: Column) -> Column:
    return F.when(price, F.lit(PRICE_PREFIX)).otherwise(F.lit(PREFIX))


def extractive_answers(results: DataFrame, queries: DataFrame, max_chars: int = 248) -> DataFrame:
    """query_id, answer of every query: the unknown reply where nothing is found or trusted."""
    return answers_and_texts(results, queries, max_chars, 0).select("query_id", "answer")


def answers_and_texts(results: DataFrame, queries: DataFrame, max_chars: int, n: int) -> DataFrame:
    """``queries`` with answer (see ``extractive_answers``) and texts (see ``candidate_texts``; empty if n is 0), from one ranking."""
    listed = _listed(rank_candidates(candidates(results, with_flags(queries))))
    top = F.col("cands")[0]
    unsure = P.low_confidence(F.col("terms"), top["text"], top["score"], top["key_match"], top["has_command"], F.col("command"), F.col("navigation"), F.col("howto"))
    text = T.reformat(compose(F.col("cands"), F.col("howto"), F.col("command"), F.col("cost")))
    answer = F.when(unsure, F.lit(T.UNKNOWN_REPLY)).otherwise(T.truncate(F.concat(answer_prefix(F.col("price")), text), max_chars))
    best = F.transform(F.slice("cands", 1, n), lambda c: c["text"]) if n > 0 else None
    said = listed.select("query_id", answer.alias("said"), *([best.alias("best")] if n > 0 else []))
    d = queries.join(said.hint("merge"), "query_id", "left").withColumn("answer", F.coalesce("said", F.lit(T.UNKNOWN_REPLY))).drop("said")
    return _with_fallback(d, results) if n > 0 else d.withColumn("texts", F.array().cast("array<string>"))


def _with_fallback(d: DataFrame, results: DataFrame) -> DataFrame:
    """``d`` with texts: best; where that is null the first result's text, else none."""
    first = results.groupBy("query_id").agg(F.min_by("text", "pos").alias("__first"))
    whole = T.reformat(F.trim(F.translate("__first", "\n", " ")))
    texts = F.when(F.col("best").isNotNull(), F.col("best")).otherwise(T.let(whole, lambda w: F.when(F.length(w) > 0, F.array(w)).otherwise(F.array().cast("array<string>"))))
    return d.join(first.hint("merge"), "query_id", "left").withColumn("texts", texts).drop("best", "__first")


def candidate_texts(results: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, texts: the n best; else the first result's text, else none."""
    if n <= 0:
        return queries.select("query_id", F.array().cast("array<string>").alias("texts"))
    ranked = rank_candidates(candidates(results, with_flags(queries))).filter(F.col("rank") <= n)
    best = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cleaned"))), lambda c: c["cleaned"]).alias("best"))
    return _with_fallback(queries.select("query_id").join(best.hint("merge"), "query_id", "left"), results)


def build_context(results: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context: numbered blocks within a running budget; the last may be cut.

    ``results``: query_id, pos, score, source_path, title, heading_path, text.
    """
    heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("title"))
    r = results.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    block = F.concat(F.format_string("[Wiki chunk %d] source=%s score=%.3f\n", "i", "source_path", "score"), F.lit("Title: "), F.col("title"), F.lit("\nHeading: "), heading, F.lit("\nText: "), T.strip(F.col("text")))
    listed = r.select("query_id", "i", block.alias("block")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "block"))).alias("blocks"))

    def step(a: Column, x: Column) -> Column:
        left = F.lit(max_chars) - a["total"]
        fits = F.length(x["block"]) <= left
        text = F.when(fits, x["block"]).otherwise(T.truncate(x["block"], left))
        ended = a["done"] | (~fits & (left <= CONTEXT_LEAST))
        put = T.let(text, lambda t: F.struct((a["total"] + F.length(t) + 2).alias("total"), F.concat(a["out"], F.array(t)).alias("out"), (a["total"] + F.length(t) + 2 >= max_chars).alias("done")))
        return F.when(ended, F.struct(a["total"].alias("total"), a["out"].alias("out"), F.lit(True).alias("done"))).otherwise(put)

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))
    return listed.select("query_id", F.aggregate("blocks", start, step, lambda a: F.array_join(a["out"], "\n\n")).alias("context"))
