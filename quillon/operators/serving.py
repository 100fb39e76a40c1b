"""Requests, prompts, generation modes, source links and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.functions import text as T
from quillon.models import Generator, generate
from quillon.operators import extraction as X

# Fixed values
MESSAGE_CHARS = 800
SESSION_CHARS = 80
LINKS = 3
SELECTOR_RULES = (
    "You are a strict Minecraft wiki answer selector.\n"
    "Task: choose exactly one best candidate snippet for the question.\n"
    "Rules:\n"
    "- Return only one integer.\n"
    "- Return 0 if none of the snippets answer the question.\n"
    "- Prefer specific factual snippets; avoid gibberish/noise.\n"
    "- Do not explain.\n"
)
ANSWER_RULES = (
    "Answer rules:\n"
    "- Keep it concise (max 3 short sentences).\n"
    "- Do not say 'based on the context' or similar preamble.\n"
    "- If unsure from wiki context, answer exactly: "
)


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests of 1 to 800 characters, with a usable session id: the given one cleaned, else a new one."""
    given = F.coalesce("session_id", F.lit(""))
    ok = F.length("message").between(1, MESSAGE_CHARS) & (F.length(given) <= SESSION_CHARS)
    return requests.filter(ok).withColumn("session_id", F.coalesce(T.session_id(given), T.new_session_id()))


def source_links(results: DataFrame, base_url: str, n: int = LINKS) -> DataFrame:
    """query_id, place, title, url: the first n distinct addresses in result order."""
    title = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("title"))
    d = results.select("query_id", "pos", F.coalesce(F.nullif(title, F.lit("")), F.lit("Wiki page")).alias("title"), T.path_to_url(F.col("source_path"), base_url).alias("url")).filter("url is not null")
    first = d.groupBy("query_id", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("place") <= n).select("query_id", "place", "title", "url")


def responses(replies: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, reply, links: addresses in the reply, then those of its sources that it lacks."""
    s = links.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))
    none = F.array().cast("array<string>")
    return replies.join(s, "query_id", "left").select("query_id", "reply", F.array_distinct(F.concat(T.urls(F.col("reply")), F.coalesce("urls", none))).alias("links"))


def prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame, settings: Settings) -> DataFrame:
    """query_id, prompt. ``history``: query_id, turn, role, content; the last messages are shown."""
    n = settings.model.max_context_messages
    recent = history.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn")))).filter(F.col("__n") <= n)
    lines = recent.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")))), lambda x: x["line"]), "\n").alias("recent"))
    d = queries.join(contexts.hint("merge"), "query_id", "left").join(lines.hint("merge"), "query_id", "left")
    shown = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    parts = [
        F.lit(f"<|system|>\n{settings.prompt.system}\n{settings.prompt.answer_style}\n</s>\n<|user|>\nRecent chat context, may be empty:\n"), shown("recent", "(none)"),
        F.lit("\n\nWiki context:\n"), shown("context", "(no relevant wiki context)"), F.lit("\n\nQuestion: "), F.col("query"),
        F.lit(f'\n{ANSWER_RULES}"{T.UNKNOWN_REPLY}"\n\nAnswer for Minecraft chat:\n</s>\n<|assistant|>\n'),
    ]
    return d.select("query_id", F.concat(*parts).alias("prompt"))


def selector_prompt(query: Column, candidates: Column) -> Column:
    listed = F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.concat(F.lit(f"<|system|>\n{SELECTOR_RULES}</s>\n<|user|>\nQuestion: "), query, F.lit("\n\nCandidates:\n"), listed, F.lit("\n\nAnswer with one integer only:\n</s>\n<|assistant|>\n"))


def answers(queries: DataFrame, results: DataFrame, settings: Settings, model: Generator | None = None, context: DataFrame | None = None) -> DataFrame:
    """query_id, reply by the mode set: extractive, selected by a model, or generated.

    Without a model every mode is extractive. A model is asked only where the
    extractive answer is known, so a weak match costs no generation.
    """
    selects = model is not None and settings.model.llm_select_extractive
    d = X.answers_and_texts(results, queries, settings.chat.max_chat_chars, settings.model.llm_select_max_candidates if selects else 0)
    known = F.col("answer") != T.UNKNOWN_REPLY
    if selects:
        # a row's own prompt is null where the model isn't asked: no join brings the answers back
        asked = F.when(F.size("texts") > 0, F.coalesce(selector_prompt(F.col("query"), F.col("texts")), F.lit("")))
        d = d.withColumn("choice", T.selector_choice(generate(asked, model), F.size("texts")))
        picked = F.concat(X.answer_prefix(F.coalesce(T.compact(F.col("query")).rlike(r"\bpric(?:e|es|ing)\b"), F.lit(False))), T.sanitize(F.get("texts", F.col("choice") - 1)))
        chosen = F.when(F.col("choice") == 0, F.lit(T.UNKNOWN_REPLY)).when(F.col("choice") > 0, picked)
        return d.select("query_id", F.coalesce(chosen, "answer").alias("reply"))
    if model is not None and settings.model.enabled and context is not None:
        d = d.join(context.select("query_id", F.coalesce("prompt", F.lit("")).alias("prompt")).hint("merge"), "query_id", "left")
        d = d.select("query_id", "answer", generate(F.when(known, F.col("prompt")), model).alias("said"))
        return d.select("query_id", F.coalesce(T.clean_generation(F.col("said")), "answer").alias("reply"))
    return d.select("query_id", F.col("answer").alias("reply"))
