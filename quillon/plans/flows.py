"""The entry points: build an index, search and answer, handle chat lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.functions import text as T
from quillon.models import Embedder, Generator, embed, hashed_embedder
from quillon.operators import chat as C
from quillon.operators import chunking, extraction, retrieval, serving
from quillon.operators import index as I
from quillon.sources import files
from quillon.storage import materialize


def build_index(spark: SparkSession, root: str, path: str, settings: Settings, model: Embedder | None = None, name: str = "hashed") -> int:
    """Files below ``root`` as an index at ``path``; the number of chunks. Fails if there is none."""
    r = settings.retrieval
    chunks = materialize(chunking.load_chunks(files.read_files(spark, root, r.wiki_globs), r.chunk_chars, r.chunk_overlap), "chunks")
    n = chunks.count()
    if not n:
        raise RuntimeError(f"no chunks below {root}")
    files.write_index(chunks, embeddings_of(chunks, model), path, name, root)
    return n


def embeddings_of(chunks: DataFrame, model: Embedder | None = None) -> DataFrame:
    text = I.embed_text(F.col("title"), F.col("source_path"), F.col("heading_path"), F.col("text"))
    return chunks.select("chunk_idx", embed(text, model or hashed_embedder()).alias("embedding"))


def with_embedding(queries: DataFrame, model: Embedder | None = None) -> DataFrame:
    return queries if "embedding" in queries.columns else queries.withColumn("embedding", embed(F.col("query"), model or hashed_embedder()))


def search(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, settings: Settings, model: Embedder | None = None) -> DataFrame:
    """Results with their chunks: query_id, pos, score, chunk_idx, source_path, title, heading_path, text."""
    r = settings.retrieval
    found = retrieval.search(chunks, embeddings, with_embedding(queries, model), r.top_k, r.min_score)
    return found.join(chunks.select("chunk_idx", "source_path", "title", "heading_path", "text"), "chunk_idx")


def answer(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, settings: Settings, model: Embedder | None = None, generator: Generator | None = None, history: DataFrame | None = None) -> DataFrame:
    """query_id, reply, links."""
    results = materialize(search(chunks, embeddings, queries, settings, model), "results")
    prompt = None
    if generator is not None and settings.model.enabled:
        none = queries.sparkSession.createDataFrame([], "query_id long, turn long, role string, content string")
        prompt = serving.prompts(queries, extraction.build_context(results, settings.retrieval.max_context_chars), history if history is not None else none, settings)
    replies = serving.answers(queries, results, settings, generator, prompt)
    links = serving.source_links(results, settings.chat.public_wiki_base_url)
    return serving.responses(replies.withColumn("reply", T.finalize(F.col("reply"), settings.chat.reply_prefix)), links)


def answer_lines(lines: DataFrame, chunks: DataFrame, embeddings: DataFrame, settings: Settings, model: Embedder | None = None) -> DataFrame:
    """line_id, reply of accepted questions (line_id, question): a greeting gets a hint, anything else an answer."""
    chat = settings.chat
    hello = T.is_greeting(F.col("question"), chat.hi_patterns) | (T.strip(F.col("question")) == "")
    greeted = lines.filter(hello).select("line_id", T.finalize(F.lit(f"Meow. Ask me a wiki question with {settings.rules.command_prefix}."), chat.reply_prefix).alias("reply"))
    queries = lines.filter(~hello).select(F.col("line_id").alias("query_id"), F.col("question").alias("query"))
    answered = answer(chunks, embeddings, queries, settings, model).select(F.col("query_id").alias("line_id"), "reply")
    return greeted.unionByName(answered)


def command_replies(commands: DataFrame, settings: Settings, n_chunks: int) -> DataFrame:
    """``commands`` (line_id, channel, ts, speaker, rank, question) with command, allowed, reason and reply, the history switch followed."""
    ruled = C.dispatch(commands, settings, n_chunks).drop("is_admin", "reply", "reason")
    return C.dispatch(C.history_switch(ruled, settings.chat.history_enabled).drop("command", "allowed"), settings, n_chunks, F.col("history_on"))


def log_answers(accepted: DataFrame, answered: DataFrame, dropped: DataFrame) -> DataFrame:
    """rank, speaker, query, reply, dropped_reason of the questions that were answered, or dropped by the cooldown."""
    done = accepted.join(answered, "line_id").select("rank", "speaker", F.col("question").alias("query"), "reply", F.lit(None).cast("string").alias("dropped_reason"))
    return done.unionByName(dropped.select("rank", "speaker", F.col("question").alias("query"), F.lit(None).cast("string").alias("reply"), F.lit("cooldown").alias("dropped_reason")))


def handle_chat(lines: DataFrame, chunks: DataFrame, embeddings: DataFrame, settings: Settings, model: Embedder | None = None, sent: DataFrame | None = None, log_path: str | None = None, audit_path: str | None = None) -> DataFrame:
    """line_id, part, message of what is sent for raw lines (line_id, channel, ts, raw), in order.

    ``sent``: what the bot itself has sent (channel, ts, text); lines that repeat
    it are dropped. Answers and drops are added to the query log at ``log_path``,
    commands to the audit log at ``audit_path``.
    """
    chat = settings.chat
    asked = C.handle_lines(lines, settings)
    asked = materialize(asked if sent is None else C.drop_echoes(asked, sent, chat), "asked")
    ruled = asked.filter("rule_reply is not null and rule_reply <> ''").select("line_id", T.finalize(F.col("rule_reply"), chat.reply_prefix).alias("reply"))
    rest = asked.filter("rule_name is null")
    commands = command_replies(rest.filter("command is not null").drop("command"), settings, chunks.count())
    if audit_path is not None and chat.log_command_events:
        commands = materialize(commands, "commands")
        files.append_audit(commands, audit_path)
    commands = commands.select("line_id", "reply")
    cooled = materialize(C.cooldown(rest.filter("command is null").drop("command").withColumn("who", T.normalize(F.col("speaker"))), "channel", "who", "ts", "line_id", chat), "cooled")
    answered = answer_lines(cooled.filter("allowed"), chunks, embeddings, settings, model)
    if log_path is not None:
        answered = materialize(answered, "answered")
        files.append_log(log_answers(cooled.filter("allowed"), answered, cooled.filter("not allowed")), log_path, chat.max_chat_chars)
    replies = ruled.unionByName(commands).unionByName(answered)
    return replies.select("line_id", F.posexplode(T.split_for_chat(F.col("reply"), chat.max_chat_chars)).alias("part", "message"))
