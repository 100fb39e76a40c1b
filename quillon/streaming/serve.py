"""A chat stream answered as it comes: two streaming queries over the same lines.

Rules and commands need no state. Questions pass the stateful cooldown first.
The index is read again in every micro-batch, so a rebuilt one is picked up.
Lines that repeat a message of an earlier micro-batch are dropped, and the
history switch is followed within one. A
micro-batch writes to a folder of its own, so one that runs twice leaves its
replies once.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.config import Settings
from quillon.functions import text as T
from quillon.models import Embedder
from quillon.operators import chat as C
from quillon.plans import flows
from quillon.sources import files
from quillon.storage import materialize
from quillon.streaming.chat import cooldown, run_available

STOPPING = ("stop", "quit")


_SENT = "line_id long, channel string, ts double, part int, message string"


def _put(replies: DataFrame, batch: DataFrame, path: str, epoch: int, chars: int) -> None:
    """Messages with the channel and time of the line that they answer."""
    told = replies.join(batch.select("line_id", "channel", F.col("ts").cast("double").alias("ts")), "line_id")
    told.select(F.col("line_id").cast("long").alias("line_id"), "channel", "ts", F.posexplode(T.split_for_chat(F.col("reply"), chars)).alias("part", "message")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _heard(batch: DataFrame, out_path: str, epoch: int, settings: Settings) -> DataFrame:
    """The batch without echoes of what earlier batches sent."""
    spark, path = batch.sparkSession, f"{out_path}/*/epoch=*"
    if not epoch or not files.any_below(spark, path):
        return batch
    sent = spark.read.schema(_SENT).option("recursiveFileLookup", True).parquet(out_path)
    return C.drop_echoes(batch, sent.select("channel", "ts", F.col("message").alias("text")), settings.chat)


def serve(lines: DataFrame, index_path: str, out_path: str, checkpoint: str, settings: Settings, model: Embedder | None = None, stop: threading.Event | None = None, log_path: str | None = None) -> list[StreamingQuery]:
    """Answer the stream ``lines`` (line_id, channel, ts, raw); messages go to ``out_path``, the query log to ``log_path``.

    ``stop`` is set once an allowed stop command is seen; the caller ends the
    queries then.
    """
    spark, chat = lines.sparkSession, settings.chat
    asked = C.handle_lines(lines, settings)

    def direct(batch: DataFrame, epoch: int) -> None:
        batch = materialize(_heard(batch, out_path, epoch, settings), "direct")
        ruled = batch.filter("rule_reply <> ''").select("line_id", T.finalize(F.col("rule_reply"), chat.reply_prefix).alias("reply"))
        done = materialize(flows.command_replies(batch.filter("rule_name is null").drop("command"), settings, files.read_index(spark, index_path)[0].count()), "commands")
        _put(ruled.unionByName(done.filter("reply is not null").select("line_id", "reply")), batch, f"{out_path}/direct", epoch, chat.max_chat_chars)
        if stop is not None and not done.filter(F.col("command").isin(*STOPPING) & F.col("allowed")).isEmpty():
            stop.set()

    def answered(batch: DataFrame, epoch: int) -> None:
        batch = materialize(_heard(batch, out_path, epoch, settings), "heard")
        chunks, embeddings = files.read_index(spark, index_path)
        replies = materialize(flows.answer_lines(batch.filter("allowed"), chunks, embeddings, settings, model), "replies")
        _put(replies, batch, f"{out_path}/answers", epoch, chat.max_chat_chars)
        if log_path is not None:
            # a batch's rows are a folder, so one that runs twice is logged once
            files.write_log(flows.log_answers(batch.filter("allowed"), replies, batch.filter("not allowed")), f"{log_path}/epoch={epoch}", chat.max_chat_chars)

    rest = asked.filter("rule_name is null and command is null").drop("rule_name", "rule_reply", "command").withColumn("who", T.normalize(F.col("speaker")))
    return [
        run_available(asked.filter("rule_name is not null or command is not null"), direct, f"{checkpoint}/direct"),
        run_available(cooldown(rest, "channel", "who", "ts", "line_id", chat), answered, f"{checkpoint}/answers"),
    ]
