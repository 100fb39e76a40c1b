"""Ask an index from a shell: ``python -m quillon.cli --index PATH how do i claim land``."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import config
from quillon.config import Settings
from quillon.models import Embedder
from quillon.operators import extraction as X
from quillon.plans import flows
from quillon.sources import files
from quillon.storage import materialize

CANDIDATES = 8
SHOWN_CHARS = 700


@dataclass
class Explained:
    """answer: query_id, answer. candidates: ranked, with their flags. context: pos, score, source, heading, text."""

    answer: DataFrame
    candidates: DataFrame
    context: DataFrame


def explain(spark: SparkSession, query: str, index_path: str, settings: Settings, model: Embedder | None = None) -> Explained:
    """One question's answer, and what it was chosen from."""
    chunks, embeddings = files.read_index(spark, index_path)
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    found = materialize(flows.search(chunks, embeddings, asked, settings, model), "found")
    ranked = X.rank_candidates(X.candidates(found, X.with_flags(asked)))
    shown = found.select("pos", F.round("score", 3).alias("score"), "source_path", F.array_join("heading_path", " > ").alias("heading"), F.substring("text", 1, SHOWN_CHARS).alias("text"))
    return Explained(X.extractive_answers(found, asked, settings.chat.max_chat_chars), X.debug_candidates(ranked, CANDIDATES), shown.orderBy("pos"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query", nargs="+")
    p.add_argument("--index", required=True, help="the folder of an index")
    p.add_argument("--config", help="a settings file")
    p.add_argument("--show-candidates", action="store_true")
    p.add_argument("--show-context", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    got = explain(spark, " ".join(a.query), a.index, config.load(a.config) if a.config else Settings())
    tables = [got.answer.select("answer"), *([got.candidates.orderBy("rank")] if a.show_candidates else []), *([got.context] if a.show_context else [])]
    # a few rows by their limits: candidates of one question, and its results
    for t in tables:
        for r in t.collect():
            print("\t".join(str(x) for x in r))
        print()


if __name__ == "__main__":
    main()
