"""Inverted-index statistics and BM25.

Token rows combine on the map side before they are shuffled, and a query path
keeps only rows of its own terms, so what is shuffled follows the query, not the
corpus. Corpus sizes come from document lengths alone, without an exchange of
tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.storage import dealt, materialize

# Fixed values
K1, B = 1.5, 0.75
MIN_CHUNK_CHARS = 40


def embed_text(title: Column, path: Column, heading_path: Column, text: Column) -> Column:
    """What a chunk is indexed by: names first, so their words count."""
    return F.concat(F.lit("Title: "), title, F.lit("\nPath: "), path, F.lit("\nHeading: "), F.array_join(heading_path, " > "), F.lit("\n\n"), text)


def tokenized(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, tokens"""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(T.tokenize(text), F.array().cast("array<string>")).alias("tokens"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """id, term, tf"""
    return tokens.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """id, dl: rows without tokens stay."""
    return tokens.select("id", F.size("tokens").cast("long").alias("dl"))


def doc_frequencies(tokens: DataFrame) -> DataFrame:
    """term, df: a row's distinct terms are found within the row."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, total_len, avgdl."""
    return _sized(doc_lengths(tokens).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")))


def _sized(s: DataFrame) -> DataFrame:
    return s.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0))


def idf(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def idf_table(tokens: DataFrame) -> DataFrame:
    """term, df, idf"""
    return doc_frequencies(tokens).crossJoin(F.broadcast(corpus_stats(tokens).select("n"))).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated term counts as often."""
    return queries.select("query_id", F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def hits(tokens: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, dl, term, tf, df of the postings of ``terms`` (one column, term) alone, and the row of ``corpus_stats``.

    Texts are tokenized once: an empty term, which no text holds, stands for the text itself.
    """
    rows = tokens.select("id", F.size("tokens").alias("dl"), F.explode(F.array_append("tokens", F.lit(""))).alias("term"))
    held = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    tf = materialize(rows.join(F.broadcast(held), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = _sized(tf.filter("term = ''").select((F.col("dl") * F.col("tf")).alias("dl"), "tf").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")))
    tf = tf.filter("term <> ''")
    return tf.join(F.broadcast(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), "term"), stats


def bm25_scores(tokens: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, lex of every pair that shares a term."""
    return posting_scores(*hits(tokens, query_tokens(queries)), queries, k1, b)


def posting_scores(postings: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25_scores`` from postings (see ``hits``) and the one row of corpus statistics."""
    return posting_parts(postings, stats, queries, k1, b).groupBy("query_id", "id").agg(F.sum("part").alias("lex"))


def posting_parts(postings: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, part: what each shared term adds. Dealt by id, so that sums by query and id need no exchange of pairs."""
    norm = k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    scored = dealt(postings, "id").crossJoin(F.broadcast(stats))
    scored = scored.select("id", "term", (idf(F.col("df"), F.col("n")) * (F.col("tf") * (k1 + 1.0)) / (F.col("tf") + norm)).alias("s"))
    return scored.join(F.broadcast(query_tokens(queries)), "term").select("query_id", "id", (F.col("s") * F.col("qtf")).alias("part"))


def bm25_topk(tokens: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, lex; ties go to the smaller id, sums in another order being ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("lex", 9)), "id")
    return bm25_scores(tokens, queries).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def is_table_fragment(text: Column) -> Column:
    """Mostly table rows: two or more, and all lines but one at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    return T.let(lines, lambda ls: T.let(F.size(F.filter(ls, T.is_table_line)), lambda r: (r >= 2) & (r >= F.size(ls) - 1)))


def table_groups(chunks: DataFrame) -> DataFrame:
    """source_path, heading_path, chunk_idx, start_char, place (1 first) of table fragments."""
    w = Window.partitionBy("source_path", "heading_path").orderBy("start_char", "chunk_idx")
    # texts with a row at all are dealt and looked at there: a filter would move back to the readers' tasks, an exploded flag doesn't
    held = dealt(chunks.filter(T.is_row(F.col("text"))).select("source_path", "heading_path", "chunk_idx", "start_char", "text"), "chunk_idx")
    found = held.select("source_path", "heading_path", "chunk_idx", "start_char", F.explode(F.when(is_table_fragment(F.col("text")), F.array(F.lit(True)))).alias("is")).drop("is")
    return found.withColumn("place", F.row_number().over(w))
