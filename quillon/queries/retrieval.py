"""Queries of hybrid retrieval: ``documents`` as chunks, ``embeddings`` as their matrix, ``benchmark`` as queries.

Sources and headings are built from language and source, so several chunks share
one; some are dated, and some texts end in a table. There are fewer vectors than
documents: a document or query has the vector of its number's remainder, so many
share one, and every document and item takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.operators import index as I
from quillon.operators import retrieval as R
from quillon.queries import sql as Q
from quillon.queries.text import table
from quillon.storage import materialize


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents, as chunks: every fifth as one line with a table behind it."""
    i = F.col("doc_id")
    month = F.lpad((i % 12 + 1).cast("string"), 2, "0")
    path = F.when(i % 7 == 0, F.concat(F.lit("log/"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("-"), month, F.lit("-25.md"))).otherwise(F.concat(F.lit("wiki/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit(".md")))
    text = F.when(i % 5 == 0, F.concat(F.translate("text", "\n\r|", "   "), F.lit("\n| "), F.col("lang"), F.lit(" | "), i.cast("string"), F.lit(" |\n| size | "), F.col("n_chars").cast("string"), F.lit(" |"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select(i.alias("chunk_idx"), path.alias("source_path"), F.col("source").alias("title"), F.array("lang").alias("heading_path"), text.alias("text"), (i % 100).cast("int").alias("start_char"))


def _with_vector(spark: SparkSession, d: str, rows: DataFrame, number) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.withColumn("vec_id", number % e.count()).join(e, "vec_id").drop("vec_id")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return _with_vector(spark, d, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_idx")), F.col("chunk_idx"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("whats new "), F.col("text"))).otherwise(F.col("text"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query"))
    return _with_vector(spark, d, b, F.col("query_id") + 100)


_TEXT = "CASE WHEN doc_id % 5 = 0 THEN translate(text, chr(10) || chr(13) || '|', '   ') || chr(10) || '| ' || lang || ' | ' || doc_id || ' |' || chr(10) || '| size | ' || n_chars || ' |' ELSE text END"
_PATH = "CASE WHEN doc_id % 7 = 0 THEN concat('log/', lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'), '-', lpad((doc_id % 12 + 1)::VARCHAR, 2, '0'), '-25.md') ELSE concat('wiki/', lang, '/', source, '.md') END"
_INDEXED = "concat('Title: ', source, chr(10), 'Path: ', path, chr(10), 'Heading: ', lang, chr(10), chr(10), text)"
BASE = f"""WITH
c AS (SELECT doc_id AS id, {_PATH} AS path, lang, source, {_TEXT} AS text, doc_id % 100 AS start, CASE WHEN doc_id % 7 = 0 THEN [25, doc_id % 12 + 1, doc_id % 28 + 1] END AS date, doc_id % 5 = 0 AS fragment
      FROM documents),
m AS (SELECT doc_id AS id, embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
q AS (SELECT item_id AS q, CASE WHEN item_id % 3 = 0 THEN 'whats new ' || text ELSE text END AS query, embedding AS e FROM benchmark JOIN embeddings ON vec_id = (item_id + 100) % (SELECT count(*) FROM embeddings)),
sim AS (SELECT q, id, list_dot_product(q.e::DOUBLE[], m.embedding::DOUBLE[]) AS dense FROM q, m),
tok AS (SELECT id, {Q.tokens(_INDEXED)} AS t FROM c),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest({Q.tokens('query')}) AS term FROM q) GROUP BY ALL),
lex AS (SELECT q, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) AS lex FROM qt JOIN post USING (term) JOIN df USING (term) JOIN tok USING (id), stats GROUP BY q, id),
d AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dense, 9) DESC, id) AS rd FROM sim WHERE dense >= 0.18),
l AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(lex, 9) DESC, rd) AS rl FROM d JOIN lex USING (q, id)),
n AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY date DESC, rd) AS rn FROM d JOIN c USING (id) WHERE date IS NOT NULL),
f AS (SELECT q, id, dense, path, lang, rd, rl, rn,
        1.0::DOUBLE / (60 + rd) + coalesce(1.0::DOUBLE / (60 + rl), 0) + CASE WHEN rn IS NULL THEN 0 WHEN regexp_matches({Q.compact('query')}, '{P.RECENCY}') THEN 1.0::DOUBLE / (2 + rn) ELSE -1 END AS fused
      FROM d JOIN c USING (id) JOIN q USING (q) LEFT JOIN l USING (q, id) LEFT JOIN n USING (q, id)),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(fused, 9) DESC, round(dense, 9) DESC, rd) AS rf FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY q, path, lang ORDER BY rf) AS nth FROM o),
top AS (SELECT * FROM (SELECT q, id, dense, path, lang, row_number() OVER (PARTITION BY q ORDER BY rf) AS pos FROM k WHERE rf <= 3 OR nth = 1) WHERE pos <= 5),
rare AS (SELECT DISTINCT q, term, id FROM qt JOIN post USING (term) JOIN df USING (term) WHERE df <= 8),
open AS (SELECT q, term FROM rare GROUP BY q, term HAVING NOT bool_or((q, id) IN (SELECT (q, id) FROM top))),
resc AS (SELECT * FROM (SELECT q, id, dense, row_number() OVER (PARTITION BY q ORDER BY round(lex, 9) DESC, id) AS pos
          FROM (SELECT DISTINCT q, id FROM rare JOIN open USING (q, term)) JOIN sim USING (q, id) JOIN lex USING (q, id) WHERE dense >= 0.1 AND (q, id) NOT IN (SELECT (q, id) FROM top)) WHERE pos <= 3),
res AS (SELECT q, id, dense, pos FROM top UNION ALL SELECT q, id, dense, pos + 5 FROM resc),
trig AS (SELECT q, path, lang, min(pos) AS trigger FROM res JOIN c USING (id) GROUP BY ALL),
sib AS (SELECT * FROM (SELECT q, c.id, trigger, row_number() OVER (PARTITION BY q ORDER BY trigger, start, c.id) AS nth FROM trig JOIN c USING (path, lang)
          WHERE fragment AND NOT EXISTS (SELECT 1 FROM res r WHERE r.q = trig.q AND r.id = c.id)) WHERE nth <= 12),
final AS (SELECT q, id, dense, row_number() OVER (PARTITION BY q ORDER BY trigger, nth) AS pos
          FROM (SELECT q, id, dense, pos AS trigger, 0 AS nth FROM res UNION ALL SELECT q, id, dense, trigger, nth FROM sib JOIN sim USING (q, id)))
"""


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _groups(c: DataFrame) -> DataFrame:
    return I.table_groups(c).select("source_path", F.array_join("heading_path", ">").alias("heading"), "chunk_idx", _long("place"))


def _embedded(c: DataFrame) -> DataFrame:
    return c.select("chunk_idx", F.md5(I.embed_text(F.col("title"), F.col("source_path"), F.col("heading_path"), F.col("text"))).alias("md5"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    c, q = chunks(spark, d), asked(spark, d)
    pairs, _ = R.scored(c, matrix(spark, d), q, R.MIN_SCORE)
    return R.fused_pairs(pairs, _names(c), q)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by date need no words, so none are read."""
    pairs = R.dense_pairs(matrix(spark, d), asked(spark, d), R.MIN_SCORE)
    return R.recency_rank(R.dense_rank(R.named(pairs, _names(chunks(spark, d)))))


def _names(c: DataFrame) -> DataFrame:
    return c.select("chunk_idx", "source_path", "heading_path")


def _top(spark: SparkSession, d: str) -> DataFrame:
    c, q = chunks(spark, d), asked(spark, d)
    pairs, _ = R.scored(c, matrix(spark, d), q, R.MIN_SCORE)
    return R.top_pairs(pairs, _names(c), q)


def _rescued(spark: SparkSession, d: str) -> DataFrame:
    c, q = chunks(spark, d), asked(spark, d)
    pairs, postings = R.scored(c, matrix(spark, d), q, R.RARE_FLOOR)
    pairs = materialize(pairs, "pairs")
    top = materialize(R.top_pairs(pairs, _names(c), q).select("query_id", "chunk_idx"), "top")
    return R.rare_rescue(top, pairs, postings, q, R.RARE_FLOOR)


def _found(spark: SparkSession, d: str) -> DataFrame:
    return R.search(chunks(spark, d), matrix(spark, d), asked(spark, d))


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    top = _top(spark, d).select("query_id", "chunk_idx", "pos", "source_path", "heading_path")
    return R.table_siblings(top, I.table_groups(c))


_SIB_TOP = """, t2 AS (SELECT q, path, lang, min(pos) AS trigger FROM top GROUP BY ALL)
SELECT q AS query_id, id AS chunk_idx, trigger, nth FROM (SELECT q, c.id, trigger, row_number() OVER (PARTITION BY q ORDER BY trigger, start, c.id) AS nth FROM t2 JOIN c USING (path, lang)
  WHERE fragment AND NOT EXISTS (SELECT 1 FROM top r WHERE r.q = t2.q AND r.id = c.id)) WHERE nth <= 12"""

QUERIES: dict[str, tuple] = {
    "dense_gate": (lambda s, d: R.dense_pairs(matrix(s, d), asked(s, d), R.MIN_SCORE).select("query_id", "chunk_idx", F.round("dense", 6).alias("score")), BASE + "SELECT q AS query_id, id AS chunk_idx, round(dense, 6) AS score FROM sim WHERE dense >= 0.18"),
    "dense_rank": (lambda s, d: R.dense_rank(R.dense_pairs(matrix(s, d), asked(s, d), R.MIN_SCORE)).select("query_id", "chunk_idx", _long("rank_dense")), BASE + "SELECT q AS query_id, id AS chunk_idx, rd AS rank_dense FROM d"),
    "lexical_rank": (lambda s, d: _ranked(s, d).filter("rank_lex is not null").select("query_id", "chunk_idx", _long("rank_lex")), BASE + "SELECT q AS query_id, id AS chunk_idx, rl AS rank_lex FROM l"),
    "recency_rank": (lambda s, d: _dated(s, d).filter("rank_date is not null").select("query_id", "chunk_idx", _long("rank_date")), BASE + "SELECT q AS query_id, id AS chunk_idx, rn AS rank_date FROM n"),
    "rank_fusion": (lambda s, d: _ranked(s, d).select("query_id", "chunk_idx", F.round("fused", 6).alias("fused"), _long("rank_fused")), BASE + "SELECT q AS query_id, id AS chunk_idx, round(fused, 6) AS fused, rf AS rank_fused FROM o"),
    "diverse_topk": (lambda s, d: _top(s, d).select("query_id", "chunk_idx", _long("pos")), BASE + "SELECT q AS query_id, id AS chunk_idx, pos FROM top"),
    "rare_rescue": (lambda s, d: _rescued(s, d).select("query_id", "chunk_idx", _long("pos")), BASE + "SELECT q AS query_id, id AS chunk_idx, pos FROM resc"),
    "table_siblings": (lambda s, d: _siblings(s, d).select("query_id", "chunk_idx", _long("trigger"), _long("nth")), BASE + _SIB_TOP),
    "hybrid_search": (lambda s, d: _found(s, d).select("query_id", _long("pos"), "chunk_idx", F.round("score", 6).alias("score")), BASE + "SELECT q AS query_id, pos, id AS chunk_idx, round(dense, 6) AS score FROM final"),
    "table_groups": (lambda s, d: _groups(chunks(s, d)), BASE + "SELECT path AS source_path, lang AS heading, id AS chunk_idx, row_number() OVER (PARTITION BY path, lang ORDER BY start, id) AS place FROM c WHERE fragment"),
    "embed_text": (lambda s, d: _embedded(chunks(s, d)), BASE + f"SELECT id AS chunk_idx, md5({_INDEXED}) AS md5 FROM c"),
}
