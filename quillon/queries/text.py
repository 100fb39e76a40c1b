"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import text as T
from quillon.operators import chunking as K
from quillon.operators import index as I
from quillon.queries import sql as Q
from quillon.storage import dealt

UNKNOWN = T.UNKNOWN_REPLY.replace("'", "''")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _each(name: str, id_col: str, **cols) -> object:
    """A projection of a whole table."""
    return lambda spark, d: table(spark, d, name).select(id_col, *[f().alias(c) for c, f in cols.items()])


def _text() -> Column:
    return F.col("text")


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.tokenized(docs, "doc_id", _text())


def dealt_tokens(spark: SparkSession, d: str) -> DataFrame:
    """``doc_tokens``, tokenized where counts by document need no exchange of tokens."""
    return I.tokenized(dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", _text())


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOK = f"tok AS (SELECT doc_id AS id, {Q.tokens('text')} AS t FROM documents)"
BM25 = f"""{TOK},
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL),
len AS (SELECT id, len(t) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({Q.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
lex AS (SELECT item_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS lex
        FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (id), stats GROUP BY item_id, id)"""


def _terms_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.term_frequencies(dealt_tokens(spark, d)).select(F.col("id").alias("doc_id"), "term", "tf")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return I.bm25_topk(dealt_tokens(spark, d), questions(spark, d)).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("lex", 6).alias("score"))


def _chat_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.split_for_chat(_text(), 120)).alias("part", "message")).withColumn("part", F.col("part").cast("long"))


def _last(c: str) -> str:
    return f"greatest({', '.join(Q.rfind(c, x) for x in ('. ', '; ', ', ', ' '))})"


CHAT_PARTS = f"""
WITH RECURSIVE s AS (
  SELECT conv_id, turn, 0::BIGINT AS part, '' AS message, {Q.sanitize('text')} AS rest FROM conversations
  UNION ALL
  SELECT conv_id, turn, part + 1, trim(substr(rest, 1, upto)), trim(substr(rest, upto + 1))
  FROM (SELECT *, CASE WHEN length(rest) <= 120 THEN length(rest) WHEN {_last('rest[1:120]')} < 54 THEN 120 ELSE {_last('rest[1:120]')} END AS upto FROM s WHERE rest <> ''))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY part) - 1 AS part, message FROM s WHERE part > 0 AND message <> ''
"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(T.urls(F.concat_ws(" ", "url", "html"))).alias("place", "link")).withColumn("place", F.col("place").cast("long"))


URLS = r"""
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first) - 1)::BIGINT AS place, link FROM (
  SELECT page_id, link, min(i) AS first FROM (
    SELECT page_id, regexp_replace(u, '[.,;:]+$', '') AS link, i
    FROM (SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (SELECT page_id, regexp_extract_all(concat_ws(' ', url, html), '(?i)https?://[^\s)>"]+') AS us FROM pages)))
  GROUP BY ALL)
"""


def _path() -> Column:
    i = F.col("doc_id")
    return F.concat(F.when(i % 4 == 0, "src/content/docs/").when(i % 4 == 1, "docs/").when(i % 4 == 2, "/content/docs/").otherwise(""), F.col("lang"), F.lit("/"), F.col("source"), F.when(i % 3 == 0, ".mdx").when(i % 3 == 1, "/index.MD").otherwise(".txt"))


PATH = "concat(CASE doc_id % 4 WHEN 0 THEN 'src/content/docs/' WHEN 1 THEN 'docs/' WHEN 2 THEN '/content/docs/' ELSE '' END, lang, '/', source, CASE doc_id % 3 WHEN 0 THEN '.mdx' WHEN 1 THEN '/index.MD' ELSE '.txt' END)"


def _unit() -> Column:
    return F.concat(F.lit("## | "), F.col("p_name"), F.lit(" |  `"), F.col("p_brand"), F.lit("` | |"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.when(F.col("p_size") % 2 == 0, "$ |").otherwise("$ for a very good one |"))


UNIT = "concat('## | ', p_name, ' |  `', p_brand, '` | |', CAST(p_retailprice AS DECIMAL(12,2))::VARCHAR, CASE WHEN p_size % 2 = 0 THEN '$ |' ELSE '$ for a very good one |' END)"

_ASKED = ("how do i create a", "what is the price of", "how much is", "whats new with", "where to warp to", "what command for", "define", "is there a")


def _question() -> Column:
    at = F.array(*map(F.lit, _ASKED))
    return F.concat(at[(F.col("p_partkey") % len(_ASKED)).cast("int")], F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("?"))


QUESTION = f"concat([{', '.join(repr(x) for x in _ASKED)}][p_partkey % {len(_ASKED)} + 1], ' ', p_name, ' ', p_size, '?')"


def _long(c: Column) -> Column:
    return c.cast("long")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    q = _question()
    flags = {"price": P.price_query, "recency": P.recency_query, "howto": P.howto_query, "definition": P.definition_query, "cost": P.cost_query, "command": P.command_query, "navigation": P.navigation_query}
    return table(spark, d, "part").select("p_partkey", *[_long(f(q)).alias(n) for n, f in flags.items()], F.array_join(F.array_sort(T.query_terms(q)), " ").alias("terms"))


_QC = Q.compact("q")
FLAGS = f"""
SELECT p_partkey, {Q.has(_QC, P.PRICE)}::BIGINT AS price, {Q.has(_QC, P.RECENCY)}::BIGINT AS recency,
  (NOT {Q.has(_QC, P.QUANTITY)} AND {Q.has(_QC, P.HOWTO)})::BIGINT AS howto, {Q.has(_QC, P.DEFINITION)}::BIGINT AS definition,
  ({Q.has(_QC, P.HOW_MUCH)} OR {Q.has(_QC, P.COST)})::BIGINT AS cost, {Q.has(_QC, P.COMMAND)}::BIGINT AS command, {Q.has(_QC, P.NAVIGATION)}::BIGINT AS navigation,
  array_to_string(list_sort({Q.terms('q')}), ' ') AS terms
FROM (SELECT p_partkey, {QUESTION} AS q FROM part)
"""

_SAID = ("You must have", "Use /warp", "Failure costs", "The upkeep of", "It means", "Set the", "At least $", "Plain")


def _sentence() -> Column:
    at = F.array(*map(F.lit, _SAID))
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" for "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("$"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" for "), F.col("p_size").cast("string"), F.lit(" dollars"))).otherwise("")
    return F.concat(at[(F.col("p_partkey") % len(_SAID)).cast("int")], F.lit(" "), F.col("p_name"), tail)


SENTENCE = f"concat([{', '.join(repr(x) for x in _SAID)}][p_partkey % {len(_SAID)} + 1], ' ', p_name, CASE p_size % 3 WHEN 0 THEN ' for ' || CAST(p_retailprice AS DECIMAL(12,2))::VARCHAR || '$' WHEN 1 THEN ' for ' || p_size || ' dollars' ELSE '' END)"


def _sentence_flags(spark: SparkSession, d: str) -> DataFrame:
    s = _sentence()
    flags = {"warning": P.warning_like, "slash": P.has_command, "requirement": P.has_requirement, "action": P.has_action, "amount": P.has_cost_value}
    scores = {"intent": P.intent_score(s, F.lit(True)), "alignment": P.alignment(s, F.lit(True), F.lit(True))}
    return table(spark, d, "part").select("p_partkey", *[_long(f(s)).alias(n) for n, f in flags.items()], *[F.round(c, 6).alias(n) for n, c in scores.items()], _long(P.definition_match(T.query_terms(_question()), s)).alias("defines"))


_SC, _SN = Q.compact("s"), Q.norm("s")
_NUMBER = Q.has(_SN, r"\b[0-9][0-9\s,._]*\b")
SENTENCE_FLAGS = rf"""
SELECT p_partkey, {Q.has(_SC, P.WARNING)}::BIGINT AS warning, {Q.has('lower(s)', '(^|\\s)/[a-z0-9_]+')}::BIGINT AS slash, {Q.has(_SC, P.REQUIREMENT)}::BIGINT AS requirement,
  ({Q.has(_SN, '(^|\\s)/[a-z0-9_]+')} OR {Q.has(_SC, P.ACTION)})::BIGINT AS action,
  ({Q.has(_SN, r'\$\s*[0-9]')} OR {Q.has(_SN, r'[0-9][0-9,.\s]*\$')} OR ({_NUMBER} AND ({Q.has(_SN, r'\b(cost|price|money|upkeep|fee|tax)\b')} OR {Q.has(_SN, r'\b(in-game money|dollars?)\b')})))::BIGINT AS amount,
  round(CASE WHEN {Q.has(_SC, P.STEPS)} THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN contains(s, '/') THEN 0.25 ELSE 0 END - CASE WHEN {Q.has(_SC, P.FAILING)} THEN 0.15 ELSE 0 END, 6) AS intent,
  round(CASE WHEN {Q.has('lower(s)', '(^|\\s)/[a-z0-9_]+')} THEN 0.45 ELSE -0.10 END::DOUBLE - CASE WHEN {Q.has(_SC, P.SETTING)} THEN 0.3 ELSE 0 END + CASE WHEN {Q.has(_SC, P.GOING)} THEN 0.2 ELSE 0 END, 6) AS alignment,
  (CASE WHEN NOT {Q.has(_SC, P.DEFINING)} THEN 0 WHEN list_has_any({Q.terms('q')}, {Q.words('s')}[1:4]) THEN 2 WHEN list_has_any({Q.terms('q')}, {Q.words('s')}) THEN 1 ELSE 0 END)::BIGINT AS defines
FROM (SELECT p_partkey, {QUESTION} AS q, {SENTENCE} AS s FROM part)
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    u = _unit()
    return table(spark, d, "part").select("p_partkey", _long(F.size(T.cells(u))).alias("n_cells"), P.key_cell(u).alias("key"), F.array_join(F.array_sort(P.key_words(u)), " ").alias("key_words"), _long(P.pricelike(u)).alias("pricelike"), T.reformat(u).alias("text"))


_TAIL = "array_to_string(c[2:], ' ')"
ROWS = rf"""
SELECT p_partkey, len(c)::BIGINT AS n_cells, c[1] AS key, array_to_string(list_sort(list_distinct({Q.words('c[1]')})), ' ') AS key_words,
  (length(regexp_replace(regexp_replace({_TAIL}, '[0-9,.\s$%]+', '', 'g'), '(?i)\b(exp|xp)\b', '', 'g')) <= 3 AND regexp_matches({_TAIL}, '[$0-9]'))::BIGINT AS pricelike, {Q.reformat('u')} AS text
FROM (SELECT p_partkey, u, {Q.cells('u')} AS c FROM (SELECT p_partkey, {UNIT} AS u FROM part))
"""


def _dates(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("log/"), F.date_format("o_orderdate", "dd-MM-yy"), F.when(F.col("o_orderkey") % 2 == 0, ".md").otherwise("x.md"))
    x = P.source_date(path)
    return table(spark, d, "orders").select("o_orderkey", *[_long(F.coalesce(x[n], F.lit(-1))).alias(n) for n in ("yy", "mm", "dd")])


DATES = """
SELECT o_orderkey, CASE WHEN ok THEN year(o_orderdate) % 100 ELSE -1 END AS yy, CASE WHEN ok THEN month(o_orderdate) ELSE -1 END AS mm, CASE WHEN ok THEN day(o_orderdate) ELSE -1 END AS dd
FROM (SELECT *, o_orderkey % 2 = 0 AS ok FROM orders)
"""


def _generated() -> Column:
    return F.concat(F.lit("Based on the provided context, "), F.col("text"), F.lit(" Let me know if you need anything else!</s> Question: junk"))


# markers and blanks of texts are one space by now, and the closer ends the text
_MADE = Q.sanitize("regexp_replace(concat('Based on the provided context, ', text, ' Let me know if you need anything else!'), '(?i)^based on the provided context[:,\\s-]*', '')")
GENERATED = f"""
SELECT conv_id, turn, CASE WHEN t = '' OR contains({Q.norm('t')}, 'dont know') OR contains({Q.norm('t')}, 'don''t know') THEN '{UNKNOWN}' ELSE t END AS reply FROM (
  SELECT conv_id, turn, CASE WHEN len(p) <= 2 THEN m ELSE array_to_string(p[1:2], ' ') END AS t FROM (
    SELECT conv_id, turn, m, list_filter(string_split(regexp_replace(m, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS p
    FROM (SELECT conv_id, turn, {Q.sanitize("regexp_replace(m0, '(?i)let me know if you need anything else!$', '')")} AS m FROM (SELECT conv_id, turn, {_MADE} AS m0 FROM conversations))))
"""


def _markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(K.clean_markup(F.col("html"))).alias("md5"))


_M = "replace(html, chr(13) || chr(10), chr(10))"
for _p, _r in ((r"(?i)<Tabs>[\s\S]*?</Tabs>", ""), ("<[^>]+>", " "), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), ("[*_]{1,3}", ""), (r"\n{3,}", "' || chr(10) || chr(10) || '")):
    _M = f"regexp_replace({_M}, '{_p}', '{_r}', 'g')"
MARKUP = f"SELECT page_id, md5({Q.strip(_M)}) AS md5 FROM pages"

QUERIES: dict[str, tuple] = {
    "normalize_text": (_each("documents", "doc_id", md5=lambda: F.md5(T.normalize(_text()))), f"SELECT doc_id, md5({Q.norm('text')}) AS md5 FROM documents"),
    "compact_text": (_each("documents", "doc_id", md5=lambda: F.md5(T.compact(_text()))), f"SELECT doc_id, md5({Q.compact('text')}) AS md5 FROM documents"),
    "tokenize_text": (_each("documents", "doc_id", n=lambda: _long(F.size(T.tokenize(_text()))), md5=lambda: F.md5(F.array_join(T.tokenize(_text()), " "))), f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS md5 FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)"),
    "query_terms": (_each("benchmark", "item_id", terms=lambda: F.array_join(F.array_sort(T.query_terms(_text())), " ")), f"SELECT item_id, array_to_string(list_sort({Q.terms('text')}), ' ') AS terms FROM benchmark"),
    "split_sentences": (_each("documents", "doc_id", n=lambda: _long(F.size(T.split_sentences(_text()))), md5=lambda: F.md5(F.array_join(T.split_sentences(_text()), "|"))), f"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS md5 FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)"),
    "truncate_text": (_each("documents", "doc_id", cut=lambda: T.truncate(_text(), 120)), f"SELECT doc_id, {Q.truncate('text', 120)} AS cut FROM documents"),
    "sanitize_chat": (lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.sanitize(F.concat(_text(), F.lit("\t @everyone @here"))).alias("message")), f"SELECT conv_id, turn, {Q.sanitize('concat(text, chr(9), chr(32), ' + chr(39) + '@everyone @here' + chr(39) + ')')} AS message FROM conversations"),
    "split_for_chat": (_chat_parts, CHAT_PARTS),
    "limit_sentences": (lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.clean_generation(_generated()).alias("reply")), GENERATED),
    "extract_urls": (_urls, URLS),
    "path_to_url": (_each("documents", "doc_id", url=lambda: T.path_to_url(_path(), "https://wiki.example")), f"SELECT doc_id, 'https://wiki.example/' || regexp_replace(regexp_replace(regexp_replace(trim({PATH}, '/'), '^(src/content/docs/|content/docs/|docs/)', ''), '(?i)\\.(md|mdx)$', ''), '/index$', '') || '/' AS url FROM documents"),
    "session_ids": (_each("customer", "c_custkey", session=lambda: T.session_id(F.concat(F.lit(" @"), F.col("c_name"), F.lit("?! "), F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("x-_"), 40)).otherwise("")))), "SELECT c_custkey, regexp_replace(concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN repeat('x-_', 40) ELSE '' END), '[^a-zA-Z0-9_-]', '', 'g')[1:80] AS session FROM customer"),
    "table_rows": (_rows, ROWS),
    "query_flags": (_flags, FLAGS),
    "sentence_flags": (_sentence_flags, SENTENCE_FLAGS),
    "source_dates": (_dates, DATES),
    "selector_choice": (_each("events", "event_id", choice=lambda: _long(F.coalesce(T.selector_choice(F.col("props"), 60), F.lit(-1)))), "SELECT event_id, CASE WHEN c <= 60 THEN c ELSE -1 END AS choice FROM (SELECT event_id, TRY_CAST(regexp_extract(props, '\\b([0-9]+)\\b', 1) AS BIGINT) AS c FROM events)"),
    "clean_markup": (_markup, MARKUP),
    "term_frequencies": (_terms_rows, f"WITH {BM25} SELECT id AS doc_id, term, tf FROM post"),
    "doc_lengths": (lambda spark, d: I.doc_lengths(doc_tokens(spark, d)).select(F.col("id").alias("doc_id"), "dl"), f"WITH {BM25} SELECT id AS doc_id, dl::BIGINT AS dl FROM len"),
    "doc_frequencies": (lambda spark, d: I.idf_table(doc_tokens(spark, d)).select("term", "df", F.round("idf", 6).alias("idf")), f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats"),
    "corpus_stats": (lambda spark, d: I.corpus_stats(doc_tokens(spark, d)).select("n", "total_len", F.round("avgdl", 6).alias("avgdl")), f"WITH {BM25} SELECT n, (SELECT sum(dl) FROM len)::BIGINT AS total_len, round(avgdl, 6) AS avgdl FROM stats"),
    "bm25_topk": (_bm25, f"WITH {BM25} SELECT item_id, rank, id AS doc_id, round(lex, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(lex, 9) DESC, id) AS rank FROM lex) WHERE rank <= 5"),
}
