"""Queries of extraction: chunks, results and questions built from ``part``, whose rows vary names, prices and sizes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Model, Settings
from quillon.functions import predicates as P
from quillon.functions import text as T
from quillon.operators import chunking as K
from quillon.operators import extraction as X
from quillon.operators import serving as S
from quillon.queries import sql as Q
from quillon.queries.text import QUESTION, _question, table
from quillon.storage import dealt


def _chunk_text():
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    p = F.col
    return F.concat(
        p("p_brand"), F.lit("\n| Name | Value |\n|---|---|\n| "), p("p_name"), F.lit(" | "), price, F.lit("$ |\n| "), p("p_name"), F.lit(" | use /warp "), p("p_type"), F.lit(" first. Then go on |\n"),
        F.lit("A "), p("p_name"), F.lit(" is made of "), p("p_type"), F.lit(" parts. You must have size "), p("p_size").cast("string"), F.lit(" at least - failure costs a lot!\nTo create one, type /make "), p("p_name"), F.lit(" there."),
    )


_PRICE = "CAST(p_retailprice AS DECIMAL(12,2))::VARCHAR"
_NL = "chr(10)"
CHUNK = f"concat(p_brand, {_NL}, '| Name | Value |', {_NL}, '|---|---|', {_NL}, '| ', p_name, ' | ', {_PRICE}, '$ |', {_NL}, '| ', p_name, ' | use /warp ', p_type, ' first. Then go on |', {_NL}, 'A ', p_name, ' is made of ', p_type, ' parts. You must have size ', p_size, ' at least - failure costs a lot!', {_NL}, 'To create one, type /make ', p_name, ' there.')"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "part"), "p_partkey")


def results(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("p_partkey") % 10).cast("double") / 20.0 + 0.1
    path = F.concat(F.lit("wiki/"), F.col("p_type"), F.lit(".md"))
    second = F.concat(F.lit("Second page of "), F.col("p_name"), F.lit(". It allows you to warp and to set a home there."))
    page = lambda pos, s, p, t: F.struct(F.lit(pos).alias("pos"), s.alias("score"), p.alias("source_path"), t.alias("text"))
    pages = F.array(page(1, score, path, _chunk_text()), page(2, score / 2, F.concat(F.lit("docs/"), path), second))
    r = _parts(spark, d).select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.explode(pages).alias("r"))
    return r.select("query_id", "r.pos", "r.score", "r.source_path", "title", "heading_path", "r.text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(F.col("p_partkey").alias("query_id"), _question().alias("query"))


# a unit per row: rows of a table first, cut at sentence ends, then the sentences of the other lines
_LINES = f"list_filter(list_transform(string_split(text, {_NL}), lambda x: trim(x)), lambda x: x <> '')"
_ROWS = f"flatten(list_transform(list_filter({_LINES}, lambda x: starts_with(x, '|') AND NOT regexp_full_match(x, '\\|?[\\s:|-]+\\|?')), lambda x: string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))"
_PROSE = Q.sentences(f"array_to_string(list_filter({_LINES}, lambda x: NOT starts_with(x, '|')), ' ')")
_UNITS = f"list_filter(list_transform(list_concat({_ROWS}, {_PROSE}), lambda x: trim(x)), lambda x: x <> '')"
RESULTS = f"""r AS (SELECT p_partkey AS q, 1 AS pos, (p_partkey % 10)::DOUBLE / 20 + 0.1 AS score, 'wiki/' || p_type || '.md' AS path, p_name AS title, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [] END AS heads, {CHUNK} AS text FROM part
  UNION ALL SELECT p_partkey, 2, ((p_partkey % 10)::DOUBLE / 20 + 0.1) / 2, 'docs/wiki/' || p_type || '.md', p_name, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [] END, 'Second page of ' || p_name || '. It allows you to warp and to set a home there.' FROM part)"""
_UNIT_ROWS = f"units AS (SELECT q, pos, score, generate_subscripts(u, 1) - 1 AS upos, unnest(u) AS unit FROM (SELECT q, pos, score, {_UNITS} AS u FROM r))"
_C = "cc"
_VALUE = r"(regexp_matches(nn, '\$\s*[0-9]') OR regexp_matches(nn, '[0-9][0-9,.\s]*\$') OR (regexp_matches(nn, '\b[0-9][0-9\s,._]*\b') AND (regexp_matches(nn, '\b(cost|price|money|upkeep|fee|tax)\b') OR regexp_matches(nn, '\b(in-game money|dollars?)\b'))))"
_TAIL = "array_to_string(cells[2:], ' ')"
_PRICELIKE = rf"(len(cells) >= 2 AND regexp_matches({_TAIL}, '[$0-9]') AND length(regexp_replace(regexp_replace({_TAIL}, '[0-9,.\s$%]+', '', 'g'), '(?i)\b(exp|xp)\b', '', 'g')) <= 3)"
CANDS = rf"""{RESULTS}, {_UNIT_ROWS},
fl AS (SELECT q, query, {Q.terms('query')} AS terms, {Q.compact('query')} AS qc FROM (SELECT p_partkey AS q, {QUESTION} AS query FROM part)),
a AS (SELECT units.*, terms, qc, {Q.reformat('unit')} AS cleaned, {Q.cells('unit')} AS cells,
        regexp_matches(qc, '{P.HOW_MUCH}') OR regexp_matches(qc, '{P.COST}') AS cost, NOT regexp_matches(qc, '{P.QUANTITY}') AND regexp_matches(qc, '{P.HOWTO}') AS howto,
        regexp_matches(qc, '{P.COMMAND}') AS command, regexp_matches(qc, '{P.NAVIGATION}') AS nav, regexp_matches(qc, '{P.DEFINITION}') AS def
      FROM units JOIN fl USING (q)),
b AS (SELECT *, {Q.compact('cleaned')} AS cc, {Q.norm('cleaned')} AS nn, contains(unit, '|') AND len(cells) >= 2 AND NOT starts_with(cells[1], '/') AS keyed, list_distinct({Q.words('coalesce(cells[1], chr(32))')}) AS kw,
        regexp_matches(lower(cleaned), '(^|\s)/[a-z0-9_]+') AS cmd FROM a WHERE length(cleaned) >= 20 AND (upos < 12 OR list_has_any(terms, {Q.words('unit')}))),
g AS (SELECT *, list_distinct(list_filter(string_split(cc, ' '), lambda w: w <> '')) AS ws, regexp_matches(cc, '{P.WARNING}') AS warn, regexp_matches(cc, '{P.REQUIREMENT}') AS req, {_VALUE} AS val FROM b),
h AS (SELECT *,
  CASE WHEN keyed AND len(kw) > 0 AND NOT (cost AND NOT val) THEN len(list_intersect(terms, kw))::DOUBLE / len(kw) ELSE 0.0::DOUBLE END AS cover,
  len(list_intersect(terms, CASE WHEN keyed THEN list_concat(list_filter(ws, lambda w: NOT regexp_full_match(w, '[0-9]+')), list_filter(kw, lambda w: regexp_full_match(w, '[0-9]+'))) ELSE ws END)) AS overlap,
  CASE WHEN NOT def OR NOT regexp_matches(cc, '{P.DEFINING}') THEN 0 WHEN list_has_any(terms, list_filter(string_split(cc, ' '), lambda w: w <> '')[1:4]) THEN 2 WHEN list_has_any(terms, ws) THEN 1 ELSE 0 END AS defines,
  0.0::DOUBLE + CASE WHEN howto AND regexp_matches(cc, '{P.STEPS}') THEN 0.35 ELSE 0 END + CASE WHEN howto AND contains(cleaned, '/') THEN 0.25 ELSE 0 END - CASE WHEN howto AND regexp_matches(cc, '{P.FAILING}') THEN 0.15 ELSE 0 END
   + CASE WHEN command THEN CASE WHEN cmd THEN 0.45 ELSE -0.10 END ELSE 0 END - CASE WHEN nav AND regexp_matches(cc, '{P.SETTING}') THEN 0.3 ELSE 0 END + CASE WHEN nav AND regexp_matches(cc, '{P.GOING}') THEN 0.2 ELSE 0 END
   - CASE WHEN warn AND NOT cost THEN 0.18 ELSE 0 END + CASE WHEN cost THEN CASE WHEN val THEN 0.3 WHEN warn THEN -0.12 ELSE 0 END WHEN contains(unit, '|') AND {_PRICELIKE} THEN -0.3 ELSE 0 END AS intent FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY q, nn ORDER BY cover DESC, defines DESC, overlap DESC, round(intent, 9) DESC, score DESC, length(cleaned), pos, upos) AS nth FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cover DESC, defines DESC, overlap DESC, round(intent, 9) DESC, score DESC, length(cleaned), pos, upos) AS rank FROM o WHERE nth = 1)"""


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _units(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("query_id", _long("pos"), F.posexplode(T.candidate_units(F.col("text"))).alias("unit_pos", "unit")).withColumn("unit_pos", _long("unit_pos"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return X.rank_candidates(X.candidates(results(spark, d), X.with_flags(questions(spark, d))))


def _unsure(spark: SparkSession, d: str) -> DataFrame:
    top = _ranked(spark, d).filter("rank = 1")
    return top.select("query_id", P.low_confidence(F.col("terms"), F.col("cleaned"), F.col("score"), F.col("key_match"), F.col("has_command"), F.col("command"), F.col("navigation"), F.col("howto")).cast("long").alias("unsure"))


_M = "len(list_intersect(terms, ws))"
_ACT = rf"(regexp_matches(nn, '(^|\s)/[a-z0-9_]+') OR regexp_matches(cc, '{P.ACTION}'))"
UNSURE_CASE = f"CASE WHEN len(terms) = 0 OR cover >= 1 THEN FALSE WHEN command AND cmd AND {_M} >= 1 THEN FALSE WHEN nav AND NOT {_ACT} THEN TRUE WHEN howto AND NOT cmd AND NOT {_ACT} AND {_M} <= 1 THEN TRUE WHEN len(terms) >= 2 AND {_M} = 0 THEN TRUE WHEN len(terms) >= 3 AND {_M}::DOUBLE / len(terms) < 0.34 AND score < 0.35 THEN TRUE ELSE FALSE END"

# the answer of questions that ask no procedure: the first command for a command question, else the first candidate
_UNKNOWN = T.UNKNOWN_REPLY.replace("'", "''")
PLAIN_ANSWERS = f"""WITH {CANDS},
pick AS (SELECT q, coalesce(min(CASE WHEN command AND cmd AND overlap > 0 THEN rank END), 1) AS sel FROM ranked GROUP BY q),
best AS (SELECT q, {UNSURE_CASE} AS unsure, howto, qc FROM ranked WHERE rank = 1),
said AS (SELECT q, unsure, CASE WHEN regexp_matches(qc, '{P.PRICE}') THEN '{X.PRICE_PREFIX}' ELSE '{X.PREFIX}' END || {Q.reformat('cleaned')} AS t FROM best JOIN pick USING (q) JOIN (SELECT q, rank AS sel, cleaned FROM ranked) USING (q, sel) WHERE NOT howto)
SELECT q AS query_id, CASE WHEN unsure THEN '{_UNKNOWN}' ELSE {Q.truncate('t', 248)} END AS answer FROM said"""


# any question's answer: of a procedure the first helpful candidate or a better command, and what it lacks
ANSWERS = f"""WITH {CANDS},
best AS (SELECT q, {UNSURE_CASE} AS unsure, howto, qc FROM ranked WHERE rank = 1),
pick AS (SELECT q, coalesce(min(CASE WHEN command AND cmd AND overlap > 0 THEN rank END), 1) AS rank, coalesce(min(CASE WHEN overlap > 0 AND (cmd OR req OR NOT warn) THEN rank END), 1) AS help FROM ranked GROUP BY q),
help AS (SELECT ranked.* FROM ranked JOIN pick ON pick.q = ranked.q AND pick.help = ranked.rank),
rival AS (SELECT r.q, first(r.rank ORDER BY r.score DESC, r.rank) AS rank FROM ranked r JOIN help h ON h.q = r.q AND NOT h.cmd WHERE r.overlap > 0 AND r.cmd AND r.score >= h.score GROUP BY r.q),
main AS (SELECT ranked.* FROM ranked JOIN help h USING (q) LEFT JOIN rival USING (q) WHERE ranked.rank = coalesce(rival.rank, h.rank)),
more AS (SELECT m.q, min(c.rank) AS rank FROM main m JOIN ranked c ON c.q = m.q WHERE c.cleaned <> m.cleaned AND c.overlap > 0 AND NOT (c.warn AND NOT c.cost) AND ((m.cmd AND c.req) OR (m.req AND c.cmd)) GROUP BY m.q),
parts AS (SELECT q, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT q, {Q.sentences('t')} AS s FROM (SELECT m.q, m.cleaned || ' ' || c.cleaned AS t FROM main m JOIN more USING (q) JOIN ranked c ON c.q = m.q AND c.rank = more.rank))),
once AS (SELECT q, trim(string_agg(part, ' ' ORDER BY i)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY i) AS nth FROM (SELECT *, {Q.norm('part')} AS k FROM (SELECT q, i, {Q.reformat('x')} AS part FROM parts)) WHERE k <> '') WHERE nth = 1 GROUP BY q),
chosen AS (SELECT b.q, b.unsure, b.qc, CASE WHEN b.howto THEN coalesce(once.t, m.cleaned) ELSE c.cleaned END AS cleaned FROM best b JOIN main m USING (q) JOIN pick USING (q) JOIN ranked c ON c.q = b.q AND c.rank = pick.rank LEFT JOIN once ON once.q = b.q),
said AS (SELECT q, unsure, CASE WHEN regexp_matches(qc, '{P.PRICE}') THEN '{X.PRICE_PREFIX}' ELSE '{X.PREFIX}' END || {Q.reformat('cleaned')} AS t FROM chosen)
SELECT p_partkey AS query_id, CASE WHEN coalesce(unsure, TRUE) THEN '{_UNKNOWN}' ELSE {Q.truncate('t', 248)} END AS answer FROM part LEFT JOIN said ON q = p_partkey"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return X.extractive_answers(results(spark, d), questions(spark, d))


def _plain_answers(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).filter(~P.howto_query(F.col("query")))
    return X.extractive_answers(results(spark, d), q)


_BLOCK = "'[Wiki chunk ' || pos || '] source=' || path || ' score=' || printf('%.3f', score) || chr(10) || 'Title: ' || title || chr(10) || 'Heading: ' || CASE WHEN len(heads) > 0 THEN array_to_string(heads, ' > ') ELSE title END || chr(10) || 'Text: ' || trim(text)"
CONTEXT = f"WITH {RESULTS} SELECT q AS query_id, md5(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY pos)) AS md5 FROM r GROUP BY q"

_URL = "'https://wiki.example/' || regexp_replace(regexp_replace(path, '^docs/', ''), '\\.md$', '') || '/'"
LINKS = f"WITH {RESULTS} SELECT query_id, 1::BIGINT AS place, title, url FROM (SELECT q AS query_id, {_URL} AS url, CASE WHEN len(heads) > 0 THEN array_to_string(heads, ' > ') ELSE title END AS title, pos FROM r) WHERE pos = 1"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return S.source_links(results(spark, d), "https://wiki.example").withColumn("place", _long("place"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    replies = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.concat(F.lit("see "), F.col("url"), F.lit(", or "), F.col("url"), F.lit(".")).alias("reply"))
    return S.responses(replies, S.source_links(results(spark, d), "https://wiki.example")).select("query_id", F.array_join("links", " ").alias("links"))


RESPONSES = f"WITH {RESULTS} SELECT page_id AS query_id, array_to_string(list_filter([regexp_replace(url, '[.,;:]+$', ''), {_URL}], lambda x: x IS NOT NULL), ' ') AS links FROM pages LEFT JOIN (SELECT * FROM r WHERE pos = 1) ON q = page_id"


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", F.col("text").alias("content"))
    return S.prompts(questions(spark, d), X.build_context(results(spark, d)), turns, Settings()).select("query_id", F.md5("prompt").alias("md5"))


_S = Settings()
_RULES = S.ANSWER_RULES.replace("'", "''").replace("\n", "' || chr(10) || '")
PROMPTS = f"""WITH {RESULTS}, ctx AS (SELECT q, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS c FROM r GROUP BY q),
rec AS (SELECT conv_id AS q, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS m FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id)
SELECT p_partkey AS query_id, md5('<|system|>' || chr(10) || '{_S.prompt.system}' || chr(10) || '{_S.prompt.answer_style}' || chr(10) || '</s>' || chr(10) || '<|user|>' || chr(10) || 'Recent chat context, may be empty:' || chr(10)
  || coalesce(nullif(m, ''), '(none)') || chr(10) || chr(10) || 'Wiki context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || {QUESTION} || chr(10) || '{_RULES}"{_UNKNOWN}"' || chr(10) || chr(10) || 'Answer for Minecraft chat:' || chr(10) || '</s>' || chr(10) || '<|assistant|>' || chr(10)) AS md5
FROM part JOIN ctx ON ctx.q = p_partkey LEFT JOIN rec ON rec.q = p_partkey"""


_LONGEST = 300
# a block a step: what is left of the budget decides whether it goes in whole, cut, or not at all
BUDGET = f"""WITH RECURSIVE {RESULTS}, b AS (SELECT q, pos, {_BLOCK} AS block FROM r),
s AS (SELECT DISTINCT q, 0 AS pos, 0::BIGINT AS total, []::VARCHAR[] AS parts, FALSE AS done FROM r
  UNION ALL
  SELECT q, pos, CASE WHEN ended THEN total ELSE total + length(t) + 2 END, CASE WHEN ended THEN parts ELSE list_append(parts, t) END, ended OR total + length(t) + 2 >= {_LONGEST}
  FROM (SELECT s.q, b.pos, s.total, s.parts, s.done OR (length(block) > {_LONGEST} - s.total AND {_LONGEST} - s.total <= 120) AS ended,
          CASE WHEN length(block) <= {_LONGEST} - s.total THEN block ELSE {Q.truncate('block', f'({_LONGEST} - s.total)')} END AS t FROM s JOIN b ON b.q = s.q AND b.pos = s.pos + 1))
SELECT q AS query_id, md5(array_to_string(parts, chr(10) || chr(10))) AS md5 FROM s WHERE pos = 2"""

_TEXTS = f"texts AS (SELECT q, list(cleaned ORDER BY rank) AS c FROM ranked WHERE rank <= 6 GROUP BY q UNION ALL SELECT q, list_filter([{Q.reformat('trim(translate(text, chr(10), chr(32)))')}], lambda x: x <> '') FROM r WHERE pos = 1 AND q NOT IN (SELECT q FROM ranked))"
_SELECTOR = S.SELECTOR_RULES.replace("'", "''").replace("\n", "' || chr(10) || '")
_NUMBERED = "array_to_string(list_transform(c, lambda x, i: i || '. ' || x), chr(10))"
_CHOOSE = f"'<|system|>' || chr(10) || '{_SELECTOR}</s>' || chr(10) || '<|user|>' || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Candidates:' || chr(10) || {_NUMBERED} || chr(10) || chr(10) || 'Answer with one integer only:' || chr(10) || '</s>' || chr(10) || '<|assistant|>' || chr(10)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return X.candidate_texts(results(spark, d), questions(spark, d), 6)


def _selector_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).join(questions(spark, d).hint("merge"), "query_id")
    return t.select("query_id", F.md5(S.selector_prompt(F.col("query"), F.col("texts"))).alias("md5"))


def _debugged(spark: SparkSession, d: str) -> DataFrame:
    c = X.debug_candidates(_ranked(spark, d))
    return c.select("query_id", _long("rank"), _long("overlap"), "intent", "retrieval_score", *[_long(x) for x in ("has_command", "has_requirement", "warning_like")], "text")


def _moded(spark: SparkSession, d: str, model: Model, said) -> DataFrame:
    """Replies of a mode, to questions that ask no procedure; ``said`` stands for the model."""
    q = questions(spark, d).filter(~P.howto_query(F.col("query")))
    r = results(spark, d)
    s = replace(Settings(), model=model)
    none = spark.createDataFrame([], "query_id long, turn long, role string, content string")
    return S.answers(q, r, s, said, S.prompts(q, X.build_context(r), none, s))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return _moded(spark, d, Model(llm_select_extractive=True), lambda prompts: [f"I take {len(p) % 8}, or 1." for p in prompts])


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return _moded(spark, d, Model(enabled=True), lambda prompts: ["Type /warp. Then go on. And more."] * len(prompts))


SELECTED = f"""WITH {CANDS}, {_TEXTS}, plain AS ({PLAIN_ANSWERS.replace(CANDS, 'z AS (SELECT 1)')}),
said AS (SELECT q, qc, c, length({_CHOOSE}) % 8 AS n FROM texts JOIN fl USING (q))
SELECT query_id, CASE WHEN n = 0 THEN '{_UNKNOWN}' WHEN n <= len(c) THEN CASE WHEN regexp_matches(qc, '{P.PRICE}') THEN '{X.PRICE_PREFIX}' ELSE '{X.PREFIX}' END || {Q.sanitize('c[n]')} ELSE answer END AS reply
FROM plain JOIN said ON q = query_id"""
GENERATED = f"SELECT query_id, CASE WHEN answer = '{_UNKNOWN}' THEN answer ELSE 'Type /warp. Then go on.' END AS reply FROM ({PLAIN_ANSWERS})"


def _files(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("---\nlang: x\n---\n# "), F.initcap("source"), F.lit(" page\n\n"))
    body = F.concat(F.lit("## First\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n### Deep\n| Key | Value |\n|---|---|\n| `"), F.col("lang"), F.lit("` | "), F.col("n_chars").cast("string"), F.lit(" |\n## Last\nThe last part of the page about "), F.col("source"), F.lit(" and more."))
    return dealt(table(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars"), "doc_id").select(F.concat("lang", F.lit("/"), "source", F.lit("/page-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, body).alias("text"), "doc_id")


_LEAD = "upper(source[1]) || lower(source[2:]) || ' page'"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '<[^>]+>', ' ', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[*_]{1,3}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s]+|[\\s]+$', '', 'g'))"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    s = _files(spark, d).select("doc_id", F.posexplode(K.sections(K.clean_markup(F.col("text")))).alias("section_pos", "s"))
    return s.select("doc_id", _long("section_pos"), F.array_join("s.path", " > ").alias("path"), F.md5("s.text").alias("md5"))


SECTIONS = f"""
SELECT doc_id, 0::BIGINT AS section_pos, {_LEAD} AS path, md5({_LEAD}) AS md5 FROM documents
UNION ALL SELECT doc_id, 2, {_LEAD} || ' > First > Deep', md5('Deep' || chr(10) || '| Key | Value |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |') FROM documents
UNION ALL SELECT doc_id, 3, {_LEAD} || ' > Last', md5('Last' || chr(10) || 'The last part of the page about ' || source || ' and more.') FROM documents
"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return f.select("doc_id", K.infer_title(K.clean_markup(F.col("text")), F.lit("none")).alias("title"), K.infer_title(F.lit("no heading"), K.file_title(F.col("path"))).alias("fallback"))


TITLES = f"SELECT doc_id, {_LEAD} AS title, 'Page ' || doc_id AS fallback FROM documents"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = K.load_chunks(_files(spark, d), 500, 100)
    return c.select("chunk_idx", "chunk_id", "source_path", "title", F.array_join("heading_path", " > ").alias("heading"), F.md5("text").alias("md5"), _long("start_char"), _long("end_char"))


QUERIES: dict[str, tuple] = {
    "candidate_units": (_units, f"WITH {RESULTS}, {_UNIT_ROWS} SELECT q AS query_id, pos::BIGINT AS pos, upos::BIGINT AS unit_pos, unit FROM units"),
    "candidate_rank": (lambda s, d: _ranked(s, d).select("query_id", _long("rank"), F.round("key_cover", 6).alias("key_cover"), F.col("is_definition").cast("long").alias("defines"), _long("overlap"), F.round("intent", 6).alias("intent"), F.round("score", 6).alias("score"), F.col("cleaned").alias("text")),
        f"WITH {CANDS} SELECT q AS query_id, rank, round(cover, 6) AS key_cover, defines::BIGINT AS defines, overlap::BIGINT AS overlap, round(intent, 6) AS intent, round(score, 6) AS score, cleaned AS text FROM ranked"),
    "low_confidence": (_unsure, f"WITH {CANDS} SELECT q AS query_id, ({UNSURE_CASE})::BIGINT AS unsure FROM ranked WHERE rank = 1"),
    "plain_answers": (_plain_answers, PLAIN_ANSWERS),
    "extractive_answers": (_answers, ANSWERS),
    "build_context": (lambda s, d: X.build_context(results(s, d)).select("query_id", F.md5("context").alias("md5")), CONTEXT),
    "context_budget": (lambda s, d: X.build_context(results(s, d), _LONGEST).select("query_id", F.md5("context").alias("md5")), BUDGET),
    "candidate_texts": (lambda s, d: _texts(s, d).select("query_id", F.array_join("texts", "\n").alias("texts")), f"WITH {CANDS}, {_TEXTS} SELECT q AS query_id, array_to_string(c, chr(10)) AS texts FROM texts"),
    "selector_prompts": (_selector_prompts, f"WITH {CANDS}, {_TEXTS} SELECT q AS query_id, md5({_CHOOSE}) AS md5 FROM texts JOIN fl USING (q)"),
    "debug_candidates": (_debugged, f"WITH {CANDS} SELECT q AS query_id, rank, overlap::BIGINT AS overlap, round(intent, 3) AS intent, round(score, 3) AS retrieval_score, cmd::BIGINT AS has_command, req::BIGINT AS has_requirement, warn::BIGINT AS warning_like, cleaned AS text FROM ranked WHERE rank <= 10"),
    "selected_answers": (_selected, SELECTED),
    "generated_answers": (_generated, GENERATED),
    "source_links": (_links, LINKS),
    "chat_responses": (_responses, RESPONSES),
    "prompts": (_prompts, PROMPTS),
    "infer_title": (_titles, TITLES),
    # its SQL has no section 1, the one of the document's text: all_sections has every section
    "split_sections": (lambda s, d: _sections(s, d).filter("section_pos <> 1"), SECTIONS),
    "all_sections": (_sections, None),
    "load_chunks": (_chunks, None),
}
