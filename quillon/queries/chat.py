"""Queries of the chat operators: lines built from ``conversations``, event streams from ``events``, speakers from ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Chat, Rule, Rules, Settings
from quillon.functions import predicates as P
from quillon.functions import text as T
from quillon.operators import chat as C
from quillon.operators import serving as S
from quillon.queries import sql as Q
from quillon.queries.text import table
from quillon.sources import files

_FORMS = 6


def lines(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.when(F.col("turn") % 3 == 0, "!ask ").when(F.col("turn") % 3 == 1, "").otherwise("!askme "), F.translate("text", "\n:", "  "))
    who = F.concat(F.lit("user_"), F.col("conv_id").cast("string"))
    form = (F.col("conv_id") + F.col("turn")) % _FORMS
    raw = (
        F.when(form == 0, F.concat(F.lit("<"), who, F.lit("> "), said)).when(form == 1, F.concat(F.lit("[world] "), who, F.lit(" » "), said)).when(form == 2, F.concat(who, F.lit(": "), said))
        .when(form == 3, F.concat(F.lit("§a🏕 ➟ TOPAZ "), who, F.lit(" [❄ '24] [x] ➡ "), said)).when(form == 4, F.concat(F.lit("★ "), who, F.lit(" ★›"), said)).otherwise(said)
    )
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


_SAID = "concat(CASE turn % 3 WHEN 0 THEN '!ask ' WHEN 1 THEN '' ELSE '!askme ' END, translate(text, chr(10) || ':', '  '))"
_WHO = "('user_' || conv_id)"
_FORM = f"((conv_id + turn) % {_FORMS})"
# each form has one speaker and one text, which the parser must find again
LINES = f"""p AS (SELECT conv_id, turn, CASE WHEN {_FORM} < 5 THEN {_WHO} END AS speaker, CASE WHEN {_FORM} = 3 THEN 'TOPAZ' END AS rank, trim({_SAID}) AS content FROM conversations)"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("p", C.parse_line(F.col("raw"))).select("conv_id", "turn", "p.speaker", "p.rank", "p.content")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).withColumn("question", C.strip_prefix(F.col("content"), ["!ask"])).filter("question is not null").select("conv_id", "turn", "question")


ASKED = f"WITH {LINES} SELECT conv_id, turn, trim(content[5:]) AS question FROM p WHERE content = '!ask' OR starts_with(content, '!ask ')"

_RULES = [Rule("greet", "exact_normalized", ["Signup!", "error 7"], "Hello."), Rule("views", "contains", ["VIEW"], "Seen."), Rule("click", "regex", [r"^click \d*5$"], None), Rule("raw", "contains", ["purchase 1"], "Bought.", case_sensitive=True)]


def _line_of_event():
    return F.concat(F.when(F.col("user_id") % 2 == 0, F.initcap("event_type")).otherwise(F.col("event_type")), F.when(F.col("event_type") == "signup", "!").otherwise(F.concat(F.lit(" "), (F.col("user_id") % 20).cast("string"))))


_EVENT_LINE = "concat(CASE WHEN user_id % 2 = 0 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END, CASE WHEN event_type = 'signup' THEN '!' ELSE ' ' || user_id % 20 END)"


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.match_rules(_line_of_event(), _RULES).alias("r")).filter("r is not null").select("event_id", "r.rule_name", "r.reply")


RULED = f"""
SELECT event_id, n AS rule_name, CASE n WHEN 'greet' THEN 'Hello.' WHEN 'views' THEN 'Seen.' WHEN 'raw' THEN 'Bought.' END AS reply FROM (
  SELECT event_id, CASE WHEN {Q.compact('l')} IN ('signup', 'error 7') THEN 'greet' WHEN contains(lower(l), 'view') THEN 'views' WHEN regexp_matches(l, '(?i)^click [0-9]*5$') THEN 'click' WHEN contains(l, 'purchase 1') THEN 'raw' END AS n
  FROM (SELECT event_id, {_EVENT_LINE} AS l FROM events)) WHERE n IS NOT NULL
"""

_CHAT = Chat(blacklisted_users=["Customer#000000007", "user_3"], blocked_substrings=["Error 1", "voted yet!"], bot_name="Quill", admin_names=["Customer#000000001", "customer#000000012"], admin_ranks=["BUILDING", "Machinery"], admin_only_commands=False)
_ORDER = Settings(chat=_CHAT, rules=Rules(command_prefix="!ask"))
_COMMANDS = ("status", "STOP now", "reload", "ctx on", "whoami", "what is it", "help", "quit", "admins", "history dance", "clear")


def _moderated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("User_"), (F.col("user_id") % 10).cast("string")).alias("speaker"), _line_of_event().alias("content"))
    return C.moderate(e, _CHAT)


MODERATED = f"SELECT event_id, 'User_' || user_id % 10 AS speaker, {_EVENT_LINE} AS content FROM events WHERE user_id % 10 <> 3 AND NOT contains(lower({_EVENT_LINE}), 'error 1')"


def _command_lines(spark: SparkSession, d: str) -> DataFrame:
    at = F.array(*map(F.lit, _COMMANDS))
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("speaker"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("rank"), at[(F.col("c_custkey") % len(_COMMANDS)).cast("int")].alias("question"))


def _dispatched(spark: SparkSession, d: str) -> DataFrame:
    return C.dispatch(_command_lines(spark, d), _ORDER, 7).filter("command is not null").select("c_custkey", "command", F.col("allowed").cast("long").alias("allowed"), "reason", "reply")


_HELP = "Use: !ask <question>. Commands: !ask help, !ask status, !ask whoami, !ask admins, !ask history <on|off|toggle|status>, !ask clear_context, !ask reload_retriever, !ask stop"
DISPATCHED = f"""
SELECT c_custkey, cmd AS command, allowed::BIGINT AS allowed, CASE WHEN needed THEN 'admin_required' ELSE 'open_command' END AS reason,
  CASE WHEN NOT allowed THEN 'No permission.' WHEN cmd IN ('stop', 'quit') THEN 'Stopping Quill.'
    WHEN cmd = 'status' THEN 'Quill online. speaker=' || c_name || ' rank=' || rank || ' admin=' || yes || ' wiki_chunks=7 llm_chat=off llm_selector=off history=on'
    WHEN cmd = 'whoami' THEN 'Parsed speaker=' || c_name || ', rank=' || rank || '. admin=' || yes || '.' WHEN cmd = 'admins' THEN 'Admin names: Customer#000000001, customer#000000012. Admin ranks: BUILDING, Machinery.'
    WHEN cmd = 'clear_context' THEN 'Conversation context cleared.' WHEN cmd = 'history' AND q = 'ctx on' THEN 'Conversation history enabled.' WHEN cmd = 'history' THEN 'Usage: !ask history <on|off|toggle|status>'
    WHEN cmd = 'reload_retriever' THEN 'Retriever reloaded. wiki_chunks=7.' ELSE '{_HELP}' END AS reply
FROM (SELECT *, cmd <> 'help' AS needed, cmd = 'help' OR ok AS allowed, CASE WHEN ok THEN 'yes' ELSE 'no' END AS yes FROM (
  SELECT *, CASE WHEN cmd IN ('stop', 'quit') THEN ranked ELSE ranked OR c_custkey IN (1, 12) END AS ok FROM (
    SELECT c_custkey, c_name, q, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '-') AS rank, coalesce(CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) IN ('building', 'machinery') END, FALSE) AS ranked,
      CASE q WHEN 'status' THEN 'status' WHEN 'STOP now' THEN 'stop' WHEN 'reload' THEN 'reload_retriever' WHEN 'ctx on' THEN 'history' WHEN 'whoami' THEN 'whoami' WHEN 'help' THEN 'help' WHEN 'quit' THEN 'quit' WHEN 'admins' THEN 'admins' WHEN 'history dance' THEN 'history' WHEN 'clear' THEN 'clear_context' END AS cmd
    FROM (SELECT *, [{', '.join(repr(c) for c in _COMMANDS)}][c_custkey % {len(_COMMANDS)} + 1] AS q FROM customer))) WHERE cmd IS NOT NULL)
"""


AUDIT = f"SELECT c_custkey, CASE WHEN allowed = 1 THEN 'ALLOW' ELSE 'DENY' END AS decision, command, c_name AS speaker, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '-') AS rank, reason FROM ({DISPATCHED}) JOIN customer USING (c_custkey)"


def _audited(spark: SparkSession, d: str) -> DataFrame:
    # a speaker's name holds the key of its row
    a = C.audit_rows(C.dispatch(_command_lines(spark, d), _ORDER, 7))
    return a.withColumn("c_custkey", F.regexp_extract("speaker", r"(\d+)$", 1).cast("long"))


def _seconds():
    """Two events a second, not in the order of their ids: as dense at every scale."""
    return F.col("event_id") * F.lit(0.5) + (F.col("user_id") % 7) * F.lit(0.25)


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 20).cast("string").alias("who"), F.col("event_type").alias("channel"), _seconds().alias("ts"))


def _limited(spark: SparkSession, d: str) -> DataFrame:
    return C.minute_limiter(_timed(spark, d), "who", "ts", "event_id", 3).select("event_id", F.col("allowed").cast("long").alias("allowed"))


# one row of each user a step: the accepted times of the last minute go along
LIMITED = """
WITH RECURSIVE e AS (SELECT event_id, user_id % 20 AS user_id, event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE, event_id) AS n FROM events),
s AS (
  SELECT user_id, n, event_id, TRUE AS ok, [t] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(s.held, lambda x: e.t - x <= 60) AS h FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, ok::BIGINT AS allowed FROM s
"""


def _cooled(spark: SparkSession, d: str) -> DataFrame:
    chat = Chat(cooldown_seconds=2.0, user_cooldown_seconds=30.0, max_replies_per_minute=8)
    return C.cooldown(_timed(spark, d), "channel", "who", "ts", "event_id", chat).select("event_id", F.col("allowed").cast("long").alias("allowed"))


# one row of each channel a step: the accepted times and speakers of the last minute go along
COOLED = """
WITH RECURSIVE e AS (SELECT event_id, event_type AS c, user_id % 20 AS w, event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE, event_id) AS n FROM events),
s AS (
  SELECT c, n, event_id, TRUE AS ok, [{'t': t, 'w': w}] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT c, n, event_id, ok, CASE WHEN ok THEN list_append(h, {'t': t, 'w': w}) ELSE h END
  FROM (SELECT *, len(h) < 8 AND len(list_filter(h, lambda x: t - x.t < 2 OR (x.w = w AND t - x.t < 30))) = 0 AS ok
        FROM (SELECT e.c, e.n, e.event_id, e.t, e.w, list_filter(s.held, lambda x: e.t - x.t <= 60) AS h FROM s JOIN e ON e.c = s.c AND e.n = s.n + 1)))
SELECT event_id, ok::BIGINT AS allowed FROM s
"""


def _echo_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", _seconds().alias("ts"), T.normalize(F.concat("event_type", F.lit(" "), (F.col("user_id") % 5).cast("string"))).alias("norm"), (F.col("event_id") % 4 == 0).alias("sent"), F.lit("c").alias("channel"))
    return e.filter("not sent"), e.filter("sent")


def _echo_join(spark: SparkSession, d: str) -> DataFrame:
    incoming, sent = _echo_sides(spark, d)
    return C.echo_join(incoming, sent, 4.0).select("event_id", "norm")


_N = "event_type || ' ' || user_id % 5"
ECHO = f"""
WITH e AS (SELECT event_id, event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE AS t, {_N} AS norm FROM events)
SELECT i.event_id, i.norm FROM e i WHERE i.event_id % 4 <> 0 AND EXISTS (SELECT 1 FROM e s WHERE s.event_id % 4 = 0 AND i.t >= s.t AND i.t - s.t <= 4 AND (s.norm = i.norm OR contains(i.norm, s.norm) OR contains(s.norm, i.norm)))
"""


def _echoes(spark: SparkSession, d: str) -> DataFrame:
    incoming, sent = _echo_sides(spark, d)
    return C.echoes(incoming.unionByName(sent), "channel", "ts", "event_id", 4.0).select("event_id", F.col("echo").cast("long").alias("echo"))


# the same, among the last 24 sent; texts this short are never alike without containing each other
ECHOES = f"""
WITH e AS (SELECT event_id, event_id * 0.5::DOUBLE + (user_id % 7) * 0.25::DOUBLE AS t, {_N} AS norm, event_id % 4 = 0 AS sent FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY t, event_id) AS r, count(*) FILTER (sent) OVER (ORDER BY t, event_id) AS k FROM e)
SELECT i.event_id, (NOT i.sent AND EXISTS (SELECT 1 FROM o s WHERE s.sent AND s.r < i.r AND s.k > i.k - 24 AND i.t - s.t <= 4 AND (contains(i.norm, s.norm) OR contains(s.norm, i.norm))))::BIGINT AS echo FROM o i
"""


def _lru(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("event_id", F.lit("s").alias("store"), F.col("user_id").cast("string").alias("session"))
    return C.session_lru(a, "store", "session", "event_id", 20).select("event_id", F.col("known").cast("long").alias("known"))


# held if fewer than 20 other sessions came since its last access
LRU = """
WITH a AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
SELECT a.event_id, (a.last IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM events b WHERE b.event_id > a.last AND b.event_id < a.event_id) < 20)::BIGINT AS known FROM a
"""


_ROLE = "CASE WHEN (conv_id + turn) % 11 = 0 THEN 'history_off' WHEN (conv_id + turn) % 7 = 0 THEN 'history_on' WHEN (conv_id + turn) % 5 = 3 THEN 'clear' ELSE role END"


def _memory(spark: SparkSession, d: str) -> DataFrame:
    m = C.memory(table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ROLE).alias("role"), "text"), "conv_id", "turn", 6)
    said = F.transform(F.from_json("recent", "array<array<string>>"), lambda x: F.concat(x[0], F.lit(": "), x[1]))
    return m.select("conv_id", "turn", F.size(said).cast("long").alias("n"), F.md5(F.array_join(said, "\n")).alias("md5"))


# what was said since the memory was last emptied, while it was on
MEMORY = f"""
WITH t AS (SELECT conv_id, turn, {_ROLE} AS role, text FROM conversations),
g AS (SELECT *, count(*) FILTER (role IN ('clear', 'history_off')) OVER w AS part, coalesce(last_value(CASE role WHEN 'history_on' THEN TRUE WHEN 'history_off' THEN FALSE END IGNORE NULLS) OVER w, TRUE) AS kept
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
l AS (SELECT conv_id, turn, coalesce(list(role || ': ' || text) FILTER (kept AND role NOT IN ('clear', 'history_on', 'history_off')) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING), [])[-6:] AS said FROM g)
SELECT conv_id, turn, len(said) AS n, md5(array_to_string(said, chr(10))) AS md5 FROM l
"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", T.new_session_id().alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("size"), F.col("s").rlike("^[0-9a-f]+$").cast("long").alias("hex"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id") + F.col("turn")
    r = table(spark, d, "conversations").select(F.when(i % 2 == 0, "VIP").alias("rank"), F.col("role").alias("speaker"), F.concat(F.lit("q"), i.cast("string")).alias("query"), F.when(i % 5 > 0, F.col("text")).alias("reply"), F.when(i % 7 == 0, "cooldown").alias("dropped_reason"))
    return C.log_rows(r, 60)


_LOGGED = Q.sanitize("coalesce(CASE WHEN (conv_id + turn) % 5 > 0 THEN text END, '')")
LOG = f"""
SELECT CASE WHEN i % 2 = 0 THEN 'VIP' ELSE '' END AS rank, role AS user, 'q' || i AS queries, CASE WHEN i % 7 = 0 THEN '[dropped:cooldown]' WHEN t = '' THEN '{T.UNKNOWN_REPLY.replace("'", "''")}' ELSE {Q.truncate('t', 120)} END AS reply
FROM (SELECT conv_id + turn AS i, role, {_LOGGED} AS t FROM conversations)
"""


def _greetings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.is_greeting(_line_of_event(), ["Signup", "view 4!"]).cast("long").alias("hello"), T.contains_trigger(_line_of_event(), ["click"]).cast("long").alias("called"), T.strip_trigger(_line_of_event(), ["click", "click 1"]).alias("rest"))


GREETINGS = rf"""
SELECT event_id, ({Q.compact('l')} IN ('signup', 'view 4'))::BIGINT AS hello, regexp_matches(lower(l), '(^|[^a-z0-9_])click($|[^a-z0-9_])')::BIGINT AS called,
  CASE WHEN regexp_full_match(lower(l), 'click 1') THEN '' WHEN starts_with(lower(l), 'click ') THEN trim(l[6:]) ELSE l END AS rest
FROM (SELECT event_id, {_EVENT_LINE} AS l FROM events)
"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.col("text").alias("message"), F.concat("source", F.repeat(F.lit("-x"), (F.col("doc_id") % 60).cast("int"))).alias("session_id"))
    return S.valid_requests(r).select("doc_id", "session_id")


def _admins(spark: SparkSession, d: str) -> DataFrame:
    c = _command_lines(spark, d)
    cmd = C.command_of(F.col("question"))
    return c.select("c_custkey", P.is_admin(F.col("speaker"), F.coalesce("rank", F.lit("")), cmd, _CHAT.admin_names, _CHAT.admin_ranks, ["stop", "quit"], True).cast("long").alias("admin"))


ADMINS = f"""
SELECT c_custkey, (CASE WHEN [{', '.join(repr(c) for c in _COMMANDS)}][c_custkey % {len(_COMMANDS)} + 1] IN ('STOP now', 'quit') THEN ranked ELSE ranked OR c_custkey IN (1, 12) END)::BIGINT AS admin
FROM (SELECT c_custkey, c_custkey % 3 > 0 AND lower(c_mktsegment) IN ('building', 'machinery') AS ranked FROM customer)
"""

QUERIES: dict[str, tuple] = {
    "parse_chat": (_parsed, f"WITH {LINES} SELECT * FROM p"),
    "strip_prefix": (_asked, ASKED),
    "rules_match": (_ruled, RULED),
    "moderate": (_moderated, MODERATED),
    "greetings": (_greetings, GREETINGS),
    "is_admin": (_admins, ADMINS),
    "command_dispatch": (_dispatched, DISPATCHED),
    "command_audit": (_audited, AUDIT),
    "minute_limiter": (_limited, LIMITED),
    "cooldown_accept": (_cooled, COOLED),
    "chat_memory": (_memory, MEMORY),
    "new_sessions": (_sessions, "SELECT doc_id, 16::BIGINT AS size, 1::BIGINT AS hex FROM documents"),
    "echo_join": (_echo_join, ECHO),
    "self_echoes": (_echoes, ECHOES),
    "recent_turns": (lambda s, d: C.recent_turns(table(s, d, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role", "text"), "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6"),
    "session_lru": (_lru, LRU),
    "query_log": (_log, LOG),
    "valid_requests": (_requests, "SELECT doc_id, source || repeat('-x', doc_id % 60) AS session_id FROM documents WHERE length(text) BETWEEN 1 AND 800 AND length(source) + 2 * (doc_id % 60) <= 80"),
    "index_meta": (lambda s, d: files.index_meta(table(s, d, "embeddings"), "m", "w").select("embedding_model", "chunk_count", F.col("embedding_dim").cast("long").alias("embedding_dim"), "wiki_dir"), "SELECT 'm' AS embedding_model, count(*) AS chunk_count, max(len(embedding))::BIGINT AS embedding_dim, 'w' AS wiki_dir FROM embeddings"),
    "health": (lambda s, d: S.health(s), "SELECT 'ok' AS status"),
}
