import json
import random
import threading
from collections import deque
from dataclasses import replace

from pyspark.sql import functions as F

from quillon import cli, config
from quillon.config import Chat, Rule, Rules, Settings
from quillon.functions import text as T
from quillon.operators import chat as C
from quillon.operators import serving
from quillon.plans import flows
from quillon.sources import files
from quillon.streaming import chat as S
from quillon.streaming.serve import serve


def test_rules(spark):
    rules = [Rule("c", "contains", ["Foo"], "one"), Rule("e", "exact_normalized", ["hello there"], "two"), Rule("r", "regex", [r"^x\d+"], None), Rule("s", "contains", ["Bar"], "four", case_sensitive=True)]
    d = spark.createDataFrame([("a foo b",), ("Hello, THERE!",), ("X12 y",), ("bar",), ("Bar",)], "t string")
    got = [r.x and tuple(r.x) for r in d.select(C.match_rules(d.t, rules).alias("x")).collect()]
    assert got == [("c", "one"), ("e", "two"), ("r", None), None, ("s", "four")]
    try:
        C.match_rules(d.t, [Rule("z", "odd", ["p"])])
        raise AssertionError
    except ValueError as e:
        assert "unknown kind" in str(e)


def test_commands(spark):
    chat = Chat(admin_names=["Zed"], admin_ranks=["OWNER"], admin_only_commands=True, bot_name="Quill")
    s = Settings(chat=chat, rules=Rules(command_prefix="!q"))
    rows = [(1, "Zed", None, "status"), (2, "Bob", "OWNER", "stop"), (3, "Zed", None, "stop"), (4, "Bob", None, "PING now"), (5, "Bob", None, "what is x"), (6, "Bob", None, "  "), (7, "Zed", "vip", "ctx off"), (8, "Zed", None, "whoami"), (9, "Zed", None, "history dance"), (10, "Zed", None, "admins")]
    d = spark.createDataFrame(rows, "line_id long, speaker string, rank string, question string")
    r = {x.line_id: x for x in C.dispatch(d, s, 12).collect()}
    assert r[1].reply.startswith("Quill online. speaker=Zed rank=- admin=yes wiki_chunks=12")
    assert r[2].reply == "Stopping Quill." and r[3].reply == "No permission." and r[4].reply == "No permission." and r[4].command == "ping"
    assert r[5].reply is None and r[5].command is None
    assert r[6].reply.startswith("Use: !q <question>")
    assert r[7].reply == "Conversation history disabled and context cleared." and r[8].reply == "Parsed speaker=Zed, rank=-. admin=yes."
    assert r[9].reply == "Usage: !q history <on|off|toggle|status>" and r[10].reply == "Admin names: Zed. Admin ranks: OWNER."


def slow_limits(rows, cap):
    out, held = {}, {}
    for k, t, i in sorted(rows):
        q = held.setdefault(k, deque())
        while q and t - q[0] > 60:
            q.popleft()
        out[i] = len(q) < cap
        if out[i]:
            q.append(t)
    return out


def events(seed=1, n=300):
    rng = random.Random(seed)
    return [(f"u{rng.randint(0, 3)}", round(rng.uniform(0, 600), 1), i) for i in range(n)]


def test_minute_limiter_and_its_stream(spark, tmp_path):
    rows = events()
    d = spark.createDataFrame(rows, "who string, ts double, id long")
    want = slow_limits(rows, 5)
    assert {r.id: r.allowed for r in C.minute_limiter(d, "who", "ts", "id", 5).collect()} == want
    # two arrivals in order of time: state carries over
    mid = sorted(r[1] for r in rows)[len(rows) // 2]
    d.filter(d.ts < mid).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {}
    keep = lambda b, _: got.update({r.id: r.allowed for r in b.collect()})
    for part in (None, d.filter(d.ts >= mid)):
        if part is not None:
            part.coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
        S.run_available(S.minute_limiter(stream, "who", "ts", "id", 5), keep, str(tmp_path / "state")).awaitTermination()
    assert got == want


def test_cooldown(spark):
    rows = [("c", u, t, i) for u, t, i in events(2)]
    chat = Chat(cooldown_seconds=1.0, user_cooldown_seconds=4.0, max_replies_per_minute=7)
    d = spark.createDataFrame(rows, "channel string, who string, ts double, id long")
    last, users, minute, want = -1e9, {}, deque(), {}
    for _, u, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        want[i] = False
        if t - last < 1.0 or t - users.get(u, -1e9) < 4.0:
            continue
        while minute and t - minute[0] > 60:
            minute.popleft()
        if len(minute) < 7:
            minute.append(t)
            last = users[u] = t
            want[i] = True
    assert {r.id: r.allowed for r in C.cooldown(d, "channel", "who", "ts", "id", chat).collect()} == want


def test_echoes(spark):
    long = "this is a message of more than thirty two letters"
    rows = [("c", 0.0, 1, True, "hello bot"), ("c", 0.5, 2, False, "hello bot"), ("c", 0.6, 3, False, "they said hello bot today"), ("c", 2.0, 4, False, "hello bot"), ("c", 3.0, 5, True, long), ("c", 3.1, 6, False, long.replace("more", "m0re")), ("c", 3.2, 7, False, "other"), ("d", 3.2, 8, False, long)]
    d = spark.createDataFrame(rows, "channel string, ts double, id long, sent boolean, norm string")
    got = {r.id: r.echo for r in C.echoes(d, "channel", "ts", "id", 0.8).collect()}
    assert [i for i, e in got.items() if e] == [2, 3, 6] or {i for i, e in got.items() if e} == {2, 3, 6}
    joined = {r.id for r in C.echo_join(d.filter("not sent"), d.filter("sent"), 0.8).collect()}
    assert {2, 3} <= joined and 4 not in joined and 7 not in joined


def test_sessions_and_memory(spark, tmp_path):
    acc = spark.createDataFrame([("s", x, i) for i, x in enumerate("abcabdacb")], "store string, session string, n long")
    assert [r.known for r in sorted(C.session_lru(acc, "store", "session", "n", 2).collect(), key=lambda r: r.n)] == [False] * 9
    assert [r.known for r in sorted(C.session_lru(acc, "store", "session", "n", 3).collect(), key=lambda r: r.n)] == [False, False, False, True, True, False, True, False, False]
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(5)] + [(2, 0, "user", "x")], "conv long, turn long, role string, text string")
    assert sorted((r.conv, r.turn) for r in C.recent_turns(turns, "conv", "turn", 2).collect()) == [(1, 3), (1, 4), (2, 0)]
    script = [("user", "a"), ("assistant", "b"), ("user", "c"), ("clear", ""), ("user", "d"), ("history_off", ""), ("user", "e"), ("history_on", ""), ("user", "f")]
    spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(script)], turns.schema).write.parquet(str(tmp_path / "in"))
    got = {}
    q = S.memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), "conv", "turn", 2)
    S.run_available(q, lambda b, _: got.update({r.turn: json.loads(r.recent) for r in b.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert got[2] == [["assistant", "b"], ["user", "c"]] and got[3] == [] and got[4] == [["user", "d"]] and got[6] == [] and got[8] == [["user", "f"]]


def test_serving(spark):
    req = spark.createDataFrame([(1, "hi", " a@b#c? "), (2, "", "x"), (3, "y" * 801, "x"), (4, "ok", None), (5, "ok", "z" * 81)], "id long, message string, session_id string")
    got = {r.id: r.session_id for r in serving.valid_requests(req).collect()}
    assert set(got) == {1, 4} and got[1] == "abc" and len(got[4]) == 16
    res = spark.createDataFrame([(1, p, f"docs/{x}.md", "T", h) for p, (x, h) in enumerate([("a", ["H", "I"]), ("a", []), ("b", []), ("c", []), ("d", [])], 1)], "query_id long, pos int, source_path string, title string, heading_path array<string>")
    links = serving.source_links(res, "https://w")
    assert [(r.title, r.url) for r in sorted(links.collect(), key=lambda r: r.place)] == [("H > I", "https://w/a/"), ("T", "https://w/b/"), ("T", "https://w/c/")]
    rep = spark.createDataFrame([(1, "see https://w/b/ ok")], "query_id long, reply string")
    assert serving.responses(rep, links).first().links == ["https://w/b/", "https://w/a/", "https://w/c/"]
    q = spark.createDataFrame([(1, "what is x")], "query_id long, query string")
    ctx = spark.createDataFrame([(1, "CTX")], "query_id long, context string")
    hist = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(9)], "query_id long, turn long, role string, content string")
    p = serving.prompts(q, ctx, hist, Settings()).first().prompt
    assert "m8" in p and "m2" not in p and "Wiki context:\nCTX\n\nQuestion: what is x\n" in p and p.endswith("<|assistant|>\n")
    assert serving.health(spark).first().status == "ok"


def test_log(spark, tmp_path):
    r = spark.createDataFrame([("VIP", "a", 'q, "x"', "hi", None), (None, "b", "q", None, None), (None, "c", "q", None, "cooldown"), ("", "d", "q", "w " * 400, None)], "rank string, speaker string, query string, reply string, dropped_reason string")
    path = str(tmp_path / "log")
    files.append_log(r, path, 100)
    files.append_log(r.limit(1), path, 100)
    got = sorted(files.read_log(spark, path).collect(), key=lambda x: x.user)
    assert len(got) == 5 and got[0].queries == 'q, "x"' and got[2].reply == T.UNKNOWN_REPLY and got[3].reply == "[dropped:cooldown]" and len(got[4].reply) <= 200


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chat": {"bot_name": "b", "odd": 1}, "rules": {"command_prefix": "!b", "special_cases": [{"name": "n", "kind": "regex", "patterns": ["x"], "more": 2}]}}))
    s = config.load(tmp_path / "c.json")
    assert s.chat.bot_name == "b" and s.chat.max_chat_chars == 248 and s.rules.special_cases[0].name == "n" and s.retrieval.top_k == 5
    assert config.first_existing([tmp_path / "no", tmp_path / "c.json"]).name == "c.json"


def test_end_to_end(spark, tmp_path):
    wiki = tmp_path / "wiki"
    wiki.mkdir()
    (wiki / "towny.md").write_text("# Towny\n\nTo claim land in the town, stand in the chunk and type /t claim there.\n\n## Upkeep\n\nTown upkeep costs $100 a day for each chunk that the town has claimed so far.\n")
    (wiki / "stars.md").write_text("# Stars\n\n| Rank | Perk |\n|---|---|\n| 1 | silk touch spawners and kits |\n| 5 | access to the nether and the end |\n")
    s = Settings(chat=Chat(public_wiki_base_url="https://w", hi_patterns=["hi"], blacklisted_users=["bad"], triggers=[], max_chat_chars=248), rules=Rules(command_prefix="!q", special_cases=[Rule("r", "contains", ["secret"], "No secrets.")]))
    s = replace(s, retrieval=replace(s.retrieval, min_score=0.05))
    assert flows.build_index(spark, str(wiki), str(tmp_path / "index"), s) == 3
    chunks, emb = files.read_index(spark, str(tmp_path / "index"))
    meta = spark.read.json(str(tmp_path / "index" / "meta")).first()
    assert meta.chunk_count == 3 and meta.embedding_dim == 256
    q = spark.createDataFrame([(1, "how do i claim land"), (2, "what perk do i get from rank 5"), (3, "zebra quantum")], "query_id long, query string")
    got = {r.query_id: r for r in flows.answer(chunks, emb, q, s).collect()}
    assert "/t claim" in got[1].reply and "https://w/towny/" in got[1].links
    assert "nether" in got[2].reply and got[3].reply == T.UNKNOWN_REPLY
    lines = [(1, "Bob: !q how do i claim land"), (2, "bad: !q help"), (3, "Bob: no prefix"), (4, "Ann: !q secret"), (5, "Ann: !q help"), (6, "Ann: !q hi"), (7, "Ann: !q what perk do i get from rank 5")]
    d = spark.createDataFrame([(i, "c", float(i), r) for i, r in lines], "line_id long, channel string, ts double, raw string")
    out = {}
    for r in flows.handle_chat(d, chunks, emb, s).orderBy("line_id", "part").collect():
        out.setdefault(r.line_id, []).append(r.message)
    assert set(out) == {1, 4, 5, 6, 7} and out[4] == ["No secrets."] and "/t claim" in out[1][0] and out[6][0].startswith("Meow") and "nether" in out[7][0]
    # what the bot itself said a moment ago is no question; answers and drops are logged, the history switch is followed
    own = spark.createDataFrame([("c", 0.9, "!q how do i claim land"), ("c", 4.0, "!q help me"), ("d", 6.9, "!q what perk do i get from rank 5")], "channel string, ts double, text string")
    more = d.unionByName(spark.createDataFrame([(8, "c", 8.0, "Ann: !q history off"), (9, "c", 9.0, "Ann: !q history"), (10, "c", 9.1, "Ann: !q what perk do i get from rank 5"), (11, "c", 9.2, "Ann: !q what perk do i get from rank 5")], d.schema))
    open_ = replace(s, chat=replace(s.chat, admin_command_names=[]))
    heard = {r.line_id: r.message for r in flows.handle_chat(more, chunks, emb, open_, sent=own, log_path=str(tmp_path / "log"), audit_path=str(tmp_path / "audit")).filter("part = 0").collect()}
    assert set(heard) == {4, 5, 6, 7, 8, 9, 10} and heard[8].endswith("context cleared.") and heard[9] == "Conversation history is off."
    log = {(r.queries, r.reply[:9]) for r in files.read_log(spark, str(tmp_path / "log")).collect()}
    assert ("what perk do i get from rank 5", "[dropped:") in log and len(log) == 3
    audit = sorted((r.decision, r.command, r.speaker, r["rank"], r.reason) for r in spark.read.json(str(tmp_path / "audit")).collect())
    assert audit == [("ALLOW", "help", "Ann", "-", "open_command"), ("ALLOW", "history", "Ann", "-", "open_command"), ("ALLOW", "history", "Ann", "-", "open_command")]
    told = cli.explain(spark, "how do i claim land", str(tmp_path / "index"), s)
    assert "/t claim" in told.answer.first().answer and told.candidates.count() and "Towny" in told.context.first().heading
    # the same lines as a stream
    d.coalesce(1).write.parquet(str(tmp_path / "lines"))
    stop = threading.Event()
    for q in serve(spark.readStream.schema(d.schema).parquet(str(tmp_path / "lines")), str(tmp_path / "index"), str(tmp_path / "sent"), str(tmp_path / "state"), s, stop=stop):
        q.awaitTermination()
    sent = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "sent"))
    assert {r.line_id: r.message for r in sent.filter("part = 0").collect()} == {i: m[0] for i, m in out.items()} and not stop.is_set()
    spark.createDataFrame([(0, [0.0])], "chunk_idx long, embedding array<float>").write.mode("overwrite").parquet(str(tmp_path / "index" / "embeddings"))
    for path, kind in ((tmp_path / "index", ValueError), (tmp_path / "nothing", FileNotFoundError)):
        try:
            files.read_index(spark, str(path))
            raise AssertionError
        except kind:
            pass


def test_hot_keys_are_dealt_over_ranges(spark):
    """One store and one channel over many tasks give what one pass over all rows gives."""
    from collections import OrderedDict

    rng = random.Random(12)
    rows = [(i, "s" if i % 10 else "t", str(int(rng.paretovariate(0.6)) % 60)) for i in range(3000)]
    held, want = {}, {}
    for i, store, session in rows:
        h = held.setdefault(store, OrderedDict())
        want[i] = session in h
        h[session] = True
        h.move_to_end(session)
        if len(h) > 20:
            h.popitem(last=False)
    d = spark.createDataFrame(rows, "i long, store string, session string").repartition(5)
    assert {r.i: r.known for r in C.session_lru(d, "store", "session", "i", 20).collect()} == want
    texts = [f"message {rng.randint(0, 30)} of the channel" for _ in range(2000)]
    rows = [(i, "c", i * 0.3, t, rng.random() < 0.3) for i, t in enumerate(texts)]
    sent, want = deque(maxlen=24), {}
    for i, _, ts, t, own in rows:
        if own:
            sent.append((t, ts))
        want[i] = not own and any(ts - at <= 3.0 and C.same_message(x, t) for x, at in sent)
    d = spark.createDataFrame(rows, "i long, channel string, ts double, norm string, sent boolean").repartition(5)
    assert {r.i: r.echo for r in C.echoes(d, "channel", "ts", "i", 3.0).collect()} == want
