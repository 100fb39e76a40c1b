"""Chat state in Structured Streaming: limits, echoes, memory, history switch.

Each operator keeps one small JSON state per key and gives the rows of its batch
twin in ``operators.chat``. Rows of a key are ordered by time within a
micro-batch; between micro-batches arrival decides, as in a live chat.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.config import Chat
from quillon.operators.chat import ECHO_KEPT, Cooldown, Limits, remember, same_message


def _stateful(df: DataFrame, key: str, order: list[str], load: Callable[[Any], Any], save: Callable[[Any], Any], step: Callable[[Any, Any], Any], name: str, kind: str) -> DataFrame:
    def run(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = load(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [step(held, r) for r in rows.itertuples(index=False)]
        state.update((json.dumps(save(held)),))
        yield rows.assign(**{name: pd.Series(out, index=rows.index)})

    schema = StructType.fromJson(df.schema.jsonValue()).add(name, kind)
    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def minute_limiter(events: DataFrame, key: str, ts: str, tie: str, cap: int) -> DataFrame:
    return _stateful(events, key, [ts, tie], lambda s: Limits(cap, s or []), lambda h: list(h.times), lambda h, r: h.allow(getattr(r, ts)), "allowed", "boolean")


def cooldown(events: DataFrame, channel: str, user: str, ts: str, tie: str, chat: Chat) -> DataFrame:
    def load(s: dict | None) -> Cooldown:
        c = Cooldown(chat.cooldown_seconds, chat.user_cooldown_seconds, Limits(chat.max_replies_per_minute, s["times"] if s else ()))
        if s:
            c.last, c.users = s["last"], dict(s["users"])
        return c

    save = lambda c: {"last": c.last, "users": list(c.users.items()), "times": list(c.minute.times)}
    return _stateful(events, channel, [ts, tie], load, save, lambda c, r: c.allow(getattr(r, user), getattr(r, ts)), "allowed", "boolean")


def echoes(events: DataFrame, channel: str, ts: str, tie: str, ttl: float) -> DataFrame:
    def step(held: deque, r) -> bool:
        now = getattr(r, ts)
        while held and now - held[0][1] > ttl:
            held.popleft()
        if r.sent:
            held.append((r.norm, now))
            return False
        return any(same_message(t, r.norm) for t, _ in held)

    return _stateful(events, channel, [ts, tie], lambda s: deque(map(tuple, s or []), maxlen=ECHO_KEPT), list, step, "echo", "boolean")


def memory(turns: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """``turns`` (role, text) with recent: a JSON list of the last ``n`` turns up to and with this one."""
    return _stateful(turns, conversation, [order], lambda s: s or {"on": True, "turns": []}, lambda h: h, lambda h, r: remember(h, r.role, r.text, n), "recent", "string")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived, batch by batch, then stop."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
