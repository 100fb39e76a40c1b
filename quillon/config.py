"""Settings: nested dataclasses read from JSON; unknown keys are dropped, missing ones keep their default."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path


# The keys and defaults of the settings file


@dataclass(frozen=True)
class Chat:
    bot_name: str = "bot"
    triggers: list[str] = field(default_factory=lambda: ["!ask"])
    hi_patterns: list[str] = field(default_factory=list)
    cooldown_seconds: float = 0.5
    user_cooldown_seconds: float = 0.5
    max_replies_per_minute: int = 10
    max_chat_chars: int = 248
    ignore_after_send_seconds: float = 0.8
    max_input_chars: int = 800
    history_enabled: bool = True
    blacklisted_users: list[str] = field(default_factory=list)
    admin_names: list[str] = field(default_factory=list)
    admin_ranks: list[str] = field(default_factory=list)
    admin_only_commands: bool = False
    admin_command_names: list[str] = field(default_factory=lambda: ["status", "ping", "whoami", "admins", "clear_context", "history", "context", "reload_retriever", "stop", "quit"])
    critical_admin_commands: list[str] = field(default_factory=lambda: ["stop", "quit"])
    require_rank_for_critical_admin_commands: bool = True
    log_command_events: bool = True
    public_wiki_base_url: str = ""
    blocked_substrings: list[str] = field(default_factory=list)
    reply_prefix: str = ""


@dataclass(frozen=True)
class Model:
    enabled: bool = False
    max_context_messages: int = 6
    llm_select_extractive: bool = False
    llm_select_max_candidates: int = 6


@dataclass(frozen=True)
class Retrieval:
    enabled: bool = True
    top_k: int = 5
    min_score: float = 0.18
    max_context_chars: int = 1800
    chunk_chars: int = 500
    chunk_overlap: int = 100
    wiki_globs: list[str] = field(default_factory=lambda: ["**/*.md", "**/*.mdx"])


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    patterns: list[str]
    reply: str | None = None
    stop: bool = True
    case_sensitive: bool = False


@dataclass(frozen=True)
class Rules:
    command_prefix: str = "!ask"
    special_cases: list[Rule] = field(default_factory=list)


@dataclass(frozen=True)
class Prompt:
    system: str = "Answer from the given context."
    answer_style: str = "Be brief."


@dataclass(frozen=True)
class Settings:
    chat: Chat = field(default_factory=Chat)
    model: Model = field(default_factory=Model)
    retrieval: Retrieval = field(default_factory=Retrieval)
    rules: Rules = field(default_factory=Rules)
    prompt: Prompt = field(default_factory=Prompt)


def _known(kind, values: dict | None):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in (values or {}).items() if k in names})


def parse(data: dict) -> Settings:
    rules = dict(data.get("rules") or {})
    rules["special_cases"] = [_known(Rule, r) for r in rules.get("special_cases", [])]
    parts = {"chat": Chat, "model": Model, "retrieval": Retrieval, "prompt": Prompt}
    return Settings(rules=_known(Rules, rules), **{k: _known(kind, data.get(k)) for k, kind in parts.items()})


def load(path: str | os.PathLike) -> Settings:
    return parse(json.loads(Path(path).read_text(encoding="utf-8")))


def first_existing(paths: list[str | os.PathLike]) -> Path:
    """The first of the paths that exists, home folders expanded."""
    for p in map(Path, paths):
        if p.expanduser().exists():
            return p.expanduser().resolve()
    raise FileNotFoundError(f"none of {[str(p) for p in paths]}")


def resolve(path: str, base: str | os.PathLike) -> Path:
    p = Path(path).expanduser()
    return p if p.is_absolute() else Path(base) / p
