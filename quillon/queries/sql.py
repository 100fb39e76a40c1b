"""Pieces of DuckDB SQL that the oracles share. They are written apart from the Spark expressions."""

from __future__ import annotations

from quillon.functions.text import STOPWORDS

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CUT = "chr(1)"


def plain(c: str) -> str:
    return f"regexp_replace({c}, '§[^\\n]|&[0-9A-FK-ORa-fk-or]', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_SPACES}]+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"lower({collapse(plain(c))})"


def compact(c: str) -> str:
    return f"trim(regexp_replace(lower({plain(c)}), '[^a-z0-9_-]+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({compact(c)}, '[ -]+'), lambda w: w <> '')"


def words(c: str) -> str:
    return f"list_filter(string_split({compact(c)}, ' '), lambda w: w <> '')"


def terms(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter({words(c)}, lambda w: w NOT IN ({stop}) AND (length(w) >= 2 OR regexp_full_match(w, '[0-9]'))))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def rfind(c: str, piece: str) -> str:
    return f"(CASE WHEN instr(reverse({c}), '{piece[::-1]}') = 0 THEN -1 ELSE length({c}) - instr(reverse({c}), '{piece[::-1]}') + 1 - {len(piece)} END)"


def sanitize(c: str) -> str:
    return f"replace(replace({collapse(c)}, '@everyone', 'everyone'), '@here', 'here')"


def sentences(c: str) -> str:
    """Sentence ends and dashes marked, then split: the engine has no look-behind."""
    marked = f"regexp_replace({c}, '([.!?])[{_SPACES}]+', '\\1' || {CUT}, 'g')"
    return f"string_split(regexp_replace({marked}, '[{_SPACES}]+-[{_SPACES}]+|\\n+', {CUT}, 'g'), {CUT})"


def cells(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, '|'), lambda x: {strip('x')}), lambda x: x <> '')"


def reformat(c: str) -> str:
    bare = f"regexp_replace({c}, '^#+\\s*', '')"
    joined = f"CASE WHEN contains({bare}, '|') AND len({cells(bare)}) > 0 THEN array_to_string({cells(bare)}, ' - ') ELSE {bare} END"
    return f"trim(regexp_replace(replace({joined}, '`', ''), '[{_SPACES}]+', ' ', 'g'), ' -•')"


def truncate(c: str, n: int | str) -> str:
    """``n``: a number, or SQL for one."""
    head = f"regexp_replace({c}[1:greatest(0, {n} - 1)], '[{_SPACES}]+$', '')"
    last = f"greatest({', '.join(rfind(head, x) for x in (' ', '.', ',', ';'))})"
    return f"(CASE WHEN length({c}) <= {n} THEN {c} WHEN {last} >= {n} * 0.55::DOUBLE THEN regexp_replace({head}[1:{last}], '[{_SPACES}]+$', '') || '…' ELSE {head} || '…' END)"
