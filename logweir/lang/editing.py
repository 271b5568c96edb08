"""Helpers for editors of queries: clauses in, out and listed, balance, shifted errors, history."""

from __future__ import annotations

import re

from .errors import Location, QuerySyntaxError
from .lexer import AND, LITERAL, OR, Token, tokens

_BARE = re.compile(r"[A-Za-z0-9_\-:@+./]+")
_OPERATORS = ("=", "!=", "~", "!~", "<", "<=", ">", ">=")
MOST_HISTORY, MOST_COMPLETIONS = 10, 5
_CLOSES = {")": "(", "]": "[", "}": "{"}


def quote(text: str) -> str:
    """A literal that reads as this text: bare where that is possible."""
    if _BARE.fullmatch(text) and "//" not in text and text.lower() not in (AND, OR):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def clause(key: str, op: str, value: str) -> str:
    return f"{quote(key)}{op}{quote(value)}"


def clauses(text: str) -> list[tuple[str, str, str]]:
    """Key, operator and value of each predicate, in order; none of a text that has no tokens."""
    return [(t[0].text, t[1].kind, t[2].text) for t, _ in _found(text)]


def _found(text: str) -> list[tuple[list[Token], int]]:
    try:
        all_tokens = tokens(text)
    except QuerySyntaxError:
        return []
    out = []
    for i in range(len(all_tokens) - 2):
        three = all_tokens[i : i + 3]
        if three[0].kind == LITERAL and three[1].kind in _OPERATORS and three[2].kind == LITERAL:
            out.append((three, i))
    return out


def add_clause(text: str, key: str, op: str, value: str) -> str:
    """The text with a predicate more, unless it has it."""
    if (key, op, value) in clauses(text):
        return text
    return f"{text.rstrip()} AND {clause(key, op, value)}" if text.strip() else clause(key, op, value)


def remove_clause(text: str, key: str, op: str, value: str) -> str:
    """The text without a predicate, without the AND or OR beside it and parentheses that held nothing else."""
    found = next((i for t, i in _found(text) if (t[0].text, t[1].kind, t[2].text) == (key, op, value)), None)
    if found is None:
        return text
    left = tokens(text)
    lo, hi = found, found + 3
    while lo > 0 and hi < len(left) and (left[lo - 1].kind, left[hi].kind) == ("(", ")"):
        lo, hi = lo - 1, hi + 1
    if lo > 0 and left[lo - 1].kind in (AND, OR):
        lo -= 1
    elif hi < len(left) and left[hi].kind in (AND, OR):
        hi += 1
    kept = left[:lo] + left[hi:]
    out = ""
    for t in kept:
        piece = {AND: "AND", OR: "OR"}.get(t.kind, quote(t.text) if t.kind == LITERAL else t.text)
        tight = not out or out[-1] in "(=~<>!" or piece[0] in ")=~<>!"
        out += piece if tight else f" {piece}"
    return out


def balanced(text: str) -> bool:
    """Quotes are closed and brackets match."""
    try:
        marks = [t.kind for t in tokens(text)]
    except QuerySyntaxError:
        return False
    open_marks: list[str] = []
    for m in marks:
        if m in "([{":
            open_marks.append(m)
        elif m in _CLOSES and (not open_marks or open_marks.pop() != _CLOSES[m]):
            return False
    return not open_marks


def with_range(start: str, end: str, text: str) -> tuple[str, int]:
    """A query with a range before it, and how many columns the first line moved."""
    prefix = f"[{start},{end}] "
    return prefix + text, len(prefix)


def shifted(locations: tuple[Location, ...], columns: int) -> list[Location]:
    """Places in the text that stood behind a prefix of so many columns."""
    return [Location(x.line, max(1, x.col - columns) if x.line == 1 else x.col, x.msg) for x in locations]


def remember(history: list[str], text: str) -> list[str]:
    """The history with a query first, once, at most ten long."""
    return [text, *[h for h in history if h != text]][:MOST_HISTORY] if text.strip() else history


def completions(words: list[str], prefix: str) -> list[str]:
    """Up to five words that start with a prefix, whatever the case."""
    return sorted(w for w in words if w.lower().startswith(prefix.lower()))[:MOST_COMPLETIONS]
