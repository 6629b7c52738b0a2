"""Path globs: patterns of literals and globs compiled once on the driver to a regular expression or a list.

Paths hold dots, not slashes, so ``*`` spans dots. ``!`` in front negates, ``{a,b}`` is either, ``*`` and ``?`` don't match a leading dot,
``**`` alone between slashes matches any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"[*?\[\]{}()!+@]")


def is_glob(pattern: str) -> bool:
    return bool(_SPECIAL.search(pattern))


def braces(pattern: str) -> list[str]:
    """Every alternative of a pattern with ``{a,b}`` and ``{1..3}``."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner = pattern[start + 1 : i]
                span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)
                parts, level, last = [], 0, 0
                for k, x in enumerate(inner):
                    level += (x == "{") - (x == "}")
                    if x == "," and level == 0:
                        parts.append(inner[last:k])
                        last = k + 1
                parts.append(inner[last:])
                if span:
                    a, b = int(span[1]), int(span[2])
                    parts = [str(n) for n in (range(a, b + 1) if a <= b else range(a, b - 1, -1))]
                elif len(parts) == 1:
                    continue
                return [out for part in parts for out in braces(pattern[:start] + part + pattern[i + 1 :])]
    return [pattern]


def _part(text: str) -> str:
    """One slash-free piece as a regular expression."""
    if text == "**":
        return r"(?:(?!\.).*)"
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            negated = body[0] in "!^"
            inner = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' if negated else ''}{inner}]"
            i = end
        else:
            out += re.sub(r"([^A-Za-z0-9_])", r"\\\1", c)
        i += 1
    return (r"(?!\.)" if text[:1] in "*?[" else "") + ("(?=.)" if text[:1] == "*" else "") + out


def regex(pattern: str) -> str:
    """A whole-string regular expression, the same in Java and Python."""
    negated = (len(pattern) - len(pattern.lstrip("!"))) % 2 == 1
    pattern = pattern.lstrip("!")
    either = "|".join("/".join(map(_part, one.split("/"))) for one in braces(pattern))
    return f"^(?!(?:{either})$).*$" if negated else f"^(?:{either})$"


class Matcher:
    """FLT-12: literals in a set, globs in one expression."""

    def __init__(self, patterns: Iterable[str]):
        patterns = list(patterns)
        self.literals = [p for p in patterns if not is_glob(p)]
        globs = [regex(p) for p in patterns if is_glob(p)]
        self.globs = "|".join(f"(?:{g})" for g in globs)

    @property
    def empty(self) -> bool:
        return not self.literals and not self.globs

    def matches(self, path: str) -> bool:
        return path in self.literals or bool(self.globs and re.search(self.globs, path, re.DOTALL))

    def column(self, path: Column) -> Column:
        ok = path.isin(self.literals) if self.literals else F.lit(False)
        return ok | path.rlike("(?s)" + self.globs) if self.globs else ok


def admits(path: Column, mode: str, patterns: Iterable[str]) -> Column:
    """Include or exclude by patterns; none let everything through."""
    matcher = Matcher(patterns)
    if matcher.empty:
        return F.lit(True)
    return ~matcher.column(path) if mode == "exclude" else matcher.column(path)


def rate(path: Column, rates: Mapping[str, float], default: float) -> Column:
    """STR-5: a literal's rate beats globs, of which the first in order counts; rates that aren't positive are no rule."""
    rules = {p: r for p, r in rates.items() if r > 0}
    out = None
    for pattern, value in [*((p, r) for p, r in rules.items() if not is_glob(p)), *((p, r) for p, r in rules.items() if is_glob(p))]:
        test = path.rlike("(?s)" + regex(pattern)) if is_glob(pattern) else path == pattern
        out = F.when(test, float(value)) if out is None else out.when(test, float(value))
    return F.lit(float(default)) if out is None else out.otherwise(float(default))
