"""Path patterns as regular expressions, made once on the driver and run inside Spark."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(pattern: str) -> str:
    """One component: * and ? stay inside it, [..] are classes, \\ quotes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in "!^" else i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out += "[" + ("^/" if negated else "") + re.sub(r"([\[\]\\&~])", r"\\\1", body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def to_regex(pattern: str, ignore_case: bool = False) -> str:
    """Matches a path that the pattern fits, or that lies below such a path.

    A leading slash anchors at the root; otherwise the pattern may begin at any component. ** is any number of
    components.
    """
    if not pattern.strip("/"):
        raise ValueError("empty pattern")
    parts = [p for p in pattern.split("/") if p]
    body = ""
    for n, p in enumerate(parts):
        last = n == len(parts) - 1
        if p == "**":
            body += "(?:[^/]+/)*" + ("[^/]+" if last else "")
        else:
            body += _part(p) + ("" if last else "/")
    start = "^/" if pattern.startswith("/") else "^(?:.*/)?"
    return ("(?is)" if ignore_case else "(?s)") + start + body + "(?:/.*)?$"


def matches(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    return path.rlike(to_regex(pattern, ignore_case))


def may_match_below(path: Column, pattern: str) -> Column:
    """Whether a directory can have something below it that the pattern fits."""
    parts = [p for p in pattern.split("/") if p]
    if not pattern.startswith("/") or "**" in parts[:1]:
        return path.isNotNull()
    stems = ["^/?$"]
    for n in range(1, len(parts) + 1):
        if parts[n - 1] == "**":
            stems.append("^/" + "/".join(_part(p) for p in parts[: n - 1]) + "(?:/.*)?$")
            break
        stems.append("^/" + "/".join(_part(p) for p in parts[:n]) + ("(?:/.*)?$" if n == len(parts) else "$"))
    return path.rlike("(?s)" + "|".join(f"(?:{s})" for s in stems))


def select(path: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Patterns in order; one after '!' takes paths back out of what matched before."""
    out = F.lit(False)
    for p in patterns:
        hit = matches(path, p.removeprefix("!"), ignore_case)
        out = out & ~hit if p.startswith("!") else out | hit
    return out


def read_patterns(text: str) -> list[str]:
    """The lines of a pattern file: no blanks, no comments, $NAME expanded, $$ a dollar sign."""
    lines = (x.strip() for x in text.splitlines())
    kept = (x for x in lines if x and not x.startswith("#"))
    return [re.sub(r"\$(\$|\w+|\{\w+\})", lambda m: "$" if m[1] == "$" else os.environ.get(m[1].strip("{}"), ""), x) for x in kept]
