"""Path patterns: compiled to anchored regexes on the driver, matched by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never indexed, in any letter case; an installation's own state stands in a hidden folder, which is not seen either.
HARD_EXCLUDED = ("agents-memory", "_context-backups", ".obsidian", ".git", ".venv", "node_modules")
#: Patterns of a new source.
INCLUDE = ("**/*.md", "**/*.txt")
EXCLUDE = ("**/.*/**", "**/.obsidian/**", "**/.git/**", "**/.venv/**", "**/node_modules/**")


def segment_regex(segment: str) -> str:
    """One path segment: * ? and [..] do not cross a slash."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := segment.find("]", i + 1 + (segment[i : i + 1] == "!"))) > 0:
            body = segment[i:end].replace("\\", "\\\\")
            body = body.replace("[", "\\[").replace("&&", "&\\&")
            out += "(?!/)[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def glob_regex(pattern: str) -> str:
    """A regex for ``path + "/"``.  Without a slash a pattern matches the last segment."""
    if "/" not in pattern:
        return "^(?:[^/]+/)*" + segment_regex(pattern) + "/$"
    parts = []
    for segment in pattern.split("/"):
        if segment == "**":
            if parts[-1:] != ["(?:[^/]+/)*"]:  # runs of ** say nothing more
                parts.append("(?:[^/]+/)*")
        else:
            parts.append(segment_regex(segment) + "/")
    return "^" + "".join(parts) + "$"


def matches_any(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """The path matches one of the patterns."""
    if not patterns:
        return F.lit(False)
    return F.concat(path, F.lit("/")).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def visible(path: Column) -> Column:
    """Not empty, no segment begins with a dot, and none is a hard-excluded directory."""
    hidden = F.exists(F.split(path, "/"), lambda s: s.startswith(".") | F.lower(s).isin([x.lower() for x in HARD_EXCLUDED]))
    return (path != "") & ~hidden


def selected(path: Column, include: list[str] | tuple[str, ...] = INCLUDE, exclude: list[str] | tuple[str, ...] = EXCLUDE) -> Column:
    """The path is in a source's scope."""
    return visible(path) & ~matches_any(path, exclude) & matches_any(path, include)
