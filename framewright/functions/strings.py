"""String functions: LIKE with sets, path parts, key=value lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(like: str) -> str:
    """The regular expression of a LIKE pattern with ``%``, ``_``, ``[set]``, ``[^set]``,
    ranges and ``\\`` as escape."""
    out, i = [], 0
    while i < len(like):
        c = like[i]
        if c == "\\" and i + 1 < len(like):
            i += 1
            out.append(re.escape(like[i]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (end := like.find("]", i + 2)) > 0:
            body = like[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append(f"[{'^' * negated}{re.sub(r'([\\\[\]&^])', r'\\\1', body)}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def like(text: Column, pattern: str) -> Column:
    return text.rlike(like_pattern(pattern))


def same_prefix(a: Column, b: Column, n: int) -> Column:
    return F.lower(F.substring(a, 1, n)) == F.lower(F.substring(b, 1, n))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*[/\\])[^/\\]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def with_extension(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("." + new))


def key_value(line: Column) -> Column:
    """``key, value`` of a line split at its first ``=``; null without one."""
    pair = F.split(line, "=", 2)
    return F.when(F.size(pair) == 2, F.struct(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value")))


def comment(line: Column) -> Column:
    return F.regexp_extract(line, r"#(.*)$", 1)


def token(line: Column, separators: str, number: int) -> Column:
    """The number-th non-empty token, from 1; null if there are fewer."""
    parts = F.array_remove(F.split(line, f"[{re.escape(separators)}]+"), "")
    return F.get(parts, F.lit(number - 1))


def replaced(text: Column, old: str, new: str) -> Column:
    """One character for another."""
    return F.translate(text, old, new)


def number_token(line: Column, separators: str, number: int, kind: str = "double") -> Column:
    """The number-th token as a number; null if it is none."""
    return token(line, separators, number).try_cast(kind)


def line_count(text: Column) -> Column:
    """Lines of a text; an unfinished last line counts, none follows the last line break."""
    whole = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(F.length(text) == 0, 0).when(text.endswith("\n"), whole).otherwise(whole + 1)
