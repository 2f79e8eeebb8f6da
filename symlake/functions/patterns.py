"""Wildcard and camel-case search patterns as Catalyst predicates.

A pattern with a literal head also emits ``startswith(head)``, which reaches Parquet row-group statistics; the
regular expression only runs on rows that survive it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlake.functions.names import _col

# The characters that "." does not match in a Java regular expression.
LINE_ENDS = "[\\n\\r\\u0085\\u2028\\u2029]"


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_/" or ord(ch) > 127 else "\\" + ch


def find_regex(pattern: str) -> str:
    """Unanchored regular expression for a wildcard pattern, used to find ranges inside text."""
    return "".join({"*": ".*", "?": "."}.get(ch) or _literal(ch) for ch in pattern)


def glob_regex(pattern: str, prefix: bool = True) -> str:
    return "\\A(?:" + find_regex(pattern) + (".*" if prefix else "") + ")\\z"


def _head(pattern: str) -> str:
    cut = [pattern.index(w) for w in "*?" if w in pattern]
    return pattern[: min(cut)] if cut else pattern


def _one_char(c: Column, pattern: str) -> Column:
    return F.lit(True) if pattern in "*?" else c.startswith(pattern)


def glob_match(c, pattern: str, prefix: bool = True) -> Column:
    """``*`` any run, ``?`` one character; matches from the start and, by default, any continuation.

    The empty pattern matches nothing. One-character patterns compare the first character only, so ``*`` and
    ``?`` match every key including the empty one; longer patterns never match keys that span several lines.
    """
    c = _col(c)
    if pattern == "":
        return F.lit(False)
    if len(pattern) == 1 and prefix:
        return _one_char(c, pattern)
    head = _head(pattern)
    if head == pattern:
        return (c.startswith(head) & ~c.rlike(LINE_ENDS)) if prefix else c == pattern
    matched = c.rlike(glob_regex(pattern, prefix))
    return c.startswith(head) & matched if head else matched


def camel_regex(pattern: str, every_capital: bool = False) -> str:
    out = []
    for i, ch in enumerate(pattern):
        if ch.isupper():
            # The first two characters are taken as they stand unless every capital may skip text.
            out.append((".*" if i > (0 if every_capital else 1) else "") + ch)
        elif ch.islower():
            out.append("[" + ch + ch.upper() + "]")
        else:
            out.append({"*": ".*", "?": "."}.get(ch) or _literal(ch))
    return "\\A(?:" + "".join(out) + ".*)\\z"


def camel_match(c, pattern: str, every_capital: bool = False) -> Column:
    """Camel-case prefix match: lower case matches both cases, a capital matches itself and may skip text."""
    c = _col(c)
    if pattern == "":
        return F.lit(False)
    if len(pattern) == 1:
        if pattern.islower():
            return c.startswith(pattern) | c.startswith(pattern.upper())
        return c.startswith(pattern)
    return c.rlike(camel_regex(pattern, every_capital))


def scope_match(scope, c) -> Column:
    """Null or empty scope takes all; ``*/X`` takes ``X`` and every ``.../X``; anything else is equality.

    ``scope`` is a column, or a Python string which then folds into the plan.
    """
    c = _col(c)
    if scope is None:
        return F.lit(True)
    if isinstance(scope, str):
        if scope == "":
            return F.lit(True)
        if scope.startswith("*"):
            return c.endswith(scope[1:]) | (c == scope[2:])
        return c == scope
    wild = scope.startswith("*")
    return (
        F.when(scope.isNull() | (scope == ""), True)
        .when(wild, c.endswith(F.substring(scope, F.lit(2), F.length(scope)))
              | (c == F.substring(scope, F.lit(3), F.length(scope))))
        .otherwise(c == scope)
    )
