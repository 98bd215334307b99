"""Text helpers that keep Python string semantics on native columns.

All regex work in the library goes through here so the Java-vs-Python
differences (SURVEY Q10, Q11) are handled once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines().
SPLITLINES_RE = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"

# Whitespace as Python's str.strip() sees it (Unicode White_Space plus the
# four information separators Python also treats as space).
_WS = "[\\s\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
STRIP_RE = f"^{_WS}+|{_WS}+$"

# Token boundary for keyword search: anything that is not a letter or digit.
TOKEN_SPLIT_RE = "[^\\p{L}\\p{N}]+"


def py_strip(c: Column | str) -> Column:
    """``str.strip()`` with no argument."""
    return F.regexp_replace(_col(c), STRIP_RE, "")


def splitlines(c: Column | str) -> Column:
    """``str.splitlines()``: array of lines; no trailing empty element."""
    col = _col(c)
    parts = F.split(col, SPLITLINES_RE, -1)
    # Python drops the empty piece after a final line break, and returns []
    # for the empty string.
    trimmed = F.when(F.size(parts) > 0,
                     F.when(F.element_at(parts, -1) == "",
                            F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    return F.when(col.isNull(), F.lit(None)).when(col == "", F.array().cast("array<string>")).otherwise(trimmed)


def tokens(c: Column | str) -> Column:
    """Lower-cased letter/digit runs; empty pieces dropped."""
    return F.filter(F.split(F.lower(_col(c)), TOKEN_SPLIT_RE, -1), lambda t: t != "")


def token_line(c: Column | str) -> Column:
    """``tokens`` as one string, a blank between two (and perhaps one at either end); null for null."""
    return F.regexp_replace(F.lower(_col(c)), TOKEN_SPLIT_RE, " ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
