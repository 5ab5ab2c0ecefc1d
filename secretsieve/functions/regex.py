"""Turns a pattern in the common dialect into one for Spark's (Java) matcher."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the Unicode white space, word and digit classes, for use inside [].
# Latin-1 members are listed one by one: Java looks those up in one table.
SPACE_NOT_BLANK = (
    r"\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = " " + SPACE_NOT_BLANK
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

# The same white space as a plain string, for trim functions.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}


def spark_regex(pattern: str) -> str:
    """Spell out ``\\s \\w \\d`` and ``.``: Java's own are ASCII, and its dot
    stops at more line ends than a newline."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            members = _CLASSES.get(nxt.lower())
            if members is None:
                out.append(ch + nxt)
            elif in_class:
                out.append(members)
            else:
                out.append(f"[{'^' if nxt.isupper() else ''}{members}]")
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            if pattern[i + 1] == "^":
                out.append("[^")
                i += 2
                continue
        elif ch == ".":
            ch = r"[^\n]"
        out.append(ch)
        i += 1
    return "".join(out)


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))
