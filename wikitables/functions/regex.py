"""Render the shared rules for Spark (Java regex) and for DuckDB (RE2), and apply them as Columns.

The two engines disagree on what ``\\s`` and ``.`` mean and on line ends.  The
rules are meant with Unicode white space, with ``.`` stopping at every line
terminator, and with ``\\n`` as the only line end of ``^`` and ``$``, so both
renderings spell those classes out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rule

_SPACE_BUT_NEWLINE = r"\t\r\f \x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SPACE = r"\n" + _SPACE_BUT_NEWLINE
_DOT = r"[^\n\r\x{2028}\x{2029}]"


def _spell_out(pattern: str, dot_all: bool) -> str:
    """Replace ``\\s``, ``\\S`` and ``.`` by explicit character classes."""
    out, in_class, i = [], False, 0
    if "[^\\S\\n]" in pattern:
        pattern = pattern.replace("[^\\S\\n]", f"[{_SPACE_BUT_NEWLINE}]")
    if "[\\s\\S]" in pattern:
        pattern = pattern.replace("[\\s\\S]", "(?s:.)")
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            token = pattern[i : i + 2]
            if token == r"\x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i) + 1
                out.append(pattern[i:end])
                i = end
                continue
            if token == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif token == r"\S":
                if in_class:
                    raise ValueError(f"\\S inside a class: {pattern}")
                out.append(f"[^{_SPACE}]")
            else:
                out.append(token)
            i += 2
            continue
        if pattern.startswith("(?s:.)", i):
            out.append("(?s:.)")
            i += 6
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        if ch == "." and not in_class and not dot_all:
            out.append(_DOT)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "", wide: bool = True) -> str:
    """The pattern for Spark; ``(?d)`` makes ``\\n`` the only line end.

    ``wide=False`` keeps the engine's own ASCII classes, which match several
    times faster and mean the same on texts without :data:`EXOTIC` characters.
    """
    if wide:
        return f"(?d{flags})" + _spell_out(pattern, "s" in flags)
    return f"(?d{flags})" + pattern.replace("[^\\S\\n]", r"[ \t\f\x0B]").replace("[\\s\\S]", "(?s:.)")


# Characters on which the ASCII classes and the spelled-out ones differ.
EXOTIC = r"[\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# The same white space as literal characters, for trimming.
WHITE_SPACE = (
    "\n\t\r\f \x0b\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def re2(pattern: str, flags: str = "") -> str:
    """The pattern for DuckDB."""
    prefix = f"(?{flags})" if flags else ""
    return prefix + _spell_out(pattern, "s" in flags)


def java_replacement(replacement: str) -> str:
    """``\\1`` group references to ``$1``, with literal ``$`` protected."""
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "\\" and replacement[i + 1 : i + 2].isdigit():
            out.append("$" + replacement[i + 1])
            i += 2
            continue
        out.append("\\" + ch if ch in "$\\" else ch)
        i += 1
    return "".join(out)


def replace_all(col: Column, pattern: str, replacement: str, flags: str = "", wide: bool = True) -> Column:
    return F.regexp_replace(col, F.lit(java(pattern, flags, wide)), F.lit(java_replacement(replacement)))


def apply_rules(col: Column, rules: list[Rule], wide: bool = True) -> Column:
    """Apply the rules in order as one nested expression, which stays inside whole-stage code generation."""
    for _, flags, pattern, replacement in rules:
        col = replace_all(col, pattern, replacement, flags, wide)
    return col


def extract(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(col, java(pattern, flags), group)


def extract_all(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern, flags)), F.lit(group))


def matches(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(java(pattern, flags))


def has_exotic(col: Column) -> Column:
    """Whether a text holds any of the :data:`EXOTIC` characters; looking for each costs less than the class does."""
    found = [col.contains(c) for c in WHITE_SPACE if c not in "\n\t\f \x0b"]
    return reduce(lambda one, other: one | other, found)


def trim_ws(col: Column) -> Column:
    """Strip white space of every kind (``trim`` strips only U+0020)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def rewrite(col: Column, pattern: str, rebuild: Callable[[Column], Column], flags: str = "") -> Column:
    """Replace every match by ``rebuild(match)``: split into gaps and matches, zip them back.

    ``col`` is read twice, so pass a plain column, not a long expression.
    """
    regex = java(pattern, flags)
    gaps = F.split(col, regex, -1)
    found = F.regexp_extract_all(col, F.lit(regex), F.lit(0))
    rebuilt = F.transform(found, rebuild)
    pieces = F.zip_with(gaps, rebuilt, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit(""))))
    return F.array_join(pieces, "")


def rewrite_spans(col: Column, opening: str, closing: str, rebuild: Callable[[Column], Column], flags: str = "") -> Column:
    """Replace every span from an opening to the next closing by ``rebuild(span)``, in time linear in the text.

    The same spans as of a lazy ``opening.*?closing``, which looks for a closing
    from every opening that has none.  Here the text is cut at the closings
    first, and a piece's first opening is where its span begins.  ``col`` is
    read twice, so pass a plain column, not a long expression.
    """
    first, last = java(opening, flags), java(closing, flags)
    pieces = F.split(col, last, -1)
    ends = F.regexp_extract_all(col, F.lit(last), F.lit(0))

    def piece(text: Column, end: Column) -> Column:
        parts = F.split(text, first, 2)
        span = F.concat(F.substring(text, F.length(parts[0]) + 1, F.length(text)), end)
        return F.when(F.size(parts) < 2, F.concat(text, F.coalesce(end, F.lit("")))).when(end.isNull(), text).otherwise(
            F.concat(parts[0], rebuild(span))
        )

    return F.array_join(F.zip_with(pieces, ends, piece), "")
