"""Text scalars (X1-X3) as column expressions, with their DuckDB twins for the oracle.

Python's ``\\s`` is Unicode-aware while Java's and RE2's are ASCII, so the whitespace set
str.isspace() accepts is written out as one explicit class valid in both dialects.
Java gets (?d) so that '.' excludes only '\\n', as in Python and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.
WS = (r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")

# Markdown patterns removed for speech (X1), applied in this order.
MARKDOWN_STEPS = [
    (r"#{1,6}" + WS + "+", ""),
    (r"\*\*(.+?)\*\*", 1),
    (r"__(.+?)__", 1),
    (r"_(.+?)_", 1),
    (r"`(.+?)`", 1),
    (WS + "+", " "),
]

# Typographic replacements (X2), applied in this order, then every
# character >= U+0100 is dropped.
FOLD_MAP = [
    ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"),
    ("—", "-"), ("…", "..."), (" ", " "), ("→", "->"), ("←", "<-"),
    ("•", "-"), ("✓", "[OK]"), ("❌", "[X]"), ("\n\n\n", "\n\n"),
]
NON_LATIN1 = r"[^\x{00}-\x{FF}]"


def markdown_strip(text: Column) -> Column:
    """Headers, bold, underline, italics and code marks removed, whitespace collapsed, trimmed."""
    out = text
    for pat, rep in MARKDOWN_STEPS:
        out = F.regexp_replace(out, "(?d)" + pat, "$1" if rep == 1 else rep)
    return F.trim(out)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def markdown_strip_sql(col: str) -> str:
    out = col
    for pat, rep in MARKDOWN_STEPS:
        r = "\\1" if rep == 1 else rep
        out = f"regexp_replace({out}, {_sql_str(pat)}, {_sql_str(r)}, 'g')"
    return f"trim({out}, ' ')"


def typographic_fold(text: Column) -> Column:
    """Typographic quotes, dashes, ellipsis, NBSP, arrows, bullets, marks folded, then
    every character outside Latin-1 dropped."""
    out = text
    for a, b in FOLD_MAP:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, NON_LATIN1, "")


def fold_sql(col: str) -> str:
    out = col
    for a, b in FOLD_MAP:
        out = f"replace({out}, {_sql_str(a)}, {_sql_str(b)})"
    return f"regexp_replace({out}, {_sql_str(NON_LATIN1)}, '', 'g')"


def location_phrase(regions: Column, communes: Column) -> Column:
    """Natural phrase from region / commune arrays (singular / plural, joined by ' et ')."""
    r = (F.when(F.size(regions) == 1, F.concat(F.lit("dans la région de "), F.element_at(regions, 1)))
         .when(F.size(regions) > 1, F.concat(F.lit("dans les régions de "), F.array_join(regions, " et ")))
         .otherwise(F.lit("")))
    c = (F.when(F.size(communes) == 1, F.concat(F.lit("notamment la commune de "), F.element_at(communes, 1)))
         .when(F.size(communes) > 1, F.concat(F.lit("notamment les communes de "), F.array_join(communes, " et ")))
         .otherwise(F.lit("")))
    sep = F.when((F.size(communes) > 0) & (F.size(regions) > 0), F.lit(", ")).otherwise(F.lit(""))
    phrase = F.concat(r, sep, c)
    return F.when(phrase == "", F.lit("sur plusieurs localités")).otherwise(phrase)
