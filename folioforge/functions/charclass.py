"""Character classes and trimming that behave the same on every Unicode text.

Spark's regex engine is ASCII-only for ``\\s``, ``\\w`` and ``\\d`` and its ``trim``
removes U+0020 only.  Text rules in this package are defined over Unicode
whitespace, word characters and decimal digits, so they are spelled out here once
and every pattern is composed from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Insides of bracket expressions.  Spelled with general categories where possible: a
# category is one table lookup, a list of code point ranges is one test per range.
WS_INLINE = r"\p{Z}\t\x0b\f\r\x1c\x1d\x1e\x1f\x85"
WS = rf"{WS_INLINE}\n"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

S = f"[{WS}]"        # one whitespace character
NS = f"[^{WS}]"      # one non-whitespace character
W = f"[{WORD}]"      # one word character
D = f"[{DIGIT}]"     # one decimal digit

# The same whitespace set as a literal string, for the trim functions.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WS_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def words(text: Column) -> Column:
    """Whitespace-separated words as an array."""
    return F.regexp_extract_all(text, F.lit(f"{NS}+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, counted in one pass without building the array."""
    return F.regexp_count(text, F.lit(f"{NS}+"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Keeps big nested expressions linear: a Column used twice is otherwise planned
    (and, inside interpreted lambdas, evaluated) twice.
    """
    return F.transform(F.array(value), body).getItem(0)


def record(**fields: Column) -> Column:
    """A struct with named fields; the branches of a fold must agree on the names.

    Naming instead of casting matters: a cast would copy the arrays carried in the state
    at every step of the fold.
    """
    return F.struct(*[value.alias(name) for name, value in fields.items()])
