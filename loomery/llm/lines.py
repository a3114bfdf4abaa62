"""Column expressions over lines and words, shared by the line-based operators.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the word rule: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def normal(line: Column) -> Column:
    """A line in lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE_RUN, " "))


def text_lines(text: Column) -> Column:
    """The \\n-split lines of a text; null counts as the empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, also inside lambdas (a bound variable, not an inlined expression)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
