"""Word arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators, as text and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
PATTERN = r"[\x20\x09-\x0D]+"


def word_array(text: str) -> Column:
    """The words of a text in order: an empty array if it has none, null for null."""
    return F.array_remove(F.split(F.col(text), PATTERN), "")
