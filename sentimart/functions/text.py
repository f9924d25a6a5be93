"""Column expressions over text: whitespace tokens without punctuation.

All of these are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters and the whitespace split
# pattern.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE = r"\s+"


def strip_punct_if_word(tok: Column) -> Column:
    """Strip surrounding punctuation unless 2 or fewer characters remain.

    Keeps emoticons such as ``:)`` intact while ``great!!`` becomes ``great``.
    """
    stripped = F.btrim(tok, F.lit(PUNCTUATION))
    return F.when(F.length(stripped) <= 2, tok).otherwise(stripped)


def split_tokens(text: Column) -> Column:
    """Whitespace tokens of a text, empty strings removed."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def tokens(text: Column) -> Column:
    """Whitespace tokens of the whole text, empties removed, punctuation
    stripped."""
    return F.transform(split_tokens(F.coalesce(text, F.lit(""))), strip_punct_if_word)
