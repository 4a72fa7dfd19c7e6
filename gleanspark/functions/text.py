"""Word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    """The lower-case words of ``text``, or the first ``max_tokens``; no words for NULL.

    For a limit, the leading stretch holding those words is cut out first, so the tail of a long
    text is neither lowered nor split. It keeps one word more, because the lower case of a letter
    can depend on what follows, and a lowered word can fall apart into several.
    """
    whole = F.coalesce(text, F.lit(""))
    if max_tokens is None:
        return F.regexp_extract_all(F.lower(whole), F.lit(WORD), F.lit(0))
    stretch = r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,%d}+" % (max_tokens + 1)
    lowered = F.lower(F.regexp_extract(whole, stretch, 0))
    return F.slice(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), 1, max_tokens)
