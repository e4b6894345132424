"""Text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes beyond Unicode
# whitespace are the information separators U+001C..U+001F; (?U) makes \s
# Unicode-aware so U+3000 (ideographic space) counts as blank too.
BLANK_PATTERN = r"(?U)^[\s\x1c-\x1f]*$"


def is_blank(text: Column | str) -> Column:
    """True when text is null or holds only whitespace (skip predicate of batch scoring)."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNull() | c.rlike(BLANK_PATTERN)


def text_length(text: Column | str, null_as_empty: bool = True) -> Column:
    """Length in code points; null counts as the empty string when asked."""
    c = F.col(text) if isinstance(text, str) else text
    if null_as_empty:
        c = F.coalesce(c, F.lit(""))
    return F.length(c).cast("long")
