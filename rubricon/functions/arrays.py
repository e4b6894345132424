"""Array helpers for token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def pad_truncate(tokens: Column | str, max_length: int | Column, pad_id: int = 0,
                 side: str = "right") -> tuple[Column, Column]:
    """Truncate a token array to ``max_length`` and pad it to exactly that length.

    Returns ``(input_ids, attention_mask)``; the mask is 1 on real tokens and 0 on
    padding.  ``side`` chooses where padding goes; truncation always keeps the head.
    ``max_length`` may be a column (a per-row target length, e.g. the longest in a batch).
    """
    if side not in ("right", "left"):
        raise ValueError(f"side must be 'right' or 'left', got {side!r}")
    t = _c(tokens)
    L = F.lit(max_length) if isinstance(max_length, int) else max_length
    kept = F.slice(t, F.lit(1), L)
    n_pad = F.greatest(L - F.size(kept), F.lit(0))
    pad = F.array_repeat(F.lit(pad_id).cast("int"), n_pad)
    ones = F.array_repeat(F.lit(1), F.size(kept))
    zeros = F.array_repeat(F.lit(0), n_pad)
    kept = kept.cast("array<int>")
    if side == "right":
        return F.concat(kept, pad), F.concat(ones, zeros)
    return F.concat(pad, kept), F.concat(zeros, ones)


def ones_mask(mask: Column | str | None) -> Column:
    """Default attention mask: a missing mask means every position is real."""
    if mask is None:
        return F.lit(1)
    return F.coalesce(_c(mask), F.lit(1))
