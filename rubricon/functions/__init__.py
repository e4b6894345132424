"""Column expressions.  Everything here stays inside the JVM (built-in functions
and higher-order array functions) so it runs under whole-stage codegen or the
interpreted expression evaluator, never in a Python worker."""

from rubricon.functions.text import is_blank, text_length
from rubricon.functions.ordinal import (
    sigmoid, decode_scores, bce_with_logits_sum, cumulative_targets, linear_logits,
)
from rubricon.functions.arrays import pad_truncate, ones_mask

__all__ = [
    "is_blank", "text_length", "sigmoid", "decode_scores", "bce_with_logits_sum",
    "cumulative_targets", "linear_logits", "pad_truncate", "ones_mask",
]
