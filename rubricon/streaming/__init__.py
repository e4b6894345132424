"""Stateless scoring operators on streaming DataFrames.

The reference reads bounded files only, so there is no windowing, watermark or
state here.  The row-wise operators (answer cleaning, blank test, linear head,
sigmoid, decode) are plain expressions, so the same functions accept a
DataFrame from ``spark.readStream``; these helpers only bundle them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import is_blank
from rubricon.operators import ordinal
from rubricon.sources.answers import load_answers
from rubricon.sources.sinks import OrdinalHead


def clean_answer_stream(stream: DataFrame, id_col: str = "BMH", text_col: str = "text",
                        keep: Sequence[str] = ()) -> DataFrame:
    """Answers from a stream: ``(BMH, text, blank)`` with null text dropped."""
    return load_answers(stream, id_col, text_col, keep).withColumn("blank", is_blank("text"))


def score_vector_stream(stream: DataFrame, head: OrdinalHead, vec: str = "vec",
                        features: str | None = None, out: str = "score") -> DataFrame:
    """Linear head -> probabilities -> decoded score on each arriving row.

    Small heads only (the expression form), since a streaming plan is
    re-planned per micro-batch; the weights are plan literals.
    """
    with_logits = ordinal.head_logits(stream, head, vec, features, method="expr")
    return ordinal.decode(ordinal.probabilities(with_logits), head.score_points, out=out)
