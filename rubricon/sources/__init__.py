"""Readers, column checks, sinks and model weight tables."""

from rubricon.sources.answers import (
    load_answers, read_question, read_table, require_columns, write_by_question,
)
from rubricon.sources.calibration import load_calibration, union_calibration
from rubricon.sources.sinks import (
    OrdinalHead, load_head, save_head, to_reference_layout, write_metrics_json, write_scored,
)

__all__ = [
    "load_answers", "read_question", "read_table", "require_columns", "write_by_question",
    "load_calibration", "union_calibration", "OrdinalHead", "load_head", "save_head",
    "to_reference_layout", "write_metrics_json", "write_scored",
]
