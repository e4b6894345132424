"""rubricon — ordinal scoring of free-text answers, expressed as Spark jobs.

Subpackages
-----------
sources     readers, required-column checks, sinks, model weight tables, test fixtures
functions   column expressions (blank test, sigmoid, ordinal decode/loss, padding, linear logits)
operators   DataFrame operators: prepare, agree, pool, ordinal, profile, track, batch
plans       the registered queries and their DuckDB oracle SQL
streaming   stateless scoring operators applied to streaming DataFrames
jobs        end-to-end fit/validate, table scoring, profiling; backbone + head scorer factory
cli         spark-submit entry point (score, profile, fit, agree)
"""

from rubricon.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
