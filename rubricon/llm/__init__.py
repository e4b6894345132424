"""Operators for building training corpora.

Nothing outside this package (and the top-level ``corpus_pipeline.py``) imports it.
Functions that run inside Python workers are pickled by value, so executors
need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
