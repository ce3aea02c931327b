"""Tabular conversion jobs on Spark: dirty exports in, clean import-ready tables out."""

import sys

from pyspark import cloudpickle

from .plans.template import Lookup, Rule, Template
from .session import scratch_dir, session_conf

__all__ = ["Lookup", "Rule", "Template", "scratch_dir", "session_conf"]

# Ship the code of task functions with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
