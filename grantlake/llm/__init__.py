"""Operators for training-data pipelines, and their registered queries.

Python code of this subpackage travels with the tasks, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_queries():
    """Registered queries of this subpackage and their comparison SQL."""
    from . import registered

    return registered.QUERIES, registered.ORACLES
