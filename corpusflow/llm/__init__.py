"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it.  Functions that run inside tasks are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
