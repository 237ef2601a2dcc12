"""Operators that prepare text corpora for training.

Nothing outside this subpackage imports it. Functions that run inside tasks
are shipped with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
