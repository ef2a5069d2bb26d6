"""Training-data operators for very large text corpora.

The functions that run on executors are pickled by value, so a job needs no
copy of this package on the executors' Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
