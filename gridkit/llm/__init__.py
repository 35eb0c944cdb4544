"""Training-data pipeline operators, each one a Spark job.

Nothing else in the library imports this subpackage; ``queries.py`` lists the
registered queries.  Python functions that run inside tasks are pickled by
value, so executors need numpy, pyarrow and the tokenizer libraries but not
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
