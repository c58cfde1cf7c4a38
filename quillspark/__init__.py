"""quillspark: document, retrieval and rating analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
