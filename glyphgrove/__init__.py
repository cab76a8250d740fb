"""Descriptor clustering, visual vocabularies and frame retrieval as Spark jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the code they call, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
