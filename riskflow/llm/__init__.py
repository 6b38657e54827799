"""Operators of a training-data pipeline over web pages, documents and embeddings."""

import sys

from pyspark import cloudpickle

# executors get the code with each job, whether or not they have the library installed
cloudpickle.register_pickle_by_value(sys.modules["riskflow"])
