"""Lintang: Spark-native curation, distillation, audit and scoring of question/answer corpora."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
