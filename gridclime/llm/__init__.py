"""Training-data operators: fingerprints, decontamination, scans, classifiers, filters, joins, mixing and archives."""

import sys

from pyspark import cloudpickle

# tasks get the functions of this subpackage by value, so it need not be installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
