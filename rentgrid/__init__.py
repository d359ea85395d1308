"""rentgrid: comparing and modelling snapshots of a marketplace, and preparing training text, on Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to Spark carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
