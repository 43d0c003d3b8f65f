"""Operators for preparing language-model training data.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value, so that these need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
