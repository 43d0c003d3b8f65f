"""adspark: click-through-rate analytics on Spark DataFrames.

Sub-packages
------------
``sources``    reading, writing, resolving relations, durable scratch tables
``functions``  column expressions and the two tail probabilities
``operators``  DataFrame-in, DataFrame-out operators
``ml``         encoders, training, search, scoring and local explanation
``plans``      end-to-end jobs and the registered queries
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"


def _ship_task_functions() -> None:
    """Let Python workers run the few task functions without this package installed."""
    from adspark.functions import tails
    from adspark.ml import explain  # noqa: F401 (imports the module below)
    cloudpickle.register_pickle_by_value(tails)
    cloudpickle.register_pickle_by_value(sys.modules["adspark.ml.explain"])


_ship_task_functions()
