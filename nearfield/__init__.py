"""A Spark-native vector-search and training-data engine."""

import os
import sys

__version__ = "0.1.0"


def _workers_find_this() -> bool:
    """Whether Python workers can import the package: it is installed, on PYTHONPATH, or in the folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return "site-packages" in root or any(p and os.path.abspath(p) == root for p in places)


if not _workers_find_this():
    # ship functions whole instead of by name: slower to start, but it works from any folder
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
