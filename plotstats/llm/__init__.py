"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``catalog.py``
registers one query per operator and ``oracle.py`` holds their DuckDB SQL where
SQL can express them.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
