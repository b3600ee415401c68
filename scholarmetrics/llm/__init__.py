"""Operators of a large-scale training-data pipeline (one module per operator).

Nothing else in the library imports this package. Each module has the general
operator (its own interface and outputs), ``query(spark, sf_dir)`` that applies
it to its whole table, and ``ORACLE_SQL`` where DuckDB SQL can state the result.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no
# installed copy of it on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
