"""Column expressions and the few Python functions Spark has no equivalent for."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship_by_value(module: str) -> None:
    """Send a module's functions with the task instead of by name, so executors need
    no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def once_per_row(return_type: T.DataType):
    """Arrow function that is evaluated where it stands and nowhere else.

    A deterministic one would be copied into pushed-down filters (a join key that is
    not null, say) and run again there.
    """

    def wrap(function):
        return F.arrow_udf(function, return_type).asNondeterministic()

    return wrap
