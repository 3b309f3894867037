"""Scalar functions.  ``column(scalars.category, "title")`` is the Spark column of one."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK


def column(function, *args, **options) -> Column:
    return F.expr(function(SPARK, *args, **options))
