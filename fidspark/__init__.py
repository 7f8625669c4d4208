"""fidspark: compare a real table with a synthetic (or shifted) one on Spark.

Every operator takes and returns Spark DataFrames.  Work is expressed with the
DataFrame / SQL API (Catalyst, whole-stage codegen); Arrow-batched pandas code
is used only where no built-in operator fits (nearest neighbours, isolation
forest trees, quantile-grid interpolation).
"""

from fidspark.spec import TableSpec

__all__ = ["TableSpec"]
