"""ridgeline: explicit-feedback recommendation on PySpark.

Ratings come in as headered text, tables or streams; alternating least squares
with count-weighted ridge regularisation turns them into factor tables; those
serve predictions, top-k recommendations and evaluation. Everything is a
DataFrame job.
"""

import sys

from pyspark import cloudpickle

# Task-side kernels travel with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from ridgeline.operators.als import ALSFactorizer, ALSModel  # noqa: E402

__all__ = ["ALSFactorizer", "ALSModel"]
