"""tierlens: routing-cost, feedback, session and corpus analytics as Spark jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, joins, windows and aggregates; Python only runs where
a user-supplied model function or keyed streaming state needs it.
"""

from tierlens.runtime import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
