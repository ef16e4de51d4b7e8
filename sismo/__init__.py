"""sismo — seismic-catalogue analytics as lazy Spark DataFrame operators.

Every public operator is ``f(df, ...) -> DataFrame`` and adds nothing but a
logical plan; actions only happen inside the iterative trainers
(K-Means, network training) and in the explicit sinks.
"""

__version__ = "0.1.0"
