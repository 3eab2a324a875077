"""Data profiling, cleaning, modelling and forecasting operators for PySpark.

Every operator takes a DataFrame and returns a DataFrame. Values that an
operator must know before it can build its plan (means, quantiles, cut points)
are fitted first and held on the driver; their number depends on the schema,
never on the row count.
"""

__version__ = "0.1.0"
