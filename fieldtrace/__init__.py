"""fieldtrace: labelled movement time series on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` transformation that takes its
column names as arguments, so calls chain with ``df.transform``.
"""

__version__ = "0.1.0"
