"""Environmental time-series analytics on Spark DataFrames."""

from skygauge.session import get_spark

__all__ = ["get_spark"]
