"""pondus — weighted survey-microdata analytics on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` transformation parameterised by
column names (value, weight, group, key), so it runs on any weighted table.

Sub-packages
------------
sources    readers, archives, dimension tables, sinks
functions  column-expression builders (coding rules, flags, weighted means, tails)
operators  aggregations, the ordered kernel, correlation, joins, KPIs, levers, models
plans      composed jobs (analysis frame, catalogue, request runs) and table bindings
streaming  incremental wave ingestion with Structured Streaming
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that Python workers
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
