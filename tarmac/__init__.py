"""tarmac: sales analytics as DataFrame-in / DataFrame-out functions on Spark.

Layout
------
sources/    readers, the sales view over the given tables, ingest/conform, star schema, sinks
functions/  column expressions (money sums, month keys, statistics)
operators/  analyses: BI aggregates, ABC, RFM, cohorts, elasticity, models
plans/      the registered named queries and their DuckDB oracle SQL
streaming/  incremental batch ingest with Structured Streaming
"""

__version__ = "0.1.0"
