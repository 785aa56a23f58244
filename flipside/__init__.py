"""flipside: what-if analysis and evaluation of tabular data, as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  Fit passes are Spark
aggregates, apply passes are Column expressions, and all randomness is keyed
on the row, so results do not depend on partitioning or task retries.
"""
