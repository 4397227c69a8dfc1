"""shopmetrics: product analytics for an online shop on Spark DataFrames.

Layers: ``sources`` (raw entities), ``operators`` (Silver cleaners, Gold marts,
filtered metrics, experiment statistics, data quality, retrieval, reports),
``functions`` (Column-level building blocks), ``plans`` (layer materialisation
and the query catalogue) and ``streaming`` (incremental form of the daily mart).
Every operator takes DataFrames and returns a lazy DataFrame.
"""

__all__ = ["session"]
