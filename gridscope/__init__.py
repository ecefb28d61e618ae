"""Table profiling, data quality and baseline training on Spark."""
