"""loomwork: DataFrame analytics functions that stay inside Spark's planner."""

__version__ = "0.1.0"
