"""Schema-evolution analytics over audit logs, as Spark DataFrame operators.

Everything here maps a DataFrame to a DataFrame with built-in Spark SQL
expressions, so each operator runs unchanged in batch jobs and inside
Structured Streaming micro-batches.
"""

from evotrail.options import FeedOptions, ReadMode, ReadOptions

__all__ = ["FeedOptions", "ReadMode", "ReadOptions"]
