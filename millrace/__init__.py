"""millrace: Spark-first engine for post-training data (grading, advantages, packing, splits, traces)."""

__version__ = "0.1.0"
