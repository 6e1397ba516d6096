"""Spark-first engine for walk-forward rating, forecast evaluation and corpus preparation."""
