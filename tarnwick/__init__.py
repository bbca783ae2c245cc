"""A Spark-first engine for evidence-bound corpus analytics."""
