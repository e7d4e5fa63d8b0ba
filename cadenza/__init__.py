"""A Spark-first engine for recommendation analytics and training-data preparation."""
