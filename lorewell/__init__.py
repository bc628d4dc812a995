"""lorewell: a Spark-first engine for retrieval-oriented text analytics."""
