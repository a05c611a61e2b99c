"""Evidence assurance over tables: retrieval, claim checking, confidence, evaluation and data quality on Spark."""
