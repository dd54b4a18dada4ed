"""Source code and text as relations: a Spark-first analytics engine."""
