"""A Spark-first engine for dataset curation, alignment and evaluation."""
