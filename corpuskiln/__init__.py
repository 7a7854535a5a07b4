"""Corpus ETL, hybrid retrieval and retrieval evaluation as Spark DataFrame operators."""
