"""Automated profiling and analysis of tables, as Spark DataFrame operators."""
