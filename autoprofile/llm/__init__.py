"""Operators for building training corpora, each a Spark job over a documents table."""
