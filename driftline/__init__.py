"""Monitoring of models on event streams, as Spark DataFrame operators."""
