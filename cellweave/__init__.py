"""Spark-first analytics over events recorded by place, period and group."""
