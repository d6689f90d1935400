"""Lodestrata: Spark-first analytics over security-intelligence evidence."""
