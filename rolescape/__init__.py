"""Vacancy analytics expressed as Spark DataFrame queries."""
