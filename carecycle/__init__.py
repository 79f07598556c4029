"""Repeat-admission cohort analytics as Spark DataFrame plans."""
