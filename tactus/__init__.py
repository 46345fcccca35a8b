"""Spark-first analytics for timed, ordered, evidence-carrying tables."""
