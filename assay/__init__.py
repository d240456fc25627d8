"""Payload triage and corpus preparation as Spark DataFrames."""
