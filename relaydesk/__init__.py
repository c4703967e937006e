"""Batch and micro-batch triage of support conversations on Spark DataFrames."""
