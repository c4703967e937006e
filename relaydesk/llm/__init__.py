"""Operators for preparing training data, with the queries that apply them to whole tables."""
