"""Vitrine: a catalogue analytics engine written as PySpark DataFrame, SQL and Structured Streaming programs."""
