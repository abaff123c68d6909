"""Span analytics on Spark: de-identification of text and measurement of residual risk."""
