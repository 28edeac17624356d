"""Operators of a large-scale training-data pipeline. Nothing else in leafpress imports this."""
