"""Operators for large-scale training-data pipelines (nothing else in kinlink imports this package)."""
