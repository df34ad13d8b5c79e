"""Operators for large-scale training-data pipelines. Nothing else in nestql imports this subpackage."""
