"""Operators of a large-scale training-data pipeline. Nothing else in weft imports this subpackage."""
