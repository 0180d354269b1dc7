"""Operators of a large training-data pipeline. Nothing else in millrace imports this subpackage."""
