"""Operators for training-data corpora. Nothing else in plumbline imports this subpackage."""
