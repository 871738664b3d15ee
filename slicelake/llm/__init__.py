"""Operators of a training-data pipeline; nothing else in slicelake imports this subpackage."""
