"""Operators of a training-data pipeline. Nothing else in lumenfold imports this subpackage."""
