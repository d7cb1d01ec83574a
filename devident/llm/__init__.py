"""Operators of a training-data pipeline. Nothing outside this folder, its tests and the pipeline imports it."""
