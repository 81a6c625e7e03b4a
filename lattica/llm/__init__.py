"""Operators for training-data pipelines. Nothing outside this folder imports it, but for the entry point, behind a guard."""
