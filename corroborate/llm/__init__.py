"""Operators of a training-data pipeline. Nothing outside this folder imports it but the entry module and the pipeline."""
