"""Whole pipelines composed from operators: clean, dataset, evaluate."""
