"""Operators for training-data pipelines: dedup, mixing, scans, filters and classifiers over `documents` and `pages`."""
