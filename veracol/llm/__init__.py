"""Operators for training-data pipelines: deduplication, search, scans, tokenizing, chat and toxicity."""
