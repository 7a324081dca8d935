"""Operators for training-data pipelines: deduplication, tokenisation, scanning, search and decontamination."""
