"""Operators for preparing training data. Nothing outside this folder, its tests and ``corpus_pipeline`` imports it."""
