"""Dialogue analytics on Spark: cue, line and token tables in, per-document features and score models out."""
