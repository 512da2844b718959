"""Operators: DataFrame in, DataFrame out. Tables are keyed by a recording (``key``) and ordered by (ts, sample_idx)."""
