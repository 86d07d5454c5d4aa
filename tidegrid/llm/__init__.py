"""Operators for training-data pipelines: sketches, tokens, packing and reading level."""
