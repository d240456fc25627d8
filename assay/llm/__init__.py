"""Operators for large text-training corpora: one module each, all DataFrame in, DataFrame out."""
