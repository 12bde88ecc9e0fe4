"""Operators for preparing training text: one module each, all DataFrame in, DataFrame out."""
