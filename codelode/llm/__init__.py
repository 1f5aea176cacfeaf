"""Operators that prepare texts for language models. Nothing outside this package imports it."""
