"""Operators for preparing the text of training corpora."""
