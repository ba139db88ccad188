"""Scalar expressions and value codecs."""
