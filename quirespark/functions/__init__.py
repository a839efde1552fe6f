"""Scalar functions: Column expressions in ``text``, Arrow-backed ones in ``arrow``."""
