"""Typed-decision datasets on Spark: build, balance, check, score and compare."""
