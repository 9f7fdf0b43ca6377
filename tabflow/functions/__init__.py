"""Scalar expressions: their syntax tree, and their meaning as Spark columns."""
