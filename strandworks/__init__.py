"""Nanopore read analytics on Spark: signals to sequences, quality and accuracy reports."""
