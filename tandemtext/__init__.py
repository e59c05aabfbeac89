"""Parallel-corpus alignment and text processing expressed as Spark plans."""
