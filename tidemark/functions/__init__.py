"""Column expressions: type codecs, value readers, partition functions."""
