"""Column expressions: addresses, labels, times, codecs."""
