"""Symbolic-score analytics on Spark: ordered-data operators over tables of scores, MIDI logs, token streams and page profiles."""
