"""Operators on corpora: repeats, selection, encoding, chunks, reports."""
