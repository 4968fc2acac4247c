"""Whole plans: compression, decoding, the ablation matrix."""
