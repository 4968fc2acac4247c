"""textfold: token-aware text compaction on DataFrames."""

__version__ = "0.1.0"
