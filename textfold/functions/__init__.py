"""Column functions: token counts, canonical forms, placeholders, codebook formats."""
